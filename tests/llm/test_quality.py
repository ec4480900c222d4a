import random
import re

from graphloom.llm import queries
from graphloom.llm.quality import BIT, POLICIES, ablations, apply_policy, keep_good, quality_ledger

from ..conftest import same_rows

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    m = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside), "n_lines": len(lines), "n_upper": sum("A" <= c <= "Z" for c in text)}
    failed = {
        "few_words": m["n_words"] < 50,
        "repeated_words": 100 * m["n_repeat_words"] > 50 * m["n_words"],
        "symbols": 100 * m["n_symbols"] > 25 * m["n_words"],
        "repeated_lines": 100 * m["n_dup_lines"] > 40 * m["n_lines"],
        "upper_case": 100 * m["n_upper"] > 40 * m["word_chars"],
        "long_words": m["word_chars"] > 200 * m["n_words"],
    }
    return m | {"fail_bits": sum(BIT[k] for k, v in failed.items() if v)}


def texts():
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "B", "ccc", "é", "😀", "#", "d|e", "FF", "\x1f", "\xa0"])
    out = ["".join(word() + rng.choice([" ", "\n", "  ", "\t", "\r\n", "\x0b"]) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    return [*out, None, "", " \n ", "one", "one two", "a b c", "a a a a", "x" * 70_000, "same line\n" * 60, " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(60))]


def test_measures(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, n_words string").repartition(3)
    got = {r.doc_id: r.asDict() for r in quality_ledger(df).collect()}
    for i, t in rows:
        want = brute(t)
        assert {k: got[i][k] for k in want} == want, repr(t)
    kept = keep_good(df, "v1")
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.n_words) for r in kept.collect()) == [(i, "own") for i, t in rows if not brute(t)["fail_bits"] & POLICIES["v1"]]


def test_long_repetitive_text(spark):
    text = " ".join(f"w{i % 700}" for i in range(20_000))
    assert quality_ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().n_repeat_words == 20_000


def test_ablations(spark):
    rows = list(enumerate(texts()))
    ledger = apply_policy(quality_ledger(spark.createDataFrame(rows, "doc_id long, text string")), "v1")
    bits = [brute(t)["fail_bits"] for _, t in rows]
    for r in ablations(ledger).collect():
        mask, bit = POLICIES[r.policy], BIT[r.rule]
        assert r.rejected == sum(bool(b & mask) for b in bits)
        assert r.failed_rule == sum(bool(b & bit) for b in bits)
        assert r.by_rule_alone == sum(b & mask == bit for b in bits)
        assert r.rejected_without == sum(bool(b & mask & ~bit) for b in bits)
    assert quality_ledger(ledger.select("doc_id").limit(0).selectExpr("doc_id", "'x' as text")).count() == 0


def test_plan_is_native(spark, sf_dir):
    plan = queries.op6_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_query(spark, sf_dir, duck):
    same_rows(queries.op6_quality_rules(spark, sf_dir), duck, queries.OP6_SQL)
