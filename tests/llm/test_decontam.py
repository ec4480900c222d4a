import random
import re

import pytest

from graphloom.llm import queries
from graphloom.llm.decontam import ItemAutomaton, contaminated_spans, contamination_report, find_contamination, remove_contaminated

from ..conftest import same_rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            q = words(t)
            for k in range(max(1, len(q) - window + 1)) if q else ():
                p = q[k : k + window]
                for at in range(len(w) - len(p) + 1):
                    if w[at : at + len(p)] == p:
                        hit.update(range(at, at + len(p)))
                        found.add(str(item))
        out.append((i, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=repr)


def test_random_texts(spark):
    rng = random.Random(3)
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(["a", "B", "b", "c", "é", "1"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(None, "a b c d"), (70, None), (70, None), (71, ""), (72, "..."), (73, "z " * 50_000 + "a b c c")]
    items = [(i, text(rng.randint(0, 7))) for i in range(12)] + [(50, None), (51, "?!"), (9, "a b c c"), (9, "a b c c")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, spans int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find_contamination(df, bench, 4)
    assert str(found._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1
    got = sorted(((r.doc_id, r.n_words, sum(b - a for a, b in r.spans), ",".join(r.item_ids)) for r in found.collect()), key=repr)
    assert got == brute(docs, items, 4)
    kept = remove_contaminated(df, bench, 4)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _, n, _ in brute(docs, items, 4) if not n), key=repr)


@pytest.mark.parametrize("window", [1, 2, 3, 5, 8, 10])
def test_automaton_by_brute_force(window, tmp_path):
    """Few words, so that windows overlap, repeat and end in each other; items of every length."""
    for seed in range(40):
        rng = random.Random(seed)
        letters = "abc"[: rng.randint(1, 3)]
        text = lambda n: " ".join(rng.choice(letters) for _ in range(n))
        items = [(i, text(rng.randint(0, 2 * window + 2))) for i in range(rng.randint(0, 6))]
        docs = [(i, text(rng.randint(0, 40))) for i in range(6)]
        path = tmp_path / f"{seed}"
        path.write_bytes(ItemAutomaton.build([t for _, t in items], window).to_bytes())
        automaton = ItemAutomaton.open(str(path))
        got = []
        for i, t in docs:
            n, spans, found = automaton.scan(t)
            got.append((i, n, sum(b - a for a, b in spans), ",".join(sorted(map(str, found)))))
        assert sorted(got, key=repr) == brute(docs, items, window), (seed, items, docs)


def test_large_benchmark(spark):
    """A hundred times what one block of the automaton's list used to hold for its size, in one pass."""
    rng = random.Random(4)
    items = [(i, " ".join(f"{rng.randrange(3000)}" for _ in range(40))) for i in range(20_000)]
    docs = [(k, " ".join([*(f"{rng.randrange(3000)}" for _ in range(200)), items[k * 997][1], "end"])) for k in range(20)] + [(99, " ".join(f"{rng.randrange(3000)}" for _ in range(5000)))]
    found = find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert str(found._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1
    got = {r.doc_id: (r.spans, r.item_ids) for r in found.collect()}
    assert got == {k: ([[200, 240]], [str(k * 997)]) for k in range(20)} | {99: ([], [])}


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination_report(df, none).first().contaminated is False
    assert contamination_report(df.limit(0), none).count() == 0


def test_character_spans(spark):
    text = "Well -- Ä, the  ANSWER\tis: forty-two! Yes"
    df = spark.createDataFrame([(1, text), (2, None), (3, "no")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the answer is forty two")], "item_id long, text string")
    got = {r.doc_id: r.char_spans for r in contaminated_spans(df, bench).collect()}
    assert [text[a:b] for a, b in got[1]] == ["the  ANSWER\tis: forty-two"] and got[2] == got[3] == []


def test_query(spark, sf_dir, duck):
    same_rows(queries.op5_decontamination(spark, sf_dir), duck, queries.OP5_SQL)
