import zlib

import numpy as np
import pytest

from graphloom.llm import queries
from graphloom.llm.langid import held_out as langid_held_out
from graphloom.llm.langid import BUCKETS, MixtureModel, fit, identify, ngram_counts

WORDS = {"en": "the of and to in is that with for was on as", "de": "der die und das ist nicht ein mit sich für auf", "fr": "le la les des est une dans que pour pas avec où"}


def text(lang, n, seed=0):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS[lang].split(), n))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, text(lang, 40, i), lang) for i in range(40) for lang in WORDS] + [(99, None, "en"), (98, "la la", None)]
    return fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))


def test_counts_do_not_depend_on_pieces(monkeypatch):
    from graphloom.llm import langid

    long = "Ünïcode Wörter 123 " * 500
    whole = ngram_counts(long)
    monkeypatch.setattr(langid, "_PIECE", 97)
    assert (ngram_counts(long) == whole).all()


def test_fit_counts_every_row(spark, model):
    rows = [(text(lang, 40, i), lang) for i in range(40) for lang in WORDS]
    counts = np.zeros((3, BUCKETS))
    for t, lang in rows:
        counts[sorted(WORDS).index(lang)] += ngram_counts(t)
    assert model.languages == sorted(WORDS)
    assert np.allclose(model.p, MixtureModel(sorted(WORDS), counts).p)


def test_single_and_mixed(model):
    assert model.predict(text("de", 60, 500))[0] == "de"
    name, score, chosen = model.predict(text("fr", 200, 501) + " " + text("en", 80, 502))
    assert name == "fr" and [x for x, _ in chosen] == ["fr", "en"] and 0.6 < score < 0.85
    assert len(model.predict(text("en", 60, 503))[2]) == 1


def test_likelihood_grows(model):
    counts = ngram_counts(text("de", 50, 7) + text("en", 50, 8))
    seen = np.flatnonzero(counts)
    x, c = model.p[seen], counts[seen].astype(float)
    values = [model.mixture(x, c, steps=k)[1] for k in range(8)]
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:], strict=False))
    assert model.mixture(x, c)[0].sum() == pytest.approx(1)


def test_edge_cases(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !? ___", "x"), (4, text("en", 30, 9), "x"), (4, text("en", 30, 9), "x"), (None, text("de", 30, 9), "x"), (5, text("fr", 200_000, 1), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = sorted(((r.doc_id or 0, r.lang_pred, r.score > 0) for r in identify(df, model).collect()))
    assert got == [(0, "de", True), (1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (4, "en", True), (5, "fr", True)]
    nothing = fit(df.selectExpr("text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in identify(df, nothing).collect()} == {"und"}
    assert identify(df.limit(0), model).count() == 0
    assert fit(df.limit(0).selectExpr("text", "score as lang")).languages == []


def test_any_number_of_languages(spark, monkeypatch):
    """More labels than a task holds at once; each has letters of its own."""
    from graphloom.llm import langid

    names = [f"l{k:03d}" for k in range(300)]
    own = lambda k: " ".join(chr(0x4E00 + 7 * k + j) * 3 for j in range(5))
    monkeypatch.setattr(langid, "HELD_LABELS", 7)
    many = fit(spark.createDataFrame([(own(k), x) for k, x in enumerate(names)] * 2, "text string, lang string"))
    assert many.languages == names
    assert [many.predict(own(k))[0] for k in (0, 150, 299)] == [names[k] for k in (0, 150, 299)]


def plain_model(rows):
    """Bucket probabilities of each language by the definition, in plain Python."""
    from collections import Counter

    counts = {}
    for t, lang in rows:
        counts.setdefault(lang, Counter()).update(plain_grams(t))
    return {lang: [(c[b] + 0.5) / (sum(c.values()) + 0.5 * BUCKETS) for b in range(BUCKETS)] for lang, c in counts.items()}


def plain_grams(t):
    data = b" " + bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in t.lower().encode()) + b" "
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    at = lambda i: data[i] if i < len(data) else 0
    out = []
    for i in range(len(data)):
        two = at(i) * 257 + at(i + 1) + 256
        three = two * 1031 + at(i + 2) * 7919 + 40503
        for g, fits in ((at(i), True), (two, i + 1 < len(data)), (three, i + 2 < len(data))):
            if fits:
                out.append((g * 2654435761 % 2**32) >> 18)
    return out


def plain_predict(model, t, penalty=3.0):
    """Expectation-maximisation and the penalised choice, one n-gram at a time."""
    import math

    if t is None or not any(ch.isalpha() for ch in t):
        return "und", 0.0
    grams, names = plain_grams(t), sorted(model)

    def mixture(chosen):
        theta = dict.fromkeys(chosen, 1 / len(chosen))
        while len(chosen) > 1:
            new = dict.fromkeys(chosen, 0.0)
            for g in grams:
                total = sum(theta[x] * model[x][g] for x in chosen)
                for x in chosen:
                    new[x] += theta[x] * model[x][g] / total / len(grams)
            moved = max(abs(new[x] - theta[x]) for x in chosen)
            theta = new
            if moved < 1e-5:
                break
        return theta, sum(math.log(sum(theta[x] * model[x][g] for x in chosen)) for g in grams)

    theta, _ = mixture(names)
    alone = {x: sum(math.log(model[x][g]) for g in grams) for x in names}
    first = max(names, key=lambda x: alone[x])
    order = [first, *sorted((x for x in names if x != first), key=lambda x: (-theta[x], x))]
    price = penalty * math.log(len(grams) + 1)
    best, shares = alone[first], {first: 1.0}
    for n in range(2, len(order) + 1):
        part, value = mixture(order[:n])
        if value - price * (n - 1) > best:
            best, shares = value - price * (n - 1), part
    name = min(shares, key=lambda x: (-shares[x], x))
    return name, theta[name]


def test_rows_by_brute_force(spark):
    """The query's rows on a small table, against a second implementation."""
    rows = [(i, text(lang, 20, i) + (" " + text("fr", 12, i) if i % 3 == 0 else ""), lang if i % 7 else None) for i in range(16) for lang in ("en", "de")]
    rows += [(50, None, "en"), (51, "12 ½", "en"), (52, "", "de"), (53, "zzz", "fr"), (54, text("fr", 30, 3), "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", langid_held_out())
    got = {(r.doc_id, r.text_): (r.lang_pred, round(r.score, 3)) for r in identify(df.selectExpr("*", "text as text_"), fit(df.where("not held_out"))).collect()}
    model = plain_model([(t, lang) for i, t, lang in rows if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2])
    assert len(got) == len({(i, t) for i, t, _ in rows})
    for (_, t), (name, score) in got.items():
        want = plain_predict(model, t)
        assert (name, score) == (want[0], pytest.approx(want[1], abs=0.002))


def test_query_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op9_language_id(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) / len(held) > 0.97
