"""Every stage of the pipeline against a plain version of it."""

import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import secret_scan as S

from .test_decontam import brute as contamination
from .test_ngram_join import brute as components
from .test_quality import POLICIES
from .test_quality import brute as quality


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    now = docs
    (n6, quality_rules), (n2, near), (n5, decontamination), (n8, secrets), (n4, encode) = corpus_pipeline.STAGES

    now = quality_rules(spark, now, sf_dir)
    want = {i for i, t in rows.items() if not quality(t)["fail_bits"] & POLICIES["v1"]}
    assert now.columns == columns and {r.doc_id for r in now.collect()} == want

    now = near(spark, now, sf_dir).cache()
    want = {c for _, _, c in components([(i, rows[i]) for i in want])}
    assert now.columns == columns and sorted(r.doc_id for r in now.collect()) == sorted(want)

    now = decontamination(spark, now, sf_dir)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {i for i, _, hit, _ in contamination([(i, rows[i]) for i in want], items, 10) if not hit}
    assert now.columns == columns and {r.doc_id for r in now.collect()} == want

    now = secrets(spark, now, sf_dir)
    clean = {r.doc_id: r.text for r in now.collect()}
    assert now.columns == columns and set(clean) == want
    for i, text in clean.items():
        pattern = "(.*)".join(map(re.escape, text.split(S.MASK)))
        found = re.fullmatch(pattern, rows[i], re.S)
        assert found and all(re.fullmatch(S.CANDIDATE, x) for x in found.groups())

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in encode(spark, now, sf_dir).collect():
        assert r.ids == library.encode(clean[r.doc_id], add_special_tokens=False).ids and r.round_trip


def test_run_is_the_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_on_odd_rows(spark, sf_dir):
    good = " ".join(f"w{i}" for i in range(80))
    token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(i, t, "x", "y", 5, 1, 2, 3, 4, 5, 6) for i, t in [(1, good), (2, good + " end"), (2, good + " end"), (3, None), (4, ""), (None, good[::-1]), (5, " ".join(f"v{i}" for i in range(50_000))), (6, " ".join(f"u{i}" for i in range(90)) + f' token = "{token}"')]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, spans int, candidates int, ids int, kept int, _row int")
    now = df
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), sf_dir).count() == 0, name
        was, now = now, stage(spark, now, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == df.columns
            assert all(tuple(r[5:]) == (1, 2, 3, 4, 5, 6) for r in now.collect()), name
    assert sorted((r.doc_id or 0) for r in was.collect()) == [0, 1, 5, 6]
    assert all(token not in r.text for r in was.collect())
    assert now.count() == 4 and all(r.round_trip for r in now.collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, sf_dir).count() > 0
