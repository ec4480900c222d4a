"""Columns of any name, maps, repeated ids and letterless texts, for every operator."""

import public_tokenizers
import pytest

from graphloom.llm import bpe, decontam, langid, licenses, ngram_join, quality, secret_scan, token_count, token_orc, url_filter

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORDS = " ".join(f"w{i}" for i in range(60))
TEXTS = [(3, WORDS), (5, WORDS + " end"), (5, "something else " + " ".join(f"u{i}" for i in range(60))), (6, None), (7, ""), (8, "² ½ 12"), (None, "p q r"), (9, WORDS), (9, WORDS)]
#: Every column that an operator adds, in one case or another, and names that need quoting.
NAMES = [
    "a.b", "a`b", "with space", "Host", "path", "RULE", "verdict", "n_bytes", "n_tokens", "over_limit", "ids", "ids_sha256", "decoded_sha256", "round_trip", "n_words", "spans", "item_ids", "char_spans", "n_hit", "n_items",
    "items_sha256", "contaminated", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "fail_bits", "candidates", "n_candidates", "n_secrets", "secret_starts", "redacted_sha256", "Lang_Pred", "score",
    "lang_set", "document_license", "license_ids", "n_licenses", "n_shingles", "component_id", "_row", "_license", "sig", "lead", "again", "hash", "id", "rank", "url", "c", "whole", "digest", "n", "label",
]


@pytest.fixture(scope="module")
def docs(spark):
    schema = ", ".join(["doc_id long", "text string", *("`" + x.replace("`", "``") + "` string" for x in NAMES), "m map<string,int>"])
    return spark.createDataFrame([(i, t, *NAMES, {"k": 1}) for i, t in TEXTS], schema)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (None, "w20 w21 w22 w23 w24 w25 w26 w27 w28 w29")], "item_id long, text string")


def operators(spark, bench):
    model = langid.fit(spark.createDataFrame([("der die das", "de"), ("the of and", "en")], "text string, lang string"))
    forest = secret_scan.train(spark)
    return {
        "url_verdicts": (lambda d: url_filter.url_verdicts(d, [("block", "com/")], "text"), "host path rule verdict", True),
        "token_counts": (lambda d: token_count.token_counts(d, PIECES), "n_bytes n_tokens over_limit", False),
        "round_trip_digests": (lambda d: bpe.round_trip_digests(d, BYTES), "n_tokens ids_sha256 decoded_sha256", False),
        "encode_checked": (lambda d: bpe.encode_checked(d, BYTES), "n_tokens ids round_trip", False),
        "decode_column": (lambda d: bpe.decode_column(bpe.encode_column(d, BYTES), BYTES), "ids text", None),
        "contamination_report": (lambda d: decontam.contamination_report(d, bench), "n_words n_hit n_items items_sha256 contaminated", False),
        "contaminated_spans": (lambda d: decontam.contaminated_spans(d, bench), "n_words item_ids char_spans", True),
        "quality_ledger": (quality.quality_ledger, " ".join([*quality.MEASURES, "fail_bits"]), True),
        "secret_report": (lambda d: secret_scan.secret_report(d, forest), "n_candidates n_secrets secret_starts redacted_sha256", False),
        "identify": (lambda d: langid.identify(d, model), "lang_pred score lang_set", False),
        "find_licenses": (licenses.find_licenses, "document_license license_ids n_licenses", False),
    }


def test_columns_of_any_name(spark, docs, bench):
    for name, (run, new, text) in operators(spark, bench).items():
        new = new.split()
        out = run(docs)
        rows = out.collect()
        assert len(rows) == len(TEXTS), name
        lower = {x.lower() for x in new}
        kept = [c for c in docs.columns if c.lower() not in lower and (text or c != "text")]
        assert sorted(c for c in out.columns if c not in new) == sorted(kept), name
        assert set(new) - {"ids"} <= set(out.columns), name
        for r in rows:
            assert all(r[c] == c for c in kept if c in NAMES) and r["m"] == {"k": 1}, name


@pytest.mark.parametrize("column", ["host", "rule", "verdict", "a.b"])
def test_url_read_from_a_column_that_is_replaced(spark, column):
    df = spark.createDataFrame([("http://x.com/a",), (None,)], f"`{column}` string")
    got = sorted(((r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(df, [("block", "com/a")], column).collect()), key=repr)
    assert got == [("", "", None, "allow"), ("x.com", "/a", "com/a", "block")]


def test_filters_keep_the_table(spark, docs, bench):
    for run in (quality.keep_good, lambda d: ngram_join.keep_one(d), lambda d: decontam.remove_contaminated(d, bench), lambda d: secret_scan.redact_secrets(d, secret_scan.train(spark))):
        out = run(docs)
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert all(r["m"] == {"k": 1} and r["a.b"] == "a.b" for r in out.collect())


def test_one_of_each_group_by_row(docs):
    """Ids that repeat with other texts: rows are told apart by id and text."""
    got = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(docs).collect()), key=repr)
    assert got == sorted([(3, WORDS), TEXTS[2], (6, None), (7, ""), TEXTS[5], TEXTS[6]], key=repr)


def test_near_duplicates_beside_any_column(docs):
    rows = ngram_join.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=repr) == sorted([(3, 3), (5, 3), (5, 5), (6, 6), (7, 7), (8, 8), (None, None), (9, 3), (9, 3)], key=repr)


def test_items_without_an_id_count_as_one(docs, bench):
    r = next(r for r in decontam.contamination_report(docs.select("doc_id", "text"), bench.union(bench)).collect() if r.doc_id == 3)
    assert (r.n_hit, r.n_items) == (21, 2)


def test_letterless_texts_have_no_language(spark):
    model = langid.fit(spark.createDataFrame([("der die das", "de"), ("the of and", "en")], "text string, lang string"))
    odd = ["² ½ 12", "Ⅷ ①", "١٢٣", "___", "😀 🇩🇪", "́̈"]
    df = spark.createDataFrame([(t,) for t in [*odd, "é"]], "text string")
    assert [r.lang_pred == "und" for r in langid.identify(df.coalesce(1), model).collect()] == [True] * len(odd) + [False]


def test_token_files_of_odd_columns(spark, docs, tmp_path):
    token_orc.write_token_orc(docs.withColumnRenamed("doc_id", "x.y"), f"file://{tmp_path}/o", BYTES, id_col="x.y")
    assert token_orc.read_token_orc(spark, f"file://{tmp_path}/o").count() == len(TEXTS)
