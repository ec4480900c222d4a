"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import langid, licenses, secret_scan
from graphloom.llm.bpe import round_trip_digests
from graphloom.llm.decontam import contamination_report
from graphloom.llm.ngram_join import near_duplicates
from graphloom.llm.quality import apply_policy, quality_ledger
from graphloom.llm.token_count import token_counts
from graphloom.llm.token_orc import token_digests
from graphloom.llm.url_filter import url_verdicts

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination_report(docs, table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = apply_policy(apply_policy(ledger, "base", "base_kept"), "v1")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~judged.base_kept).alias("base_failed"), "kept", "fail_bits")


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


OP1_SQL = r"""
WITH cut AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rh, rp, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM cut JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND prefix(path, rp)
  GROUP BY page_id)
SELECT cut.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM cut LEFT JOIN fits ON cut.page_id IS NOT DISTINCT FROM fits.page_id
"""


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents").select("doc_id", "text"), secret_scan.train(spark))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where(~docs.held_out))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).drop("lang_set")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Shingles as texts, pairs by common shingles, components by the smallest id that spreads along links.
OP2_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
cc(id, component) USING KEY (id) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT s.a, min(f.component) FROM cc f JOIN both_ways s ON s.b = f.id JOIN recurring.cc x ON x.id = s.a WHERE f.component < x.component GROUP BY s.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component AS component_id FROM documents LEFT JOIN n USING (doc_id) JOIN cc ON id = doc_id
"""

#: Items and windows as word lists; a document's windows of each length that occurs among the items.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN iw USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Words of whole texts; windows of three words that occur twice or more; lines.
OP6_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM pos),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM win, range(3) t(k) WHERE n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
m AS (
  SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 40 * n_lines OR 100 * n_upper > 40 * word_chars) AS kept,
       ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 25 * n_words)::INT + 8 * (100 * n_dup_lines > 40 * n_lines)::INT + 16 * (100 * n_upper > 40 * word_chars)::INT + 32 * (word_chars > 200 * n_words)::INT)::BIGINT AS fail_bits
FROM m
"""

#: The same canonical form in DuckDB's functions.
_CANON = "lower({})"
_CANON = f"regexp_replace({_CANON}, '{licenses.COPYRIGHT_LINE}', ' ', 'g')"
for _a, _b in licenses.SPELLINGS:
    _CANON = f"regexp_replace({_CANON}, '{_a}', '{_b}', 'g')"
_CANON = f"trim(regexp_replace({_CANON}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_KNOWN = ", ".join("({}, {})".format(*("'" + x.replace("'", "''") + "'" for x in (k[0], k[2]))) for k in licenses.KNOWN)
_CANON_OF = lambda x: _CANON.replace("lower({})", f"lower({x})")
OP10_SQL = f"""
WITH k AS (SELECT DISTINCT license, sha256({_CANON_OF("t")}) AS d FROM (VALUES {_KNOWN}) v(license, t)),
u AS (
  SELECT doc_id, TRUE AS whole, {_CANON_OF("text")} AS c FROM documents
  UNION ALL
  SELECT doc_id, FALSE, {_CANON_OF("x")} FROM (SELECT doc_id, unnest(list_distinct(string_split(text, chr(10)))) AS x FROM documents)),
hit AS (SELECT doc_id, whole, license FROM u JOIN k ON c <> '' AND sha256(c) = d),
per AS (SELECT doc_id, max(license) FILTER (whole) AS document_license, list_sort(list_distinct(list(license))) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, document_license, coalesce(array_to_string(ids, ','), '') AS license_ids, coalesce(len(ids), 0)::BIGINT AS n_licenses
FROM documents d LEFT JOIN per USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_ngram_join": op2_ngram_join,
        "op3_token_counts": op3_token_counts,
        "op4_bpe_round_trip": op4_bpe_round_trip,
        "op5_decontamination": op5_decontamination,
        "op6_quality_rules": op6_quality_rules,
        "op7_token_orc": op7_token_orc,
        "op8_secret_scan": op8_secret_scan,
        "op9_language_id": op9_language_id,
        "op10_license_scan": op10_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op2_ngram_join": OP2_SQL, "op5_decontamination": OP5_SQL, "op6_quality_rules": OP6_SQL, "op10_license_scan": OP10_SQL}
