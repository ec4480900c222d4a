import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import queries
from graphloom.llm.url_filter import UrlTrie, parse_rules, split_url, url_verdicts

from ..conftest import same_rows

RULES = [*queries.URL_RULES, ("block", "b.com"), ("allow", "x.b.com/"), ("block", "x.b.com/a/b"), ("allow", "b.com/a")]


def brute(rules, host, path):
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in parse_rules(rules) if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else None


labels = st.sampled_from(["a", "b", "x", "com", "org", "de", "example", ""])
segments = st.sampled_from(["", "a", "b", "en", "1", "12", "es", "de", "fr", "ab"])


@settings(max_examples=300, deadline=None)
@given(st.lists(labels, min_size=1, max_size=4), st.lists(segments, max_size=4))
def test_trie_is_longest_match(hosts, parts):
    host, path = ".".join(hosts), "".join("/" + p for p in parts)
    found = UrlTrie(parse_rules(RULES)).match(host, path) if host else None
    assert (found[1:] if found else None) == brute(RULES, host, path)


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (None, ("", "")),
        ("", ("", "")),
        ("example.org/x", ("", "")),
        ("HTTP://A.Org", ("a.org", "")),
        ("http://a.org?x=/y", ("a.org", "")),
        ("http://a.org/p#f?q", ("a.org", "/p")),
        ("x\ny://h/é/Ä?", ("h", "/é/Ä")),
        ("a://b://c/d", ("b:", "//c/d")),
    ],
)
def test_split(url, want):
    assert split_url(url) == want


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_table(spark, block):
    rows = [(1, "http://x.b.com/a/b", 7), (1, "http://x.b.com/a/b", 7), (2, None, 8), (None, "no url", 9), (3, "https://q.b.com/a", 1), (4, "http://z.net/" + "y" * 100_000, 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule long")
    got = sorted(map(tuple, url_verdicts(df, RULES, block_entries=block).select("page_id", "rule", "verdict").collect()), key=repr)
    assert got == sorted([(1, "x.b.com/a/b", "block")] * 2 + [(2, None, "allow"), (None, None, "allow"), (3, "b.com/a", "allow"), (4, None, "allow")], key=repr)
    assert url_verdicts(df.limit(0), RULES).count() == 0
    assert url_verdicts(df, [], default="block").where("verdict = 'block'").count() == 6


def test_query(spark, sf_dir, duck):
    same_rows(queries.op1_url_filter(spark, sf_dir), duck, queries.OP1_SQL)


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = queries.op1_url_filter(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan and "Exchange" not in plan
