"""URL filter: one trie over reversed host labels, then path segments.

A rule is a host and a path prefix. It fits the host itself and all its
subdomains, where the url's path starts with the rule's path. Among the rules
that fit, the longest (host and path together) decides; of equally long ones
the one with the longer host, then block before allow.

At most ``block_entries`` rules become one trie, broadcast as it is and loaded
once in each Python worker; a longer list is applied block by block, each
carrying the best match so far, so no broadcast grows with the list and no
shuffle is needed.

Nulls and urls without ``://`` have an empty host and path, match nothing and
get the default verdict. Repeated rules and repeated rows are harmless; an
empty rule list gives every row the default; columns that clash with the
output names are replaced (the url may be read from one of them).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.cache import only
from graphloom.llm.rows import boxed, own, quoted
from graphloom.runtime import Scratch, ship_package

_URL = re.compile(r"\A.*?://([^/?#]*)([^?#]*)", re.S)
_LOWER = {c: c + 32 for c in range(65, 91)}
ALLOW, BLOCK = "allow", "block"
OUT = ("host", "path", "rule", "verdict")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or no ``://``."""
    m = _URL.match(url) if url is not None else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class UrlTrie:
    """Children by host label (outermost first), then by whole path segment.

    The last segment of a rule's path is a prefix of the url's segment there: it
    is kept in ``tails`` of its node, looked up once for each length present.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.hosts: dict = {}
        for host, path, verdict in rules:
            node = self.hosts
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, ({}, {}))  # None: where the path begins
            *whole, tail = path.split("/")
            for segment in whole:
                node = node[0].setdefault(segment, ({}, {}))
            same = node[1].setdefault(len(tail), {})
            rank = (len(host) + len(path), len(host), verdict == BLOCK)
            if tail not in same or same[tail][0] < rank:
                same[tail] = (rank, host + path, verdict)

    def match(self, host: str, path: str):
        """(rank, rule, verdict) of the longest rule that fits, or None."""
        best, node, segments = None, self.hosts, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            at = node.get(None)
            for segment in segments:
                if at is None:
                    break
                for length, same in at[1].items():
                    found = same.get(segment[:length])
                    if found and len(segment) >= length and (best is None or found[0] > best[0]):
                        best = found
                at = at[0].get(segment)
        return best


def parse_rules(rules: Iterable[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """From (verdict, "host/path") to (host, path, verdict)."""
    out = []
    for verdict, rule in rules:
        if verdict not in (ALLOW, BLOCK):
            raise ValueError(f"unknown verdict {verdict!r}")
        cut = rule.find("/")
        out.append((rule[:cut], rule[cut:], verdict) if cut >= 0 else (rule, "", verdict))
    return out


def url_verdicts(
    df: DataFrame,
    rules: Iterable[tuple[str, str]],
    url_col: str = "url",
    default: str = ALLOW,
    block_entries: int = 1_000_000,
) -> DataFrame:
    """``df`` with host, path, rule (or null) and verdict of each row's url."""
    spark = df.sparkSession
    ship_package(spark)
    parsed = parse_rules(rules)
    blocks = [parsed[i : i + block_entries] for i in range(0, len(parsed), block_entries)] or [[]]
    out = boxed(df, F.col(quoted(url_col)).cast("string").alias("url"), but=OUT)
    schema = T.StructType(list(out.schema))
    for name in OUT:
        schema = schema.add(name, T.StringType())
    schema = schema.add("rank", T.ArrayType(T.IntegerType()))
    scratch = Scratch(spark, "url_filter") if len(blocks) > 1 else None
    for i, block in enumerate(blocks):
        if i:
            out = scratch.table(out, "block")
        out = out.mapInArrow(_judge(spark.sparkContext.broadcast(UrlTrie(block)), uuid.uuid4().hex, default), schema)
    return out.select(*own(df, *OUT), *OUT)


def _judge(shared, name: str, default: str):
    def run(batches):
        trie = only(("trie", name), lambda: shared.value)
        for batch in batches:
            urls = batch.column("url").to_pylist()
            again = "rank" in batch.schema.names
            prior = zip(*(batch.column(c).to_pylist() for c in ("rank", "rule", "verdict")), strict=True) if again else (None for _ in urls)
            hosts, paths, rules, verdicts, ranks = [], [], [], [], []
            for url, before in zip(urls, prior, strict=False):
                host, path = split_url(url)
                found = trie.match(host, path) if host else None
                best = (tuple(before[0]), before[1], before[2]) if before and before[0] else None
                if found and (best is None or found[0] > best[0]):
                    best = found
                hosts.append(host)
                paths.append(path)
                rules.append(best[1] if best else None)
                verdicts.append(best[2] if best else default)
                ranks.append([int(x) for x in best[0]] if best else None)
            cols = [batch.column(0), batch.column(1), *(pa.array(x, pa.string()) for x in (hosts, paths, rules, verdicts)), pa.array(ranks, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:2], *OUT, "rank"])

    return run
