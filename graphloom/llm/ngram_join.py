"""Exact Jaccard self-join on word n-grams by prefix filters under several global orders.

Two texts link when 100 * |A & B| >= percent * |A | B| for their sets of n-word
shingles. A text with n shingles has at least ceil(percent * n / 100) of them in
common with any partner. Hence, in any order of all shingles that is the same
for all texts, the first n - ceil(percent * n / 100) + 1 shingles of two linked
texts have one in common. Three such orders are used: from rare to frequent (by
document frequency over the whole table), and two by unrelated hashes that know
nothing of frequency. The first is the one that candidates come from, as its
prefixes are rare; a pair is verified only if the texts share a prefix shingle
under all three. Shingles that no other text holds can be left out of every order
(both sides of the bound shrink by them), so only shared ones are kept.

How it runs
-----------
1. Each task hashes its texts' shingles, keeps one copy of equal sets, and sends
   the hashes, sorted and packed, to range buckets of the hash space; how many
   buckets follows from the size of the texts; with more buckets than
   ``max_partitions`` a task takes several, one after another in sorted order.
   A shingle that many texts of a
   block hold is sent once, with their number. A bucket finds its shingles'
   document frequencies and answers the block a text came from, for shared
   shingles only. A text of which too few shingles are shared with any other
   cannot have a partner and is done.
2. Equal sets become one class; a class's shared shingles are kept in the first
   order, with the other orders' prefixes beside it.
3. Prefix shingles that the same classes hold become one group, and each class
   is verified against the leader that it shares most groups with. That is one
   pair for each class and joins most near copies at once.
4. What may still link are classes of one candidate cluster (classes connected
   by groups) that step 3 has not connected. They are compared in blocks of
   bounded size, under all prefix filters, then verified; the largest part of
   a cluster that is connected already is never compared with itself. A cluster
   of more than ``cluster_size`` classes is compared group by group instead.
   Every pair that shares a prefix shingle is either connected or compared, so
   no link is lost, and no list of pairs is ever made.
5. Links are contracted to components by ``connected_components``. Joins with what is
   known of sets and components broadcast the few keys that hold more than a
   thousandth of the rows, so no task takes a large group.

Shingles are 56-bit hashes, equal sets are found by 128-bit hashes; the odds of
a wrong comparison are about 1e-9 for two texts of ten thousand words.

Null, empty and wordless texts have 0 shingles and link with nothing; texts of
fewer words than n have their whole sequence as one shingle. Rows with null or
repeated ids take part like any other; a component's id is its smallest non-null
id (null if there is none). Rows are told apart by id and text. Ids must be
integers. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.cache import Memo, only, tidied
from graphloom.llm.rows import ROW, boxed, quoted, unboxed
from graphloom.operators.components import connected_components
from graphloom.runtime import Scratch, ship_package

BITS = 56
#: Shingles of one block (a part of a task's texts) at most, besides one text's.
BLOCK = 1_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: A key with more than one in so many rows of a join is broadcast: there are fewer than so many of them.
HOT_SHARE = 1000
_EXCHANGE = "bucket int, block long, base long, width int, tok binary, own binary, freq binary, ids array<long>, meta binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    hashes = only(("words",), _word_memo)
    return np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def _word_memo() -> Memo:
    import xxhash

    return Memo(xxhash.xxh3_64_intdigest)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = word_hashes(words)
    size = min(n, len(words))
    s = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        s = _mix(s * _M1 + h[k : len(words) - size + 1 + k])
    return np.unique(s >> np.uint64(64 - BITS))


def need(n: int, percent: int) -> int:
    """Shingles that a text with n has in common with any partner, at least."""
    return -(-percent * n // 100)


def orders(tokens: np.ndarray, levels: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``tokens`` from rare to frequent, and their first ``size`` by either hash."""
    by_hash = lambda odd: tokens[np.argsort(_mix(tokens * odd))[:size]]
    return tokens[np.lexsort((tokens, levels))], by_hash(_M1), by_hash(_M3)


def _pack(sorted_tokens: np.ndarray) -> tuple[int, int, bytes]:
    """Base, bytes for each step, and the packed steps of an ascending array."""
    steps = np.diff(sorted_tokens)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return int(sorted_tokens[0]), width, steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(base: int, width: int, packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, dtype=np.uint8).reshape(-1, width)
    steps = np.zeros((len(raw), 8), dtype=np.uint8)
    steps[:, :width] = raw
    out = np.empty(len(raw) + 1, dtype=np.uint64)
    out[0] = base
    out[1:] = steps.view(np.uint64).ravel()
    return np.cumsum(out, dtype=np.uint64)


def _exchange_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
    names = [x.split()[0] for x in _EXCHANGE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _in_batches(rows, limit: int = 8 << 20):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(x) for x in row if isinstance(x, bytes)) + 8 * len(row[7] or ())
        if size >= limit:
            yield _exchange_batch(held)
            held, size = [], 0
    if held:
        yield _exchange_batch(held)


def _shingle(n: int, buckets: int):
    """Texts to packed shingles by bucket, and one row with what is known of each text of a block."""
    import xxhash

    edges = np.array([-(-(k << BITS) // buckets) for k in range(1, buckets)], dtype=np.uint64)

    def block_rows(block: int, ids: list, sets: list[np.ndarray], meta: list[tuple[int, int, int, int]]):
        home = block % buckets
        yield (home, block, 0, 0, None, None, None, ids, np.array(meta, dtype=np.int64).tobytes())
        tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owners = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
        order = np.argsort(tokens)
        tokens, owners = tokens[order], owners[order]
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.empty(0, np.int64)
        runs = np.diff(np.append(first, len(tokens)))
        # A shingle that several texts of the block hold goes to its bucket once, with their number.
        many = np.repeat(runs > 1, runs)
        if many.any():
            yield (home, block, *_pack(tokens[many]), owners[many].tobytes(), None, None, None)
        for part, notes, column in ((tokens[~many], owners[~many], 0), (tokens[first[runs > 1]], runs[runs > 1].astype(np.uint32), 1)):
            cuts = [0, *np.searchsorted(part, edges).tolist(), len(part)]
            for bucket, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if a < b:
                    note = notes[a:b].tobytes()
                    yield (bucket, block, *_pack(part[a:b]), *((note, b"") if column == 0 else (None, note)), None, None)

    def rows(batches):
        from pyspark import TaskContext

        block, seq = TaskContext.get().partitionId() << 24, 0
        ids, sets, meta, size, seen = [], [], [], 0, set()
        for batch in batches:
            for doc_id, text, sig in zip(batch.column("doc_id"), batch.column("text"), batch.column("sig").to_pylist(), strict=True):
                s = shingle_set(text.as_py(), n)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                h1, h2 = np.frombuffer(digest, dtype=np.int64).tolist()
                ids.append(doc_id.as_py())
                meta.append((sig, len(s), h1, h2))
                sets.append(s if digest not in seen else s[:0])  # equal sets of a block send their shingles once
                seen.add(digest)
                size += len(sets[-1])
                if size >= BLOCK or len(ids) == 65_535:
                    yield from block_rows(block + seq, ids, sets, meta)
                    seq += 1
                    ids, sets, meta, size, seen = [], [], [], 0, set()
        if ids:
            yield from block_rows(block + seq, ids, sets, meta)

    return lambda batches: _in_batches(rows(batches))


def _count(several: bool):
    """Of each bucket the document frequencies of its shingles, answered to each block for shared ones.

    Rows with ``freq`` are questions: with owners, of shingles that one text of
    the block holds; without, of those that ``freq`` many hold. Others pass. With
    ``several`` buckets in a task their rows come one bucket after another.
    """

    def rows(batches):
        asked, parts, weights, bucket = [], [], [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["freq"] is None:
                    yield tuple(r.values())
                    continue
                if several and r["bucket"] != bucket:
                    yield from answers(asked, parts, weights)
                    asked, parts, weights, bucket = [], [], [], r["bucket"]
                tokens = _unpack(r["base"] & (1 << 64) - 1, r["width"], r["tok"])
                parts.append(tokens)
                asked.append((r["bucket"], r["block"], None if r["own"] is None else np.frombuffer(r["own"], np.uint16)))
                weights.append(np.ones(len(tokens), np.int64) if r["own"] is not None else np.frombuffer(r["freq"], np.uint32).astype(np.int64))
        yield from answers(asked, parts, weights)

    def answers(asked, parts, weights):
        if not parts:
            return
        tokens, weights = np.concatenate(parts), np.concatenate(weights)
        ends = np.cumsum([0, *map(len, parts)])
        parts.clear()
        order = np.argsort(tokens, kind="stable")
        ordered = tokens[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        total = np.add.reduceat(weights[order], first)
        frequency = np.empty(len(tokens), dtype=np.int64)
        frequency[order] = np.repeat(total, np.diff(np.append(first, len(ordered))))
        for (bucket, block, owners), a, b in zip(asked, ends[:-1], ends[1:], strict=True):
            shared = frequency[a:b] > 1
            if shared.any():
                # Steps of an eighth of a power of two are fine enough to order by.
                level = np.minimum(255, np.log2(frequency[a:b][shared]) * 8).astype(np.uint8)
                yield (bucket, block, *_pack(tokens[a:b][shared]), None if owners is None else owners[shared].tobytes(), level.tobytes(), None, None)

    return lambda batches: _in_batches(rows(batches))


_TEXTS = "kind int, doc_id long, sig long, n long, h1 long, h2 long, toks array<long>, prefix int, second array<long>, third array<long>"


def _assemble(percent: int, several: bool):
    """Blocks put together again: every text (kind 0), and those that may have a partner (kind 1).

    With ``several``, a task's rows come one block after another.
    """
    names = [x.split()[0] for x in _TEXTS.split(", ")]
    longs = pa.list_(pa.int64())

    def levelled(held, answers):
        """(shingles, owners, levels) of what several texts hold, from the block's own list and the answers."""
        tokens, owners = held
        known, levels = (np.concatenate(x) for x in zip(*answers, strict=True))
        order = np.argsort(known)
        return tokens, owners, levels[order][np.searchsorted(known[order], tokens)]

    def one(table, answers):
        ids, meta = table
        meta = np.frombuffer(meta, dtype=np.int64).reshape(-1, 4)
        sizes = meta[:, 1]
        none = pa.nulls(len(ids), longs)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), pa.array(ids, pa.int64()), *(pa.array(meta[:, k].copy()) for k in range(4)), none, pa.nulls(len(ids), pa.int32()), none, none], names=names)
        if not answers:
            return
        tokens, owners, levels = (np.concatenate(x) for x in zip(*answers, strict=True))
        shared = np.bincount(owners, minlength=len(ids))
        needed = -(-percent * sizes // 100)
        able = (shared >= needed) & (shared > 0)
        keep = able[owners]
        tokens, owners, levels = tokens[keep], owners[keep], levels[keep]
        order = np.argsort(owners, kind="stable")
        tokens, owners, levels = tokens[order], owners[order], levels[order]
        who = np.flatnonzero(able)
        starts, stops = np.searchsorted(owners, who), np.searchsorted(owners, who, side="right")
        prefix = (sizes - needed + 1 - (sizes - shared))[who]
        for at in range(0, len(who), 2000):
            part, cut = who[at : at + 2000], slice(at, at + 2000)
            lists = zip(*([x.astype(np.int64) for x in orders(tokens[a:b], levels[a:b], p)] for a, b, p in zip(starts[cut], stops[cut], prefix[cut], strict=True)), strict=True)
            toks, second, third = (pa.array(x, longs) for x in lists)
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(part), np.int32)), none, none, *(pa.array(meta[part, k].copy()) for k in range(1, 4)), toks, pa.array(prefix[cut].astype(np.int32)), second, third], names=names)

    def run(batches):
        tables, held, single, shared, current = {}, {}, {}, {}, None
        for batch in batches:
            for r in batch.to_pylist():
                block = r["block"]
                if several and block != current:
                    yield from finished(tables, held, single, shared)
                    current = block
                if r["tok"] is None:
                    tables[block] = (r["ids"], r["meta"])
                    continue
                tokens = _unpack(r["base"] & (1 << 64) - 1, r["width"], r["tok"])
                own, freq = (None if r[c] is None else np.frombuffer(r[c], t) for c, t in (("own", np.uint16), ("freq", np.uint8)))
                if freq is None:
                    held[block] = (tokens, own)
                elif own is None:
                    shared.setdefault(block, []).append((tokens, freq))
                else:
                    single.setdefault(block, []).append((tokens, own, freq))
        yield from finished(tables, held, single, shared)

    def finished(tables, held, single, shared):
        for block in sorted(tables):
            answers = single.pop(block, [])
            if block in held:
                answers.append(levelled(held.pop(block), shared.pop(block)))
            yield from one(tables.pop(block), answers)

    return run


def _verify(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of class numbers, those that link, as edges (src, dst)."""
    side = lambda x: classes.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), F.col("toks").alias(f"t{x}"), F.col("prefix").alias(f"p{x}"), F.col("second").alias(f"s{x}"), F.col("third").alias(f"u{x}"))
    first = F.arrays_overlap(F.slice("ta", F.lit(1), F.col("pa")), F.slice("tb", F.lit(1), F.col("pb")))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(first & F.arrays_overlap("sa", "sb") & F.arrays_overlap("ua", "ub"))
    common = F.size(F.array_intersect("ta", "tb"))
    return both.where(common * 100 >= (F.col("na") + F.col("nb") - common) * percent).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def near_duplicates(df: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 6 << 20, cluster_size: int = 20_000, max_partitions: int = 20_000) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``df``.

    ``bucket_bytes``: of text for each bucket of the hash space.
    ``cluster_size``: candidate clusters of more classes are compared by groups.
    ``max_partitions``: of the exchange of shingles, however many buckets there are.
    """
    found = _components(df, n, percent, id_col, text_col, bucket_bytes, cluster_size, max_partitions)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("lead.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _components(df: DataFrame, n: int, percent: int, id_col: str, text_col: str, bucket_bytes: int = 6 << 20, cluster_size: int = 20_000, max_partitions: int = 20_000) -> DataFrame:
    """doc_id, sig (a hash of the text), n (shingles) and lead of every row of ``df``.

    lead is (doc_id, sig) of the first row, by id and then sig, of those that are
    linked; null ids come last. It is null for texts without shingles.
    """
    spark = df.sparkSession
    ship_package(spark)
    scratch, kept = Scratch(spark, "ngram_join"), Scratch(spark, "ngram_join_result")
    try:
        text = F.col(quoted(text_col))
        docs = df.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("sig"))
        total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
        buckets = max(8, -(-total // bucket_bytes))
        partitions = min(buckets, max_partitions)
        several = partitions < buckets
        ordered = lambda rows, key: rows.sortWithinPartitions(key) if several else rows

        # Neighbouring buckets go to one partition, so that sorting within it brings them one after another.
        place = F.floor(F.col("bucket") * F.lit(partitions) / F.lit(buckets)).cast("int") if several else F.col("bucket")
        sent = docs.mapInArrow(tidied(_shingle(n, buckets)), _EXCHANGE).repartitionById(partitions, place)
        answered = ordered(sent, "bucket").mapInArrow(tidied(_count(several)), _EXCHANGE).repartition(partitions, "block")
        made = ordered(answered, "block").mapInArrow(tidied(_assemble(percent, several)), _TEXTS)
        whole = spark.read.schema(_TEXTS).parquet(scratch.write(made, "texts", partition_by="kind"))
        texts = whole.where("kind = 0").select("doc_id", "sig", "n", "h1", "h2")

        able = whole.where("kind = 1").groupBy("h1", "h2").agg(F.first(F.struct("n", "toks", "prefix", "second", "third")).alias("c"))
        classes = scratch.table(able.select(F.monotonically_increasing_id().alias("k"), "h1", "h2", "c.*"), "classes")
        links = _links(classes, scratch, percent, cluster_size)
        named = classes.select("h1", "h2", "k").join(links, F.col("k") == F.col("id"), "left").select("h1", "h2", F.coalesce("component", "k").alias("root"))

        # Equal sets first, then what their classes link to.
        first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "sig")
        sets = texts.where("n > 0").groupBy("h1", "h2").agg(F.min(first).alias("least"), F.count(F.lit(1)).alias("c")).join(named, ["h1", "h2"], "left")
        sets = scratch.table(sets, "sets")
        alone, linked = sets.where("root is null"), sets.where("root is not null")
        of_root = scratch.table(linked.groupBy("root").agg(F.min("least").alias("lead"), F.count(F.lit(1)).alias("of")), "roots")
        lead = _join_hot(linked.select("h1", "h2", "c", "root"), of_root, ["root"])
        leads = alone.select("h1", "h2", F.col("c").alias("of"), F.col("least").alias("lead")).union(lead.select("h1", "h2", "c", "lead"))
        rows = _join_hot(texts.where("n > 0"), scratch.table(leads, "leads"), ["h1", "h2"])
        none = texts.where("n = 0").select("doc_id", "sig", "n", F.lit(None).cast("struct<doc_id:bigint,sig:bigint>").alias("lead"))
        return kept.table(rows.select("doc_id", "sig", "n", F.struct("lead.doc_id", "lead.sig").alias("lead")).union(none), "out")
    finally:
        scratch.close()


def _join_hot(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with what is ``known`` of their keys; its column ``of`` is the number of rows with a key.

    Keys with more than one in ``HOT_SHARE`` of the rows are fewer than that
    and broadcast; the others are joined by a shuffle, which they cannot tilt.
    """
    total = known.agg(F.sum("of").alias("n")).first().n or 0
    hot = F.broadcast(known.where(F.col("of") * HOT_SHARE > total).drop("of"))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(known.where(F.col("of") * HOT_SHARE <= total).drop("of").hint("merge"), keys)
    return rows.join(hot, keys).unionByName(rest)


def _links(classes: DataFrame, scratch: Scratch, percent: int, cluster_size: int) -> DataFrame:
    """(id, component) of the classes that have links."""
    # Leaders are texts with few shingles of their own; the class number breaks ties.
    own = ((F.col("n") - F.size("toks")) * 1000 / F.col("n")).cast("int")
    rows = classes.select("k", "n", own.alias("own"), F.explode(F.slice("toks", F.lit(1), F.col("prefix"))).alias("token"))
    held = rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("k").bitwiseAND(F.lit((1 << 40) - 1))).alias("s"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.min(F.struct("own", "k", "n")).alias("lead")
    ).where("c > 1")
    # Tokens with the same members are one group. A member that shares w tokens with a leader has weight w there.
    found = rows.join(held, "token").groupBy(F.xxhash64("c", "s", "lo", "hi").alias("g"), "k", "n", "lead").agg(F.count(F.lit(1)).alias("w"))
    groups = scratch.table(found.select("g", "k", "n", F.col("lead.k").alias("lead"), F.col("lead.n").alias("lead_n"), "w"), "groups")

    # Each class against the leader it shares most with; leaders precede their members, so parents make a forest.
    fits = F.least("n", "lead_n") * 100 >= F.greatest("n", "lead_n") * percent
    shared = groups.where((F.col("k") != F.col("lead")) & fits).groupBy("k", "lead").agg(F.sum("w").alias("w"))
    pairs = scratch.table(shared.groupBy("k").agg(F.max_by("lead", F.struct("w", "lead")).alias("a")).select("a", F.col("k").alias("b")), "pairs")
    stars = scratch.table(_verify(pairs, classes, percent), "stars")
    up = lambda name: stars.select(F.col("dst").alias(name), F.col("src").alias(f"{name}_up"))
    parent = stars.select(F.col("dst").alias("k"), F.col("src").alias("p1")).join(up("p1"), "p1", "left").select("k", F.coalesce("p1_up", "p1").alias("p2")).join(up("p2"), "p2", "left").select("k", F.coalesce("p2_up", "p2").alias("root"))

    # Pairs that may still link are inside one candidate cluster, or one group of a cluster that is too large.
    cluster = connected_components(groups.where("k <> lead").select(F.col("k").alias("src"), F.col("lead").alias("dst")).distinct(), scratch)
    member = scratch.table(cluster.select(F.col("id").alias("k"), "component").join(parent, "k", "left").select("k", "component", F.coalesce("root", "k").alias("root")), "members")
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    small = member.join(sizes.where(F.col("size") <= cluster_size), "component").select(F.col("component").alias("unit"), F.lit(False).alias("part"), "k", "root")
    large = member.join(sizes.where(F.col("size") > cluster_size), "component").join(groups.select("g", "k"), "k").select(F.col("g").alias("unit"), F.lit(True).alias("part"), "k", "root")
    more = _compare_units(scratch.table(small.union(large), "units"), classes, scratch, percent)
    return connected_components(stars.union(more), scratch)


def _compare_units(units: DataFrame, classes: DataFrame, scratch: Scratch, percent: int, block: int = 256) -> DataFrame:
    """Links (src, dst) between classes of one unit that have different roots.

    A unit's largest root is its major one. Minor classes are held against each
    other and against the major ones, in blocks of about ``block`` classes of
    either side; the major ones are one component already and never meet.
    """
    key = ["unit", "part"]
    roots = units.groupBy(*key, "root").agg(F.count(F.lit(1)).alias("c"))
    counts = roots.groupBy(*key).agg(F.max_by("root", F.struct("c", "root")).alias("top"), F.max("c").alias("majors"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("n_roots")).where("n_roots > 1")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    open_ = units.join(counts, key).select(*key, "k", "root", (F.col("root") == F.col("top")).alias("major"), blocks(F.col("majors")).alias("bm"), blocks(F.col("size") - F.col("majors")).alias("bn"))
    own = F.pmod(F.xxhash64("k"), F.when(F.col("major"), F.col("bm")).otherwise(F.col("bn"))).cast("int")
    place = lambda meets, i, j, side: F.struct(F.lit(meets).alias("meets"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    to_minor = F.transform(every(F.col("bn")), lambda x: place(True, x, F.col("own"), F.lit(1)))
    to_major = F.transform(every(F.col("bm")), lambda x: place(True, F.col("own"), x, F.lit(0)))
    among = F.transform(every(F.col("bn")), lambda x: place(False, F.least(x, F.col("own")), F.greatest(x, F.col("own")), (x < F.col("own"))))
    sent = open_.withColumn("own", own).select(*key, "k", "root", F.explode(F.when(F.col("major"), to_minor).otherwise(F.concat(to_major, among))).alias("at")).select(*key, "at.*", "k", "root")
    full = sent.join(classes.select("k", "n", "toks", "prefix", "second", "third"), "k")
    return full.groupBy(*key, "meets", "i", "j").applyInArrow(_compare_blocks(percent), "src long, dst long").distinct()


class _Index:
    """Which of some lists hold a token."""

    def __init__(self, lists: list[np.ndarray]):
        self.n = len(lists)
        owners = np.repeat(np.arange(self.n), [len(x) for x in lists])
        tokens = np.concatenate(lists) if lists else np.empty(0, np.int64)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owners = tokens[order], owners[order]

    def shared(self, tokens: np.ndarray) -> np.ndarray:
        """For each list, how many of ``tokens`` it holds."""
        lo = np.searchsorted(self.tokens, tokens, "left")
        runs = np.searchsorted(self.tokens, tokens, "right") - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum())
        return np.bincount(self.owners[at], minlength=self.n)


def _compare_blocks(percent: int):
    def run(table: pa.Table) -> pa.Table:
        k, root, n, side, prefix = (table.column(c).to_numpy() for c in ("k", "root", "n", "side", "prefix"))
        lists = lambda c: [np.asarray(v.values) for v in table.column(c).combine_chunks()]
        toks = lists("toks")
        prefixes = [t[:p] for t, p in zip(toks, prefix, strict=True)], lists("second"), lists("third")
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        if not table.column("meets")[0].as_py() and table.column("i")[0] == table.column("j")[0]:
            right = left
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        src, dst = [], []
        if len(left) and len(right):
            indexes = [_Index([lists_[r] for r in right]) for lists_ in prefixes]
            for a in left:
                able = (root[right] != root[a]) & (np.minimum(n[right], n[a]) * 100 >= np.maximum(n[right], n[a]) * percent)
                if not able.any():
                    continue
                for index, lists_ in zip(indexes, prefixes, strict=True):
                    if able.any():
                        able &= index.shared(lists_[a]) > 0
                for b in right[able]:
                    x, y = find(int(root[a])), find(int(root[b]))
                    if x == y:
                        continue
                    common = len(np.intersect1d(toks[a], toks[b], assume_unique=True))
                    if 100 * common >= percent * (int(n[a]) + int(n[b]) - common):
                        parent[max(x, y)] = min(x, y)
                        src.append(int(k[a]))
                        dst.append(int(k[b]))
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def keep_one(df: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` of which one of each group of near copies stays: that with the smallest id.

    Rows are told apart by id and text, so repeated ids with different texts are
    different rows, and of rows with one id and one text any one stays. Null ids
    come last. Texts without words are no copies of each other and all stay.
    """
    found = _components(df, n, percent, id_col, text_col)
    first = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("sig") == F.col("lead.sig"))
    stay = found.where(F.col("lead").isNull() | first).groupBy("doc_id", "sig").agg(((F.count(F.lit(1)) > 1) & (F.max("n") > 0)).alias("again"))
    text = F.col(quoted(text_col))
    rows = boxed(df, F.col(quoted(id_col)).cast("long").alias("id"), F.xxhash64(text).alias("hash"))
    # The ids grow with the table: they are never broadcast, so that small tables run as large ones do.
    joined = rows.join(stay.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("sig")))
    repeated = joined.where("again").groupBy("id", "hash").agg(F.first(ROW).alias(ROW))
    return unboxed(joined.where("not again").select(ROW).union(repeated.select(ROW)))
