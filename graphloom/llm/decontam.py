"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Words are runs of characters other than ASCII separators, with A-Z lower-cased;
items (questions, answers) and documents are normalised alike, as UTF-8 bytes.
Every window of ``window`` consecutive item words is a pattern, a shorter item
is one window. Each text is scanned once; matches are stretches of words and,
for ``contaminated_spans``, character offsets of the original text.

The automaton runs over 64-bit hashes of words and is kept as flat arrays, about
21 bytes a word of the items. Its trie holds what follows each word of an item,
up to ``window`` words, and is implicit in the sorted order of these: a state is
a range of that order and a depth. The state to fall back to needs no table: if
the text matches what follows an item's word, its end matches what follows the
next word, one word shorter. Most stretches of a text never reach the automaton:
two neighbouring words that are neighbours in no item end every match, and a bit
table of such pairs finds the stretches between.

The arrays are written to one file of the shared folder, handed to each executor
once, and opened there memory-mapped by all its workers, so one automaton and one
scan do for a benchmark of any size. Building it takes the driver some ten times
the file's size, so the benchmark must be far smaller than the corpus.

Null, empty and wordless texts have no words and no hits; items without words
have no windows. Items are told apart by their ids: equal ids are one item, and
those without an id count as one that is not named. Rows are mapped one to one;
a word inside several windows counts once. Columns that clash with the output
names are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.cache import Memo, only, tidied
from graphloom.llm.rows import ROW, boxed, own, quoted
from graphloom.runtime import scratch_path, ship_package, write_bytes

# Every ASCII byte but digits and letters separates words; A-Z become a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
# Words of a text before A-Z are lower-cased.
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the pair table for each pair of the items, so about one pair in sixteen passes by chance.
PAIR_BITS = 16


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def _word_memo() -> Memo:
    import xxhash

    return Memo(xxhash.xxh3_64_intdigest)


def _pairs(words: np.ndarray, bits: int) -> np.ndarray:
    """The place in a table of 2^bits of each two neighbouring words."""
    x = (words[:-1] * _ODD) ^ words[1:]
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def _dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones, from 1."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64) + 1


class ItemAutomaton:
    """Aho-Corasick over word hashes, in flat arrays.

    ``words``: the items' words, one item after another; ``left``: words from
    each place to its item's end; ``owner``: the item of each place; ``order``:
    all places, sorted by the ``window`` words that follow (fewer at an item's
    end, which sorts first); ``table``: the bits of neighbouring pairs.
    """

    FIELDS = (("words", np.uint64), ("order", np.int64), ("left", np.int32), ("owner", np.int32), ("short", np.int32), ("table", np.uint8))

    def __init__(self, arrays: dict[str, np.ndarray], window: int):
        self.window = window
        for name, _ in self.FIELDS:
            setattr(self, name, arrays[name])
        self.bits = int(len(self.table) * 8).bit_length() - 1
        self.empty = not len(self.words)
        # Items that are one short window each, by their words.
        self.whole: dict[tuple, list[int]] = {}
        for at in self.short.tolist():
            n = int(self.left[at])
            self.whole.setdefault(tuple(self.words[at : at + n].tolist()), []).append(int(self.owner[at]))
        if window == 1:
            for w, k in sorted(set(zip(self.words.tolist(), self.owner.tolist(), strict=True))):
                self.whole.setdefault((w,), []).append(k)
        lengths = {len(w) for w in self.whole}
        self.singles = np.array(sorted(w[0] for w in self.whole if len(w) == 1), dtype=np.uint64)
        self.short_lengths = sorted(lengths - {1})
        full = window > 1 and bool((self.left >= window).any())
        self.least = min([*self.short_lengths, *([window] if full else [])], default=0)
        self.hashes = _word_memo()
        self.seen: dict[bytes, list] = {}

    @classmethod
    def build(cls, texts, window: int) -> ItemAutomaton:
        hashes, parts = _word_memo(), []
        for text in texts:
            parts.append(np.fromiter(map(hashes.__getitem__, words_of(text or "")), dtype=np.uint64))
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        words = np.concatenate([*parts, np.empty(0, np.uint64)])
        ends = np.repeat(np.cumsum(sizes), sizes)
        left = (ends - np.arange(len(words))).astype(np.int32)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        firsts = (np.cumsum(sizes) - sizes)[(sizes > 0) & (sizes < window)].astype(np.int32)
        inner = left[:-1] > 1
        n_pairs = int(inner.sum())
        bits = max(10, int(n_pairs * PAIR_BITS - 1).bit_length())
        table = np.zeros(1 << bits >> 3, dtype=np.uint8)
        if n_pairs:
            at = _pairs(words, bits)[inner]
            np.bitwise_or.at(table, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        order = np.argsort(cls._ranks(words, left, window), kind="stable").astype(np.int64)
        return cls({"words": words, "order": order, "left": left, "owner": owner, "short": firsts, "table": table}, window)

    @staticmethod
    def _ranks(words: np.ndarray, left: np.ndarray, window: int) -> np.ndarray:
        """The rank of the ``window`` words from each place, by doubling."""

        def further(ranks: np.ndarray, by: int) -> np.ndarray:
            out = np.zeros(len(ranks), dtype=np.int64)
            at = np.flatnonzero(left > by)
            out[at] = ranks[at + by]
            return out

        if not len(words):
            return np.empty(0, np.int64)
        now, length, out, covered = _dense(words), 1, None, 0
        join = lambda a, b: _dense(a * (int(b.max()) + 1) + b)
        while window > 0:
            if window & 1:
                out = now if out is None else join(out, further(now, covered))
                covered += length
            window >>= 1
            if window:
                now, length = join(now, further(now, length)), length * 2
        return out

    def to_bytes(self) -> bytes:
        arrays = [np.ascontiguousarray(getattr(self, name), dtype=kind) for name, kind in self.FIELDS]
        head = np.array([self.window, *(len(a) for a in arrays)], dtype=np.int64).tobytes()
        return b"".join([head, *(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)])

    @classmethod
    def open(cls, path: str) -> ItemAutomaton:
        """From a file, memory-mapped."""
        data = np.memmap(path, dtype=np.uint8, mode="r")
        head = data[: 8 * (len(cls.FIELDS) + 1)].view(np.int64)
        arrays, at = {}, 8 * len(head)
        for (name, kind), n in zip(cls.FIELDS, head[1:].tolist(), strict=True):
            size = n * np.dtype(kind).itemsize
            arrays[name] = data[at : at + size].view(kind)
            at += size + -size % 8
        return cls(arrays, int(head[0]))

    def _step(self, lo: int, hi: int, depth: int, word: int) -> tuple[int, int]:
        """The part of a state's range in which ``word`` follows."""
        order, left, words = self.order, self.left, self.words

        def following(k: int) -> int:
            at = order[k]
            return int(words[at + depth]) if left[at] > depth else -1

        span = range(lo, hi)
        a = bisect_left(span, word, key=following)
        return lo + a, lo + bisect_right(span, word, lo=a, key=following)

    def _state(self, at: int, depth: int) -> tuple[int, int]:
        """The range of what starts like the ``depth`` words from a place."""
        lo, hi = 0, len(self.order)
        for k in range(depth):
            lo, hi = self._step(lo, hi, k, int(self.words[at + k]))
        return lo, hi

    def _run(self, words: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """(from, to, items) of each window in a stretch of words."""
        key = words.tobytes() if len(words) <= 512 else None
        if key in self.seen:
            return self.seen[key]
        found = []
        lo, hi, depth = 0, len(self.order), 0
        text = words.tolist()
        for i, word in enumerate(text):
            while True:
                a, b = self._step(lo, hi, depth, word) if depth < self.window else (0, 0)
                if a < b:
                    lo, hi, depth = a, b, depth + 1
                    break
                if depth == 0:
                    break
                place = int(self.order[lo])
                depth -= 1
                lo, hi = self._state(place + 1, depth) if depth else (0, len(self.order))
            if depth == self.window:
                found.append((i + 1 - depth, i + 1, np.unique(self.owner[self.order[lo:hi]]).tolist()))
            for n in self.short_lengths:
                if n <= depth and (items := self.whole.get(tuple(text[i + 1 - n : i + 1]))):
                    found.append((i + 1 - n, i + 1, items))
        if key is not None:
            if len(self.seen) >= 10_000:
                self.seen.clear()
            self.seen[key] = found
        return found

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, hit stretches of words [from, to), numbers of the items found."""
        split = words_of(text)
        if self.empty or not split:
            return len(split), [], set()
        words = np.fromiter(map(self.hashes.__getitem__, split), dtype=np.uint64, count=len(split))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        if len(self.singles):
            for i in np.flatnonzero(np.isin(words, self.singles)).tolist():
                spans.append((i, i + 1))
                items.update(self.whole[(int(words[i]),)])
        if self.least and len(words) >= self.least:
            at = _pairs(words, self.bits)
            live = np.concatenate(([0], self.table[at >> 3] >> (at & 7).astype(np.uint8) & 1, [0]))
            turns = np.diff(live.astype(np.int8))
            starts, stops = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
            long = stops - starts >= self.least - 1
            for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
                for start, stop, found in self._run(words[a : b + 1]):
                    spans.append((a + start, a + stop))
                    items.update(found)
        return len(words), merge_spans(spans), items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def character_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of words as character offsets [from, to) of the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def share_automaton(spark: SparkSession, benchmark: DataFrame, id_col: str, text_col: str, window: int) -> tuple[str, str]:
    """Names of the two files, automaton and item ids, that every executor gets once."""
    items = benchmark.select(F.col(quoted(id_col)).cast("string").alias("id"), F.col(quoted(text_col)).alias("text")).where("text is not null")
    ids: list[str | None] = []

    def texts():
        for row in items.toLocalIterator():
            ids.append(row.id)
            yield row.text

    automaton = ItemAutomaton.build(texts(), window)
    sink = pa.BufferOutputStream()
    table = pa.table({"id": pa.array(ids, pa.string())})
    with pa.ipc.new_file(sink, table.schema) as writer:
        writer.write_table(table)
    names = []
    for kind, data in (("automaton", automaton.to_bytes()), ("items", sink.getvalue().to_pybytes())):
        path = scratch_path(spark, f"decontam-{kind}")
        write_bytes(spark, path, data)
        spark.sparkContext.addFile(path)
        names.append(path.rsplit("/", 1)[-1])
    return names[0], names[1]


def _opened(names: tuple[str, str]):
    from pyspark import SparkFiles

    def make():
        ids = pa.ipc.open_file(pa.memory_map(SparkFiles.get(names[1]))).read_all().column("id")
        return ItemAutomaton.open(SparkFiles.get(names[0])), ids

    return only(("automaton", names), make)


_FOUND = ("n_words", "spans", "item_ids")


def _scanned(table: DataFrame, benchmark: DataFrame, window: int, item_id_col: str, item_text_col: str, keep_text: bool) -> DataFrame:
    """``table`` (ROW, text) with n_words, spans (of word numbers) and item_ids, and the text if asked for."""
    ship_package(table.sparkSession)
    names = share_automaton(table.sparkSession, benchmark, item_id_col, item_text_col, window)
    kept = table.schema.names if keep_text else [ROW]
    schema = T.StructType([table.schema[c] for c in kept]).add("n_words", T.LongType()).add("spans", T.ArrayType(T.ArrayType(T.IntegerType()))).add("item_ids", T.ArrayType(T.StringType()))

    def run(batches):
        automaton, item_ids = _opened(names)
        for batch in batches:
            n_words, spans, ids = [], [], []
            for value in batch.column("text"):
                n, hit, found = automaton.scan(value.as_py() or "")
                named = {item_ids[k].as_py() for k in found}
                n_words.append(n)
                spans.append([list(s) for s in hit])
                ids.append(sorted(named - {None}) + ([None] if None in named else []))
            cols = [*(batch.column(c) for c in kept), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return table.mapInArrow(tidied(run), schema)


def find_contamination(df: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``df`` with n_words, spans (of word numbers) and item_ids (distinct, sorted as strings, null last)."""
    table = boxed(df, F.col(quoted(text_col)).alias("text"), but=_FOUND)
    return _scanned(table, benchmark, window, item_id_col, item_text_col, False).select(*own(df, *_FOUND), *_FOUND)


def contamination_report(df: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated in place of the text."""
    new = (text_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    table = boxed(df, F.col(quoted(text_col)).alias("text"), but=new)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s[1] - s[0]).cast("long"))
    return _scanned(table, benchmark, window, "item_id", "text", False).select(
        *own(df, *new),
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def contaminated_spans(df: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, item_ids and char_spans: character offsets [from, to) of what the benchmark also holds."""
    new = ("n_words", "item_ids", "char_spans")
    found = _scanned(boxed(df, F.col(quoted(text_col)).alias("text"), but=new), benchmark, window, "item_id", "text", True)
    kind = pa.list_(pa.list_(pa.int32()))
    schema = T.StructType([found.schema[c] for c in (ROW, "n_words", "item_ids")]).add("char_spans", T.ArrayType(T.ArrayType(T.IntegerType())))

    def run(batches):
        for batch in batches:
            got = [[list(s) for s in character_spans(text.as_py(), spans.as_py())] if len(spans) else [] for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), pa.array(got, kind)], names=schema.names)

    return found.mapInArrow(run, schema).select(*own(df, *new), *new)


def remove_contaminated(df: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without any window of the benchmark, with ``df``'s columns."""
    table = boxed(df, F.col(quoted(text_col)).alias("text"), but=(text_col,))
    clean = _scanned(table, benchmark, window, "item_id", "text", True).where(F.size("spans") == 0)
    return clean.select(*(F.col("text").alias(c) if c.lower() == text_col.lower() else F.col(f"{ROW}.{quoted(c)}").alias(c) for c in df.columns))
