"""Byte-level BPE by a segment tree over the ranks of adjacent pairs.

The leaves of the tree hold the merge rank of each adjacent pair (with its
place, so that equal ranks order from the left); every inner node holds the
smaller of its two children. The root is thus the leftmost lowest-rank merge.
A merge changes three leaves, each updated in logarithmic time, until the root
says that no pair can be merged.

Texts are split by the pre-tokenizer's pattern; merges never cross a piece, so
a piece is merged once and remembered in a memo of bounded size, as are the ids
of whole words. A piece may have any length. A special token's string inside a text becomes that token.

Null texts count as empty and give no ids. Rows are mapped one to one.
"""

from __future__ import annotations

import hashlib
import json
import sys
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.cache import Memo, only, tidied
from graphloom.llm.rows import ROW, boxed, own, quoted
from graphloom.llm.words import HELD, Recent, encode_texts
from graphloom.runtime import ship_package

# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = 1 << 100
#: Texts whose words are told apart together.
GROUP_BYTES = 3 << 20


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file.

    Bytes that print in Latin-1 stand for themselves; the others take the code
    points from 256 on, in order.
    """
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class MergeTree:
    """Merges the symbols of one piece.

    ``pairs`` maps a << 20 | b to rank << 20 | merged id. A leaf is that value
    with the pair's place in its low bits, so the root alone tells the rank,
    the merged symbol and where it goes.
    """

    def __init__(self, pairs: dict[int, int]):
        self.pairs = pairs

    def encode(self, ids: list[int]) -> list[int]:
        n = len(ids)
        if n < 2:
            return ids
        get = self.pairs.get
        shift = n.bit_length()
        size = 1 << (n - 2).bit_length()
        leaves = [_NONE] * size
        found, left = 0, ids[0]
        for i in range(1, n):
            right = ids[i]
            value = get(left << 20 | right)
            if value is not None:
                leaves[i - 1] = value << shift | (i - 1)
                found += 1
            left = right
        if not found:
            return ids
        levels, level = [], leaves
        while len(level) > 1:
            level = list(map(min, level[::2], level[1::2]))
            levels.append(level)
        tree = [_NONE]
        for level in reversed(levels):
            tree += level
        tree += leaves
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        mask = (1 << shift) - 1
        while (least := tree[1]) != _NONE:
            i = least & mask
            j = after[i]
            ids[i] = merged = least >> shift & 1048575
            ids[j] = -1
            k = after[i] = after[j]
            b = c = size + i
            if j < n - 1:
                c = size + j
                tree[c] = _NONE
            if k < n:
                before[k] = i
                value = get(merged << 20 | ids[k])
                tree[b] = _NONE if value is None else value << shift | i
            else:
                tree[b] = _NONE
            a = b
            h = before[i]
            if h >= 0:
                a = size + h
                value = get(ids[h] << 20 | merged)
                tree[a] = _NONE if value is None else value << shift | h
            # The three leaves' ancestors, level by level; where they are the same node it is done once.
            while a > 1:
                a >>= 1
                b >>= 1
                c >>= 1
                x, y = tree[a + a], tree[a + a + 1]
                tree[a] = x if x < y else y
                if b != a:
                    x, y = tree[b + b], tree[b + b + 1]
                    tree[b] = x if x < y else y
                if c != b:
                    x, y = tree[c + c], tree[c + c + 1]
                    tree[c] = x if x < y else y
        return [x for x in ids if x >= 0]


class ByteBpe:
    """Encoder and decoder of a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str, memo: int = 60_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        chars = byte_chars()
        self.byte_ids = [vocab[c] for c in chars]
        pairs = {vocab[a] << 20 | vocab[b]: r << 20 | vocab[a + b] for r, (a, b) in enumerate(merges)}
        self.tree = MergeTree(pairs)
        to_byte = {c: b for b, c in enumerate(chars)}
        bytes_of = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        bytes_of |= {i: t.encode() for t, i in self.special.items()}
        every = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.table = np.frombuffer(b"".join(every), dtype=np.uint8)
        self.sizes = np.array([len(x) for x in every])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PATTERN)
        self.piece = Memo(self._piece, memo)
        self.recent = Recent(self._words, HELD)

    def _piece(self, piece: str) -> bytes:
        """Packed ids (little-endian, unsigned, 32 bits)."""
        ids = self.tree.encode(list(map(self.byte_ids.__getitem__, piece.encode())))
        return pack(f"<{len(ids)}I", *ids)

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.pieces.findall(text)))

    def _whole(self, text: str) -> bytes:
        if self.at_special and any(s in text for s in self.special):
            return b"".join(pack("<I", self.special[p]) if p in self.special else self._pieces(p) for p in self.at_special.split(text) if p)
        return self._pieces(text)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        packed = [self._pieces(" " + w) for w in words]
        return np.frombuffer(b"".join(packed), dtype="<i4"), np.array([len(p) // 4 for p in packed], dtype=np.int64)

    def batches(self, texts: pa.Array | list[str | None]):
        """(number of texts, offsets, ids) of consecutive parts of ``texts``."""
        whole = lambda group: [np.frombuffer(self._whole(t), dtype="<i4") for t in group]
        return encode_texts(texts, list(self.special), self.recent, whole, (), GROUP_BYTES, sys.maxsize)

    def token_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens, gathered from one table."""
        sizes = self.sizes[ids]
        return self.table[np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]

    def decoded(self, ends: np.ndarray, ids: np.ndarray) -> list[str]:
        """The texts of ids [ends[k], ends[k + 1])."""
        data = self.token_bytes(ids).tobytes()
        cuts = np.concatenate(([0], np.cumsum(self.sizes[ids])))[ends].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, text: str) -> list[int]:
        return memoryview(self._whole(text)).cast("I").tolist()

    def decode(self, ids: list[int]) -> str:
        return self.token_bytes(np.asarray(ids, dtype=np.int64)).tobytes().decode("utf-8", "replace")


def codec(path: str) -> ByteBpe:
    """One codec for each file and Python worker."""
    return only(("bpe", path), lambda: ByteBpe(path))


def _mapped(df: DataFrame, tokenizer_path: str, text_col: str, out: list[T.StructField], make) -> DataFrame:
    """``df`` with columns of ``make(codec, texts, ends, ids)`` in place of the text."""
    ship_package(df.sparkSession)
    names = [f.name for f in out]
    table = boxed(df, F.col(quoted(text_col)).alias("text"), but=(text_col, *names))
    schema = T.StructType([table.schema[ROW], *out])

    def run(batches):
        bpe = codec(tokenizer_path)
        for batch in batches:
            texts, at = batch.column("text"), 0
            for n, ends, ids in bpe.batches(texts):
                cols = [batch.column(ROW).slice(at, n), *make(bpe, texts.slice(at, n), ends, ids)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
                at += n

    return table.mapInArrow(tidied(run), schema).select(*own(df, text_col, *names), *(F.col(quoted(c)) for c in names))


def _lists(ends: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))


def encode_column(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the text replaced by its token ids (an array of ints)."""
    out = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    return _mapped(df, tokenizer_path, text_col, out, lambda bpe, texts, ends, ids: [_lists(ends, ids)])


def decode_column(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``df`` with token ids (null: none) replaced by the text they stand for."""
    ship_package(df.sparkSession)
    table = boxed(df, F.col(quoted(ids_col)).alias("ids"), but=(text_col, ids_col))
    schema = T.StructType([table.schema[ROW]]).add("text", T.StringType())

    def run(batches):
        decode = codec(tokenizer_path).decode
        for batch in batches:
            texts = pa.array([decode(v.as_py() or []) for v in batch.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(ROW), texts], names=schema.names)

    return table.mapInArrow(tidied(run), schema).select(*own(df, text_col, ids_col), F.col("text").alias(text_col))


def round_trip_digests(df: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256 in place of the text.

    Each text is encoded and its ids decoded again; only digests leave the
    worker, so a row stays small however long its text.
    """
    out = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def make(bpe, texts, ends, ids):
        packed, cuts = ids.astype("<u4").tobytes(), (ends.astype(np.int64) * 4).tolist()
        of_ids = [hashlib.sha256(packed[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        of_texts = [hashlib.sha256(t.encode()).hexdigest() for t in bpe.decoded(ends, ids)]
        return [pa.array(np.diff(ends).astype(np.int64)), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())]

    return _mapped(df, tokenizer_path, text_col, out, make)


def encode_checked(df: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids and round_trip (the ids decode to the text) in place of the text."""
    out = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]

    def make(bpe, texts, ends, ids):
        same = [(t or "") == back for t, back in zip(texts.to_pylist(), bpe.decoded(ends, ids), strict=True)]
        return [pa.array(np.diff(ends).astype(np.int64)), _lists(ends, ids), pa.array(same, pa.bool_())]

    return _mapped(df, tokenizer_path, text_col, out, make)
