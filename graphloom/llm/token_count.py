"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a text form a doubly linked list; a heap holds the adjacent
pairs that the vocabulary can merge, lowest rank and then leftmost first. Each
pop merges a pair, and the count is the number of initial symbols less the
merges. No identifiers are made.

The vocabulary is a sentencepiece BPE model: the symbols are characters, spaces
are written as U+2581 with one in front of the text, and a character outside
the vocabulary counts as its UTF-8 bytes.

A text is counted in segments: a place whose two neighbouring characters occur
side by side in no vocabulary piece can never be merged over, so what stands on
either side is independent. Segments repeat, so their counts are remembered in
a memo of bounded size. Segments may have any length; merging is O(n log n).

Null texts count as empty: 0 bytes, 0 tokens. Rows are mapped one to one;
repeated rows and other columns are kept, columns that clash with the output
names are replaced.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.cache import Memo, only
from graphloom.llm.rows import ROW, boxed, own, quoted
from graphloom.runtime import ship_package

SPACE = "▁"


class PieceCounter:
    def __init__(self, path: str, memo: int = 200_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.rank[sp.id_to_piece(i)] = -sp.get_score(i)
        self.inner = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        # A space mark after another character starts a segment where no piece holds such a pair.
        self.split_at_space = not any(b[1] == SPACE and b[0] != SPACE for b in self.inner)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*")
        self.segments = Memo(self._segment, memo)
        self.atoms = Memo(self.merge, memo)

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        parts = self.cut.findall(marked) if self.split_at_space else [marked]
        return sum(map(self.segments.__getitem__, parts))

    def _segment(self, s: str) -> int:
        inner, at, n = self.inner, 0, 0
        for i in range(1, len(s)):
            if s[i - 1 : i + 1] not in inner:
                n += self.atoms[s[at:i]]
                at = i
        return n + self.atoms[s[at:]]

    def merge(self, s: str) -> int:
        """Tokens of one segment."""
        rank = self.rank
        if len(s) == 1:
            return 1 if s in rank else len(s.encode())
        if s in rank and len(s) == 2:
            return 1
        n = len(s)
        symbols: list[str | None] = list(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, s[i : i + 2]) for i in range(n - 1) if (r := rank.get(s[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges, pop, push = 0, heapq.heappop, heapq.heappush
        while heap:
            _, i, piece = pop(heap)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or len(left) + len(symbols[j]) != len(piece) or left + symbols[j] != piece:
                continue  # a neighbour has been merged since
            merges += 1
            symbols[i], symbols[j] = piece, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(made := piece + symbols[k])) is not None:
                    push(heap, (r, i, made))
            if (h := before[i]) >= 0 and (r := rank.get(made := symbols[h] + piece)) is not None:
                push(heap, (r, h, made))
        tokens = n - merges
        for c in symbols:
            if c is not None and len(c) == 1 and c not in rank:
                tokens += len(c.encode()) - 1
        return tokens


def counter(path: str) -> PieceCounter:
    """One counter for each model and Python worker."""
    return only(("pieces", path), lambda: PieceCounter(path))


def token_counts(df: DataFrame, model_path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit (n_tokens > limit) in place of the text."""
    ship_package(df.sparkSession)
    new = (text_col, "n_bytes", "n_tokens", "over_limit")
    kept = boxed(df, F.col(quoted(text_col)).alias("text"), but=new)
    schema = T.StructType([kept.schema[ROW]]).add("n_bytes", T.LongType()).add("n_tokens", T.LongType())

    def run(batches):
        count = counter(model_path).count
        for batch in batches:
            column = batch.column("text")
            n_bytes, n_tokens = [], []
            for value in column:  # one text at a time in memory besides the batch
                text = value.as_py() or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(count(text))
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=schema.names)

    return kept.mapInArrow(run, schema).select(*own(df, *new), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
