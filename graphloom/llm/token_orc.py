"""Token ids as ORC files: run-length encoded integers in indexed, Bloom-filtered stripes.

``write_token_orc`` encodes texts, appends an end id and writes rows in
ascending document order: documents are dealt out by ranges of (id, hash of the
text), so file k holds only ids up to those of file k + 1, and each task sorts,
encodes and writes its own range. A file holds about ``file_bytes`` of text (or
less, down to ``least_bytes``, where there would be fewer files than cores). ORC's integer columns are run-length and
bit-packed; every stripe has a row index, and the id column a Bloom filter, so
that a lookup of ids reads only the stripes and row groups that may hold them.
``pos`` is the row's place: the number of the file in its high bits, the row in
the file below.

``read_token_orc`` reads them back (stripes in parallel), ``find_documents``
with the ids pushed down, ``token_layout`` with each document's start in the
whole stream: running sums within each file plus one total for each file.

Null ids come first. Null and empty texts hold the end id only. Rows with equal
ids stay in one order (by the text's hash) and are all written. An empty table
gives an empty folder with the schema. Other columns are not written.
"""

from __future__ import annotations

import os
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.cache import only, tidied
from graphloom.llm.rows import quoted
from graphloom.llm.words import HELD, Recent, encode_texts
from graphloom.runtime import Scratch, delete_path, scratch_path, ship_package

SCHEMA = "doc_id long, pos long, ids array<int>"
#: Texts whose words are told apart together: more take memory, fewer take calls of the library.
GROUP_BYTES = 12 << 20


class LibraryEncoder:
    """Ids by the ``tokenizers`` library, called once for each distinct word of a group of texts that is not held from the groups before."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)  # a character stands for a byte
        self.recent = Recent(self.words, HELD)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words in one go: a word's ids end where the bytes of the tokens so far are as many as those of the words and spaces so far."""
        ids = self.whole([" " + " ".join(words)])[0]
        bytes_of = pc.binary_length(pa.array(words, pa.string())).to_numpy().astype(np.int64)
        ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(bytes_of + 1)) + 1
        return ids, np.diff(ends, prepend=0)

    def batches(self, texts: pa.Array | list[str | None], end_id: int):
        return encode_texts(texts, self.special, self.recent, self.whole, (end_id,), GROUP_BYTES, sys.maxsize)


def encoder(path: str) -> LibraryEncoder:
    """One encoder for each file and Python worker."""
    return only(("library", path), lambda: LibraryEncoder(path))


def write_token_orc(df: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, file_bytes: int = 64 << 20, least_bytes: int = 8 << 20, stripe_bytes: int = 16 << 20, rows_per_group: int = 1000) -> None:
    """Write ``df``'s texts as ids, in ascending order of ``id_col``."""
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    files = max(1, -(-total // file_bytes), min(spark.sparkContext.defaultParallelism, -(-total // least_bytes)))

    def run(batches):
        for batch in batches:
            at = 0
            for n, ends, ids in encoder(tokenizer_path).batches(batch.column("text"), end_id):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["doc_id", "ids"])
                at += n

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    made = dealt.mapInArrow(tidied(run), "doc_id long, ids array<int>").select("doc_id", F.monotonically_increasing_id().alias("pos"), "ids")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(stripe_bytes), "orc.create.index": "true", "orc.row.index.stride": str(rows_per_group), "compression": "lz4"}
    made.write.mode("overwrite").format("orc").options(**options).save(path)


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def find_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of some documents; the predicate reaches the stripes' Bloom filters."""
    return read_token_orc(spark, path).where(F.col("doc_id").isin(ids))


def token_layout(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    ship_package(spark)

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            ends = ids.offsets.to_numpy()
            values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("pos"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "pos", "n_tokens", "ids_crc32"])

    narrow = read_token_orc(spark, path).mapInArrow(run, "doc_id long, pos long, n_tokens long, ids_crc32 long")
    rows = Scratch(spark, "token_layout").table(narrow, "rows").withColumn("file", F.shiftright("pos", 33))
    # One row for each file, so the window over all of them stays small.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    offsets = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    started = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return started.join(offsets, "file").select("doc_id", (F.col("offset") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def token_digests(df: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write ``df``'s ids to the shared folder, read them back, and return their layout."""
    spark = df.sparkSession
    path = scratch_path(spark, "token_orc")
    try:
        write_token_orc(df, path, tokenizer_path, end_id=end_id)
        return token_layout(spark, path)  # written, so it does not need the files any more
    finally:
        delete_path(spark, path)
