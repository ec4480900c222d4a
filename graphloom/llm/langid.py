"""Language identification by multilingual mixture inference.

A language is a distribution over byte n-grams (n = 1 to 3 over lower-cased
letters, other ASCII characters folded to one space, hashed to ``BUCKETS``
numbers). A text is a bag of n-grams drawn from a mixture of languages;
expectation-maximisation estimates the proportions. Nested sets of the largest
languages are then compared by log-likelihood less ``penalty`` times the
logarithm of the number of n-grams for each further language; the best set's
largest language is the prediction, its share of the whole mixture the score.

``fit`` counts over all labelled rows: each task sums its own rows, one row for
each language and bucket is shuffled, and the model is broadcast. Its size is
``4 * BUCKETS`` bytes for each language and does not grow with the rows; any
number of languages will do.

Expectation-maximisation runs until no proportion moves by ``TOLERANCE``; the
likelihood has one maximum, so that is only a matter of steps.

Null texts and texts without a letter (Unicode category L) are ``und`` with
score 0, as is every text where nothing was learned. Null labels are not learned from. Ties go to
the first language in alphabetical order. Rows are mapped one to one.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.rows import ROW, boxed, own, quoted
from graphloom.runtime import ship_package

BUCKETS = 1 << 14
UNKNOWN = "und"
#: Proportions that move by less than this are settled.
TOLERANCE = 1e-5
#: Labels whose counts a task holds at once.
HELD_LABELS = 64
_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_MANY = re.compile(rb"  +")
_PIECE = 1 << 20


def ngram_counts(text: str) -> np.ndarray:
    """How often each bucket occurs among the n-grams of a text, of any length."""
    data = _MANY.sub(b" ", b" " + text.lower().encode().translate(_FOLD) + b" ")
    out = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(data), _PIECE):
        b = np.frombuffer(data, dtype=np.uint8)[at : at + _PIECE + 2].astype(np.uint32)
        own = min(_PIECE, len(data) - at)
        two = b[:-1] * 257 + b[1:] + 256
        three = two[:-1] * 1031 + b[2:] * 7919 + 40503
        for grams in (b, two, three):
            mixed = grams[:own] * np.uint32(2654435761)
            out += np.bincount(mixed >> np.uint32(18), minlength=BUCKETS)
    return out


class MixtureModel:
    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.languages = languages
        sums = counts.sum(axis=1, keepdims=True)
        self.p = np.ascontiguousarray(((counts + smoothing) / (sums + smoothing * BUCKETS)).T.astype(np.float32))  # bucket x language

    @staticmethod
    def mixture(x: np.ndarray, c: np.ndarray, steps: float = math.inf) -> tuple[np.ndarray, float]:
        """Proportions of the columns of ``x`` and the log-likelihood of counts ``c``."""
        total, theta = c.sum(), np.full(x.shape[1], 1 / x.shape[1])
        moved = float(x.shape[1] > 1)
        while moved >= TOLERANCE and steps > 0:
            steps -= 1
            new = theta * ((c / (x @ theta)) @ x) / total
            moved = np.abs(new - theta).max()
            theta = new
        return theta, float(c @ np.log(x @ theta))

    def predict(self, text: str | None, penalty: float = 3.0) -> tuple[str, float, list[tuple[str, float]]]:
        """Language, score, and the chosen set with its proportions."""
        if text is None or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, []
        counts = ngram_counts(text)
        seen = np.flatnonzero(counts)
        x, c = self.p[seen].astype(float), counts[seen].astype(float)
        theta, full = self.mixture(x, c)
        price = penalty * math.log(c.sum() + 1)
        alone = c @ np.log(x)
        order = np.lexsort((np.arange(len(theta)), -theta))
        order = [int(np.argmax(alone)), *(int(k) for k in order if k != np.argmax(alone))]
        best, chosen, shares = float(alone[order[0]]), order[:1], np.ones(1)
        for n in range(2, len(order) + 1):
            if full - price * (n - 1) <= best:
                break  # no larger set can pay for its languages
            part, value = self.mixture(x[:, order[:n]], c)
            if value - price * (n - 1) > best:
                best, chosen, shares = value - price * (n - 1), order[:n], part
        found = sorted(((self.languages[k], float(s)) for k, s in zip(chosen, shares, strict=True)), key=lambda v: (-v[1], v[0]))
        score = min(1.0, max(0.0, float(theta[self.languages.index(found[0][0])])))
        return found[0][0], score, found


def fit(df: DataFrame, text_col: str = "text", label_col: str = "lang") -> MixtureModel:
    """The model of all rows of ``df`` with a text and a label."""
    ship_package(df.sparkSession)
    rows = df.select(F.col(quoted(label_col)).cast("string").alias("label"), F.col(quoted(text_col)).alias("text")).where("label is not null and text is not null")

    def counted(sums):
        for label, counts in sums.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(counts[seen])], names=["label", "bucket", "n"])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch.column("label"), batch.column("text"), strict=True):
                label = label.as_py()
                if label not in sums:
                    if len(sums) == HELD_LABELS:
                        yield from counted(sums)
                        sums = {}
                    sums[label] = np.zeros(BUCKETS, dtype=np.int64)
                sums[label] += ngram_counts(text.as_py())
        yield from counted(sums)

    parts = rows.mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    table = parts.toArrow()  # at most BUCKETS rows for each language
    labels = table.column("label").combine_chunks().dictionary_encode()
    names = labels.dictionary.to_pylist()
    languages = sorted(names)
    place = np.array([languages.index(x) for x in names], dtype=np.int64)
    counts = np.zeros((len(languages), BUCKETS))
    if names:
        counts[place[labels.indices.to_numpy()], table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return MixtureModel(languages, counts)


def identify(df: DataFrame, model: MixtureModel, text_col: str = "text", penalty: float = 3.0) -> DataFrame:
    """``df`` with lang_pred, score and lang_set (name and share, largest first) in place of the text."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast((model.languages, model.p))
    new = ("lang_pred", "score", "lang_set")
    table = boxed(df, F.col(quoted(text_col)).alias("text"), but=(text_col, *new))
    schema = T.StructType([table.schema[ROW]]).add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("lang_set", T.MapType(T.StringType(), T.DoubleType()))

    def run(batches):
        own = MixtureModel.__new__(MixtureModel)
        own.languages, own.p = shared.value
        for batch in batches:
            got = [own.predict(v.as_py(), penalty) for v in batch.column("text")]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(ROW), *cols], names=schema.names)

    return table.mapInArrow(run, schema).select(*own(df, text_col, *new), *new)


def held_out(id_col: str = "doc_id"):
    """A quarter of the documents, by the checksum of the id as text (a null id as empty text)."""
    return F.crc32(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))) % 4 == 2
