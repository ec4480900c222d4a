"""Keeping a table's own columns apart from those that an operator adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "_row"


def quoted(name: str) -> str:
    """A column's name as it stands in an expression, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def others(df: DataFrame, *taken: str) -> list[str]:
    """``df``'s columns without those called like ``taken``; names differ by more than case."""
    lower = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in lower]


def boxed(df: DataFrame, *more: Column, but: tuple[str, ...] = ()) -> DataFrame:
    """One struct column with ``df``'s columns (``but`` for some), beside ``more``; whatever they are called, no names clash."""
    kept = [F.col(quoted(c)) for c in others(df, *but)] or [F.lit(True).alias("row")]
    return df.select(F.struct(*kept).alias(ROW), *more)


def own(df: DataFrame, *but: str) -> list[Column]:
    """The columns of ``df`` out of a table that ``boxed`` made of it, for a select."""
    return [F.col(f"{ROW}.{quoted(c)}").alias(c) for c in others(df, *but)]


def unboxed(table: DataFrame) -> DataFrame:
    return table.select(f"{ROW}.*")
