"""Results of several computations side by side, written as documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.runtime import delete_path, path_exists, rename_path


def joined_results(results: list[DataFrame], names: list[str]) -> DataFrame:
    """(id, names...): each result's value column under its name, joined on the id.

    Vertices that only some results hold have nulls for the others.
    """
    if not results or len(results) != len(names):
        raise ValueError("as many attribute names as results are needed")
    if len(set(names)) != len(names) or "id" in names:
        raise ValueError("attribute names are distinct and not id")
    out = None
    for df, name in zip(results, names, strict=True):
        value = next(c for c in df.columns if c != "id")
        part = df.select("id", F.col(value).alias(name))
        out = part if out is None else out.join(part, "id", "full")
    return out


def store(results: list[DataFrame], names: list[str], target: str = "targetCollection", fmt: str = "parquet", mode: str = "overwrite") -> DataFrame:
    """Write the joined results to ``target``; Parquet, JSON Lines, ORC or CSV.

    ``update`` keeps what the target already holds of other attributes and ids:
    the new table is written beside it, and takes its place by renaming once it
    is complete; if that fails, the old one is put back.
    """
    df = joined_results(results, names)
    if mode != "update":
        df.write.mode(mode).format(fmt).save(target)
        return df
    spark = df.sparkSession
    if not path_exists(spark, target):
        df.write.format(fmt).save(target)
        return df
    old = spark.read.format(fmt).load(target)
    new = df.select("id", *(F.col(n).alias(f"_new_{n}") for n in names), F.lit(True).alias("_has"))
    both = old.join(new, "id", "full")
    cols = [F.when(F.col("_has"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in old.columns if c != "id"]
    cols += [F.col(f"_new_{n}").alias(n) for n in names if n not in old.columns]
    beside, aside = (f"{target.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    try:
        both.select("id", *cols).write.format(fmt).save(beside)
        rename_path(spark, target, aside)
        try:
            rename_path(spark, beside, target)
        except Exception:
            rename_path(spark, aside, target)
            raise
        delete_path(spark, aside)
    finally:
        delete_path(spark, beside)
    spark.catalog.refreshByPath(target)
    return spark.read.format(fmt).load(target)


def write_edges(graph: PropertyGraph, path: str) -> None:
    """The edges as Parquet with the columns _from and _to, for programs outside."""
    graph.edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to")).write.option("compression", "snappy").parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """(id, value) of a computation as Parquet with the columns Node and Result."""
    value = next(c for c in results.columns if c != "id")
    results.select(F.col("id").alias("Node"), F.col(value).alias("Result")).write.parquet(path)
