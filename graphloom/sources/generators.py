"""Generated graphs, as expressions over ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph


def _key(number) -> F.Column:
    return F.concat(F.lit("V/K"), number.cast("long").cast("string"))


def _graph(vertices: DataFrame, edges: DataFrame, name: str) -> PropertyGraph:
    return PropertyGraph(vertices.select(_key(F.col("id")).alias("id")), edges.select(_key(F.col("a")).alias("src"), _key(F.col("b")).alias("dst")), name)


def cycle(spark: SparkSession, n: int) -> PropertyGraph:
    """Each vertex to the next, the last to the first."""
    ids = spark.range(n)
    return _graph(ids, ids.select(F.col("id").alias("a"), ((F.col("id") + 1) % n).alias("b")), "cycle")


def star(spark: SparkSession, n: int) -> PropertyGraph:
    """Every vertex to the last one."""
    ids = spark.range(n)
    return _graph(ids, spark.range(n - 1).select(F.col("id").alias("a"), F.lit(n - 1).alias("b")), "star")


def binary_tree(spark: SparkSession, depth: int) -> PropertyGraph:
    """Vertices 1 to 2^depth - 1, each to its two children."""
    inner = spark.range(1, 2 ** (depth - 1))
    children = inner.select(F.col("id").alias("a"), F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("b"))
    return _graph(spark.range(1, 2**depth), children, "btree")


def complete(spark: SparkSession, n: int) -> PropertyGraph:
    """One edge for each pair of vertices; small n only."""
    a = spark.range(n).select(F.col("id").alias("a"))
    return _graph(spark.range(n), a.select("a", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b")).where("a < b"), "complete")
