"""Graphs derived from relational tables, each from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.graph import COLLECTION, PropertyGraph


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def _key(prefix: str, column: str) -> F.Column:
    return F.concat(F.lit(f"{prefix}/"), F.col(column).cast("string"))


def orders_and_parts(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Orders to the parts of their line items; every part is a sink, edges repeat."""
    orders = _read(spark, sf_dir, "orders", "o_orderkey").select(_key("O", "o_orderkey").alias("id"))
    parts = _read(spark, sf_dir, "part", "p_partkey").select(_key("P", "p_partkey").alias("id"))
    edges = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").select(_key("O", "l_orderkey").alias("src"), _key("P", "l_partkey").alias("dst"))
    return PropertyGraph(orders.union(parts).withColumn(COLLECTION, F.substring_index("id", "/", 1)), edges, "orders_and_parts")


def users(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Every two different users of consecutive events; a dense digraph."""
    events = _read(spark, sf_dir, "events", "event_id", "user_id")
    first = events.select((F.col("event_id") + 1).alias("next"), F.col("user_id").alias("src"))
    pairs = first.join(events.select(F.col("event_id").alias("next"), F.col("user_id").alias("dst")), "next")
    edges = pairs.where("src <> dst").select("src", "dst").distinct()
    vertices = events.select(F.col("user_id").alias("id")).distinct()
    label = F.lpad(F.col("id").cast("string"), 8, "0")
    return PropertyGraph(vertices.select("id", label.alias("label"), F.when(F.col("id") % 3 == 0, label).alias("seed"), F.concat(F.lit("g"), (F.col("id") % 4).cast("string")).alias("kind")), edges, "users")


def journeys(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Each event to its user's next one, and each error back to the signup before it: long paths with cycles."""
    events = _read(spark, sf_dir, "events", "event_id", "user_id", "event_type").withColumnRenamed("event_id", "id")
    own = Window.partitionBy("user_id").orderBy("id")
    earlier = F.max(F.when(F.col("event_type") == "signup", F.col("id"))).over(own.rowsBetween(Window.unboundedPreceding, -1))
    both = events.select(F.col("id").alias("src"), F.lead("id").over(own).alias("next"), F.when(F.col("event_type") == "error", earlier).alias("back"))
    ways = both.select("src", F.explode(F.array("next", "back")).alias("dst"))
    return PropertyGraph(events.select("id", F.col("event_type").alias("kind")), ways.where("dst is not null"), "journeys")


def geography(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Orders, customers and suppliers to nations and regions, by foreign key."""
    tables = [("region", "r_regionkey", None, None), ("nation", "n_nationkey", "n_regionkey", "region"), ("customer", "c_custkey", "c_nationkey", "nation"), ("supplier", "s_suppkey", "s_nationkey", "nation"), ("orders", "o_orderkey", "o_custkey", "customer")]
    vertices = edges = None
    for name, key, parent, target in tables:
        rows = _read(spark, sf_dir, name, key, *([parent] if parent else []))
        v = rows.select(_key(name, key).alias("id"), F.lit(name).alias(COLLECTION))
        vertices = v if vertices is None else vertices.union(v)
        if parent:
            e = rows.select(_key(name, key).alias("src"), _key(target, parent).alias("dst"))
            edges = e if edges is None else edges.union(e)
    return PropertyGraph(vertices, edges, "geography")
