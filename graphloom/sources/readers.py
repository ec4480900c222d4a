"""Graphs from files, tables and queries."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.values import collection_of
from graphloom.graph import COLLECTION, COLLECTION_ALIAS, GraphError, PropertyGraph

#: Declared attribute types and the columns they become.
TYPES = {"string": "string", "float": "double", "integer": "bigint", "unsigned": "decimal(20,0)", "json": "variant"}


def _attributes(df: DataFrame, id_col: str, attributes: Iterable[str], types: Iterable[str] | None) -> DataFrame:
    wanted = list(attributes)
    kinds = list(types) if types else [None] * len(wanted)
    if len(kinds) != len(wanted):
        raise GraphError("as many attribute types as attributes are needed")
    cols = []
    for name, kind in zip(wanted, kinds, strict=True):
        if name in (COLLECTION, COLLECTION_ALIAS):
            col = collection_of(F.col(id_col))
        elif name not in df.columns:
            col = F.lit(None).cast("string")
        else:
            col = F.col(f"`{name}`")
        if kind is not None:
            if kind not in TYPES:
                raise GraphError(f"unknown attribute type {kind!r}")
            col = F.try_parse_json(col.cast("string")) if kind == "json" else col.try_cast(TYPES[kind])
        cols.append(col.alias(name))
    return df.select(F.col(id_col).alias("id"), *cols)


def from_tables(vertices: DataFrame, edges: DataFrame, vertex_attributes: Iterable[str] = (), vertex_attribute_types: Iterable[str] | None = None, name: str = "graph", id_col: str = "_id", from_col: str = "_from", to_col: str = "_to", **checks) -> PropertyGraph:
    """A validated graph of document tables: ids, requested attributes, edge ends.

    An attribute that a table lacks is null for its vertices.
    """
    for df, needed in ((vertices, [id_col]), (edges, [from_col, to_col])):
        if missing := [c for c in needed if c not in df.columns]:
            raise GraphError(f"a table lacks the columns {missing}")
    return PropertyGraph.validated(_attributes(vertices, id_col, vertex_attributes, vertex_attribute_types), edges.select(F.col(from_col).alias("src"), F.col(to_col).alias("dst")), name, **checks)


def _read_all(spark: SparkSession, paths: list[str], fmt: str, schema: str | None) -> DataFrame:
    out = None
    for path in dict.fromkeys(paths):  # a collection that is named twice is read once
        reader = spark.read.format(fmt)
        df = (reader.schema(schema) if schema else reader).load(path)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def from_collections(spark: SparkSession, vertex_collections: list[str], edge_collections: list[str], fmt: str = "json", vertex_attributes: Iterable[str] = (), vertex_attribute_types: Iterable[str] | None = None, vertex_schema: str | None = None, **more) -> PropertyGraph:
    """A graph of collections, each a path of JSON Lines, Parquet or ORC with _id, or _from and _to."""
    if not vertex_collections or not edge_collections:
        raise GraphError("vertex and edge collections are both needed")
    vertices = _read_all(spark, vertex_collections, fmt, vertex_schema)
    edges = _read_all(spark, edge_collections, fmt, "_from string, _to string" if fmt == "json" else None)
    return from_tables(vertices, edges, vertex_attributes, vertex_attribute_types, **more)


def from_definition(spark: SparkSession, definition: str | dict, root: str = "", fmt: str = "json", **more) -> PropertyGraph:
    """A named graph by its definition: edge definitions with collection, from and to.

    ``definition`` is a dict or the path of a JSON file that Spark can read. A
    collection that several edge definitions use is read once.
    """
    if isinstance(definition, str):
        definition = json.loads("\n".join(r.value for r in spark.read.text(definition, wholetext=True).collect()))
    parts = definition.get("edgeDefinitions") or []
    if not parts:
        raise GraphError("a graph definition needs edgeDefinitions")
    vertices = list(dict.fromkeys([c for p in parts for c in (*p["from"], *p["to"])] + definition.get("orphanCollections", [])))
    edges = list(dict.fromkeys(p["collection"] for p in parts))
    at = lambda c: f"{root.rstrip('/')}/{c}" if root else c
    return from_collections(spark, [at(c) for c in vertices], [at(c) for c in edges], fmt, name=definition.get("name", "graph"), **more)


def load(spark: SparkSession, graph_name: str | dict | None = None, vertex_collections: list[str] | None = None, edge_collections: list[str] | None = None, database: str | None = None, parallelism: int | None = None, batch_size: int | None = None, **more) -> PropertyGraph:
    """By definition or by both lists of collections, never both.

    ``database`` is the folder that the collections' names are relative to.
    ``parallelism`` and ``batch_size`` are accepted and have no effect: Spark
    splits files by size.
    """
    if database:
        at = lambda c: c if "/" in c else f"{database.rstrip('/')}/{c}"
        vertex_collections = [at(c) for c in vertex_collections or []]
        edge_collections = [at(c) for c in edge_collections or []]
        if graph_name:
            more.setdefault("root", database)
    if graph_name and (vertex_collections or edge_collections):
        raise GraphError("give a graph name or collections, not both")
    if graph_name:
        return from_definition(spark, graph_name, **more)
    if not (vertex_collections and edge_collections):
        raise GraphError("give a graph name, or vertex and edge collections")
    return from_collections(spark, vertex_collections, edge_collections, **more)


def from_sql(spark: SparkSession, vertex_query: str, edge_query: str, vertex_attributes: Iterable[str] | None = None, **more) -> PropertyGraph:
    """A graph of two queries, one giving _id and attributes, one _from and _to."""
    vertices = spark.sql(vertex_query)
    attributes = [c for c in vertices.columns if c != "_id"] if vertex_attributes is None else vertex_attributes
    return from_tables(vertices, spark.sql(edge_query), attributes, **more)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(id, result) of a Parquet file with exactly the columns Node and Result."""
    df = spark.read.parquet(path)
    if sorted(df.columns) != ["Node", "Result"]:
        raise GraphError(f"results have the columns Node and Result, not {df.columns}")
    return df.select(F.col("Node").alias("id"), F.col("Result").alias("result"))


def from_ldbc(spark: SparkSession, prefix: str, check_counts: bool = True, id_prefix: str = "") -> PropertyGraph:
    """A graph of ``prefix``.v (an id a line), ``prefix``.e (source and target, blank-separated) and ``prefix``.properties.

    The counts in the properties, where there are any, must be met.
    """
    ids = spark.read.text(f"{prefix}.v").select(F.trim("value").alias("id")).where("id <> ''")
    parts = F.split(F.trim("value"), r"\s+")
    edges = spark.read.text(f"{prefix}.e").where("trim(value) <> ''").select(F.get(parts, F.lit(0)).alias("src"), F.get(parts, F.lit(1)).alias("dst"))
    named = lambda c: F.concat(F.lit(id_prefix), F.col(c)).alias(c)
    graph = PropertyGraph(ids.select(named("id")), edges.select(named("src"), named("dst")), prefix.rsplit("/", 1)[-1])
    if check_counts:
        want = ldbc_properties(spark, f"{prefix}.properties")
        for kind, have in (("vertices", graph.vertex_count), ("edges", graph.edge_count)):
            number = next((int(v) for k, v in want.items() if k.endswith(f".meta.{kind}")), have)
            if number != have:
                raise GraphError(f"{prefix} has {have} {kind}, its properties say {number}")
    return graph


def ldbc_properties(spark: SparkSession, path: str) -> dict[str, str]:
    lines = [r.value for r in spark.read.text(path).collect()]
    return {k.strip(): v.strip() for k, _, v in (x.partition("=") for x in lines if "=" in x and not x.lstrip().startswith("#"))}


def ldbc_results(spark: SparkSession, path: str) -> DataFrame:
    """(id, value) of a reference output file."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(1)).alias("value"))
