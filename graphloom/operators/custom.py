"""User-supplied computations over a graph."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.graph import PropertyGraph
from graphloom.operators.components import weakly_connected_components

MODES = ("spark", "local", "component")


def custom(graph: PropertyGraph, fn: Callable, mode: str = "local", result_type: str = "double", max_local_edges: int | None = None) -> DataFrame:
    """(id, result) of every vertex; null for vertices the function says nothing about.

    ``spark``: fn(vertices, edges) gives a DataFrame with id (or Node) and one
    more column. ``local``: fn(edges as pandas, with all parallel edges and
    directions) gives a dict, a pandas or Arrow table. The edges come as
    columns, 16 bytes an edge for whole-number ids, and must fit the driver with
    what fn makes of them; ``max_local_edges``, if given, ends larger graphs with
    an error before anything is brought. ``component``: fn(edges of one weakly
    connected component as pandas) gives a pandas table (id, result), run on the
    executors; a component must fit one of them.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if not callable(fn):
        raise TypeError("a custom computation is a function")
    spark = graph.vertices.sparkSession
    id_type = graph.vertices.schema["id"].dataType.simpleString()
    if mode == "spark":
        found = _as_frame(graph, fn(graph.vertices, graph.edges), id_type, result_type)
    elif mode == "local":
        if max_local_edges is not None and graph.edge_count > max_local_edges:
            raise ValueError(f"a graph of {graph.edge_count} edges is too large for mode local (at most {max_local_edges})")
        found = _as_frame(graph, fn(_local(graph.edges.select("src", "dst"))), id_type, result_type)
    else:
        members = weakly_connected_components(graph).members
        parts = graph.edges.join(members.select(F.col("id").alias("src"), "component"), "src")
        schema = f"id {id_type}, result {result_type}"
        found = parts.groupBy("component").applyInPandas(lambda pdf: fn(pdf[["src", "dst"]])[["id", "result"]], schema)
    del spark
    return graph.vertices.select("id").join(found, "id", "left").select("id", "result")


def _local(edges: DataFrame) -> pd.DataFrame:
    """A table on the driver, as ``toPandas`` gives it, but never as rows."""
    return edges.toArrow().to_pandas(split_blocks=True, self_destruct=True)


def _as_frame(graph: PropertyGraph, result, id_type: str, result_type: str) -> DataFrame:
    spark, schema = graph.vertices.sparkSession, f"id {id_type}, result {result_type}"
    if isinstance(result, DataFrame):
        frame = result
    elif isinstance(result, dict):
        kind = T._parse_datatype_string(schema)
        cast = float if isinstance(kind["result"].dataType, T.DoubleType | T.FloatType) else (lambda x: x)
        return spark.createDataFrame([(k, None if v is None else cast(v)) for k, v in result.items()], schema)
    elif isinstance(result, pa.Table):
        frame = spark.createDataFrame(result.to_pandas())
    elif isinstance(result, pd.DataFrame):
        frame = spark.createDataFrame(result)
    else:
        raise TypeError(f"a custom computation returns a dict, a pandas, Arrow or Spark table, not {type(result).__name__}")
    names = frame.columns
    if len(names) != 2:
        raise ValueError("a result table has two columns, vertex and result")
    key = "id" if "id" in names else "Node" if "Node" in names else names[0]
    value = next(c for c in names if c != key)
    return frame.select(F.col(key).cast(id_type).alias("id"), F.col(value).cast(result_type).alias("result"))
