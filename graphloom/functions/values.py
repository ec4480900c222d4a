"""Column functions for attribute values: labels, collections, JSON cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collection_of(vertex_id: Column) -> Column:
    """The part of an id before its first slash; empty without one."""
    return F.when(F.instr(vertex_id, "/") > 0, F.substring_index(vertex_id, "/", 1)).otherwise("")


def json_text(value: Column, kind: T.DataType) -> Column:
    """A cell as JSON text, strings without their quotes, null as ``null``."""
    if isinstance(kind, T.StringType):
        text = value
    elif isinstance(kind, T.VariantType | T.StructType | T.MapType | T.ArrayType):
        text = F.to_json(value)
        if isinstance(kind, T.VariantType):
            text = F.regexp_replace(text, '(?s)^"(.*)"$', "$1")
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("null"))


def label_text(value: Column, kind: T.DataType) -> Column:
    """The start label of label propagation: never null."""
    return json_text(value, kind)


def label_list(value: Column, kind: T.DataType) -> Column:
    """The start labels of attribute propagation: an array without null or empty labels.

    Null, the empty string and the empty list give none; a list gives one label
    for each element; anything else is a single label.
    """
    none = F.array().cast("array<string>")
    if isinstance(kind, T.ArrayType):
        every = F.transform(value, lambda x: F.when(x.isNotNull(), json_text(x, kind.elementType)))
    elif isinstance(kind, T.VariantType):
        text = F.to_json(value)
        items = F.from_json(text, "array<string>")
        every = F.when(text.startswith("["), items).when(text == "null", none).otherwise(F.array(json_text(value, kind)))
    else:
        every = F.when(value.isNotNull(), F.array(json_text(value, kind)))
    return F.array_distinct(F.filter(F.coalesce(every, none), lambda x: x.isNotNull() & (x != "")))


def reciprocal(x: Column) -> Column:
    """1 / x, and 0 for 0."""
    return F.when(x == 0, F.lit(0.0)).otherwise(1.0 / F.nullif(x.cast("double"), F.lit(0.0)))
