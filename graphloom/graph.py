"""The property graph: a vertex table and an edge table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.values import collection_of

#: Both spellings of the pseudo-attribute that holds a vertex's collection.
COLLECTION = "@collectionname"
COLLECTION_ALIAS = "@collection_name"


class GraphError(ValueError):
    """A graph or a request that makes no sense."""


@dataclass(frozen=True)
class PropertyGraph:
    """``vertices(id, attributes...)`` and directed ``edges(src, dst)``.

    A multigraph: parallel edges and self-loops are kept. ``id`` may be of any
    type that can be compared; sources make it a string.
    """

    vertices: DataFrame
    edges: DataFrame
    name: str = "graph"
    meta: dict = field(default_factory=dict)

    def __post_init__(self):
        if "id" not in self.vertices.columns:
            raise GraphError("vertices need a column id")
        if not {"src", "dst"} <= set(self.edges.columns):
            raise GraphError("edges need the columns src and dst")

    @classmethod
    def create(cls, spark: SparkSession, ids: list[str], edges: list[tuple[str, str]], **attributes: list) -> PropertyGraph:
        """A small graph from lists; each attribute has one value for each id."""
        names = list(attributes)
        if any(len(v) != len(ids) for v in attributes.values()):
            raise GraphError("an attribute needs one value for each vertex")
        rows = [tuple(r) for r in zip(ids, *attributes.values(), strict=True)]
        kinds = [spark.createDataFrame([(x,) for x in v if x is not None] or [("",)]).schema[0].dataType.simpleString() if v else "string" for v in attributes.values()]
        schema = ", ".join(["id string", *(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))])
        return cls(spark.createDataFrame(rows, schema), spark.createDataFrame(edges, "src string, dst string"))

    @classmethod
    def validated(cls, vertices: DataFrame, edges: DataFrame, name: str = "graph", duplicates: str = "drop", dangling: str = "drop") -> PropertyGraph:
        """Vertices with one row for each id; edges whose ends exist.

        ``duplicates`` and ``dangling`` say what happens to others: ``drop`` or
        ``error``. Rows without an id or an end are always dropped.
        """
        vertices = vertices.where("id is not null")
        if duplicates == "error" and not vertices.groupBy("id").count().where("count > 1").isEmpty():
            raise GraphError("vertex ids are not unique")
        vertices = vertices.dropDuplicates(["id"])
        graph = cls(vertices, edges.where("src is not null and dst is not null"), name)
        if dangling == "error" and not graph.dangling_edges().isEmpty():
            raise GraphError("edges refer to vertices that do not exist")
        ids = vertices.select("id")
        kept = graph.edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")
        return cls(vertices, kept, name)

    def dangling_edges(self) -> DataFrame:
        """Edges with an end that is no vertex."""
        known = self.vertices.select("id").distinct()
        left = self.edges.join(known, F.col("src") == F.col("id"), "left_anti")
        right = self.edges.join(known, F.col("src") == F.col("id"), "left_semi").join(known, F.col("dst") == F.col("id"), "left_anti")
        return left.union(right)

    @cached_property
    def vertex_count(self) -> int:
        return self.vertices.count()

    @cached_property
    def edge_count(self) -> int:
        return self.edges.count()

    @property
    def attributes(self) -> list[str]:
        return [c for c in self.vertices.columns if c != "id"]

    def require(self, attribute: str) -> str:
        """The attribute's column; either spelling of the collection attribute."""
        if attribute in self.vertices.columns:
            return attribute
        twin = {COLLECTION: COLLECTION_ALIAS, COLLECTION_ALIAS: COLLECTION}.get(attribute)
        if twin in self.vertices.columns:
            return twin
        raise GraphError(f"vertices have no attribute {attribute!r}")

    def with_collections(self) -> PropertyGraph:
        """With the collection of each vertex, the part of its id before the first slash."""
        if {COLLECTION, COLLECTION_ALIAS} & set(self.vertices.columns):
            return self
        return PropertyGraph(self.vertices.withColumn(COLLECTION, collection_of(F.col("id"))), self.edges, self.name)

    def persist(self) -> PropertyGraph:
        """Materialise both tables, edges dealt by source, and count them."""
        graph = PropertyGraph(self.vertices.persist(), self.edges.repartition("src").persist(), self.name)
        graph.vertex_count, graph.edge_count  # noqa: B018
        return graph

    def unpersist(self) -> None:
        self.vertices.unpersist()
        self.edges.unpersist()

    def subgraph(self, vertex_filter: Column | str | None = None, edge_filter: Column | str | None = None) -> PropertyGraph:
        """The vertices that pass, and the edges that pass between them."""
        vertices = self.vertices.where(vertex_filter) if vertex_filter is not None else self.vertices
        edges = self.edges.where(edge_filter) if edge_filter is not None else self.edges
        ids = vertices.select("id")
        return PropertyGraph(vertices, edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi"), self.name)

    def reversed(self) -> PropertyGraph:
        return PropertyGraph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), self.name)

    def symmetrised(self) -> DataFrame:
        """(src, dst) of each edge in both directions, repeats kept."""
        return self.edges.select("src", "dst").union(self.edges.select("dst", "src"))

    def out_degrees(self) -> DataFrame:
        """(id, out_degree) of every vertex."""
        return self._degrees("src", "out_degree")

    def in_degrees(self) -> DataFrame:
        """(id, in_degree) of every vertex."""
        return self._degrees("dst", "in_degree")

    def _degrees(self, end: str, name: str) -> DataFrame:
        counts = self.edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias(name))
        return self.vertices.select("id").join(counts, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))

    def out_neighbours(self, vertex) -> DataFrame:
        """(id) of each edge's target, for one vertex; parallel edges repeat."""
        return self.edges.where(F.col("src") == F.lit(vertex)).select(F.col("dst").alias("id"))

    def in_neighbours(self, vertex) -> DataFrame:
        return self.edges.where(F.col("dst") == F.lit(vertex)).select(F.col("src").alias("id"))

    def memory_bytes(self) -> int:
        """Catalyst's estimate of the size of both tables."""
        return sum(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in (self.vertices, self.edges))

    def show(self, n: int = 20) -> None:
        self.vertices.show(n, truncate=False)
        self.edges.show(n, truncate=False)


class GraphBuilder:
    """A small graph, vertex by vertex and edge by edge, on the driver; ``seal`` makes it a table."""

    def __init__(self, attributes: list[str] | None = None):
        self.attributes, self.rows, self.edges, self._known = list(attributes or []), [], [], set()

    def insert_vertex(self, vertex: str, **values) -> None:
        if unknown := set(values) - set(self.attributes):
            raise GraphError(f"the graph has no attributes {sorted(unknown)}")
        if vertex in self._known:
            raise GraphError(f"vertex {vertex!r} exists already")
        self._known.add(vertex)
        self.rows.append((vertex, *(values.get(a) for a in self.attributes)))

    def insert_edge(self, src: str, dst: str, checked: bool = True) -> None:
        """An edge; ``checked``: both ends must exist already."""
        if checked and (missing := {src, dst} - self._known):
            raise GraphError(f"vertices {sorted(missing)} do not exist")
        self.edges.append((src, dst))

    def seal(self, spark: SparkSession) -> PropertyGraph:
        """The graph; edges that were not checked and end nowhere are dropped."""
        columns = {a: [r[k + 1] for r in self.rows] for k, a in enumerate(self.attributes)}
        kept = [e for e in self.edges if set(e) <= self._known]
        return PropertyGraph.create(spark, [r[0] for r in self.rows], kept, **columns)
