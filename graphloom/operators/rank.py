"""Rank algorithms: PageRank, its collection-weighted variant, and LineRank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.functions.values import reciprocal
from graphloom.graph import COLLECTION, PropertyGraph
from graphloom.plans.superstep import Links, Loop, Numbered, as_data
from graphloom.runtime import Scratch

#: No rank moves by more: the walk has settled. Ranks get smaller with their number, so above ten of them it is a share of their mean.
TOLERANCE, MEAN_OF = 1e-7, 10


@dataclass(frozen=True)
class Ranks:
    """``ranks`` is (id, rank); ``steps`` counts supersteps made, a converging last one included."""

    ranks: DataFrame
    steps: int
    scratch: Scratch

    @property
    def last_step(self) -> int:
        """The zero-based number of the last superstep."""
        return max(self.steps - 1, 0)


def _settled(n: int):
    """Whether the ranks of ``n`` vertices or edges, which sum up to one at least, no longer move."""
    least = TOLERANCE * min(1.0, MEAN_OF / max(n, 1))
    return lambda seen: (seen["moved"] or 0.0) < least


def _power_iteration(graph: PropertyGraph, base, supersteps: int, damping: float, loop: Loop) -> Ranks:
    """``base`` makes (id, base) of a numbered graph: the start rank and, times 1 - damping, the part that needs no edge."""
    numbered = Numbered(graph, loop.scratch)
    links = Links(loop, numbered.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times")))
    starts = loop.taken(base(numbered)).repartition(loop.parts, "id").sortWithinPartitions("id")
    # What a vertex passes on along each of its links, for a rank of 1; null for sinks.
    first = starts.join(links.degrees("out"), "id", "left").select("id", "base", (F.lit(damping) / F.col("out")).alias("part"), F.col("base").alias("rank"), F.lit(0.0).alias("moved"))
    watch = Observation()
    lost = F.coalesce(F.sum(F.when(F.col("part").isNull(), F.col("rank"))), F.lit(0.0))
    first = loop.cut(first.observe(watch, F.count(F.lit(1)).alias("n"), lost.alias("sinks")))
    n = watch.get["n"]

    def step(state: DataFrame, seen: dict) -> DataFrame:
        passed = state.where("part is not null").select("id", (F.col("part") * F.col("rank")).alias("passed"))
        gathered = links.reach(passed).groupBy("id").agg(F.sum(F.col("times") * F.col("passed")).alias("sum"))
        share = damping * (seen["sinks"] or 0.0) / max(n, 1)
        rank = (1 - damping) * F.col("base") + F.coalesce("sum", F.lit(0.0)) + as_data(share, F.col("id"))
        return state.join(gathered, "id", "left").select("id", "base", "part", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("moved"))

    metrics = {"moved": F.max("moved"), "sinks": lost}
    state, steps = loop.iterate(first, step, metrics, _settled(n), supersteps, {"sinks": watch.get["sinks"]})
    ranks = loop.given(state.select("id", "rank"))
    links.close()
    return Ranks(numbered.named(ranks), steps, loop.scratch)


def page_rank(graph: PropertyGraph, supersteps: int = 10, damping: float = 0.85, cancelled=None, report=None) -> Ranks:
    """PageRank; parallel edges count, and sinks spread their rank over all vertices.

    Stops when no rank moves by 1e-7, or a millionth of the mean rank if that is
    less, or after ``supersteps`` steps.
    """
    n = max(graph.vertex_count, 1)
    loop = Loop(graph.vertices.sparkSession, "rank", cancelled, report)
    return _power_iteration(graph, lambda g: g.vertices.withColumn("base", F.lit(1.0 / n)), supersteps, damping, loop)


def i_rank(graph: PropertyGraph, supersteps: int = 10, damping: float = 0.85, collection: str = COLLECTION, cancelled=None, report=None) -> Ranks:
    """PageRank whose start and base are one over the size of the vertex's collection.

    Ranks add up to the number of collections. Sinks still spread over all vertices.
    """
    column = graph.require(collection)
    sizes = graph.vertices.groupBy(F.col(column).alias("_c")).agg((1.0 / F.count(F.lit(1))).alias("base"))
    base = graph.vertices.join(sizes, F.col(column).eqNullSafe(F.col("_c"))).select("id", "base")
    loop = Loop(graph.vertices.sparkSession, "rank", cancelled, report)
    return _power_iteration(graph, lambda g: g.of(base), supersteps, damping, loop)


def line_rank(graph: PropertyGraph, supersteps: int = 10, damping: float = 0.85, cancelled=None, report=None) -> Ranks:
    """Rank of vertices by a walk over edges; a self-loop counts twice for its vertex.

    An edge passes its value on to the edges that leave its target, so all edges
    into a vertex have one value, which is kept with the vertex: it follows from
    the values of the vertices that its edges lead to.
    """
    loop = Loop(graph.vertices.sparkSession, "linerank", cancelled, report)
    numbered = Numbered(graph, loop.scratch)
    m = max(graph.edge_count, 1)
    kinds = numbered.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"))
    links = Links(loop, kinds.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "times"))
    vertices = loop.taken(numbered.vertices).repartition(loop.parts, "id").sortWithinPartitions("id")
    outs = links.few if links.many is None else links.few.union(links.many)
    outs = outs.groupBy(F.col("dst").alias("id")).agg(F.sum("times").alias("out"))
    start = vertices.join(outs, "id", "left").join(links.degrees("in"), "id", "left")
    start = start.select("id", reciprocal(F.coalesce("out", F.lit(0))).alias("norm"), F.coalesce("in", F.lit(0)).alias("in"), F.lit(1.0 / m).alias("value"), F.lit(0.0).alias("moved"))
    start = loop.cut(start)

    def leaving(state: DataFrame) -> DataFrame:
        return links.reach(state.select("id", "value")).groupBy("id").agg(F.sum(F.col("times") * F.col("value")).alias("sum"))

    def step(state: DataFrame, seen: dict) -> DataFrame:
        value = F.coalesce(F.lit(damping) * F.col("sum") * F.col("norm"), F.lit(0.0)) + F.lit((1 - damping) / m)
        moved = F.when(F.col("in") > 0, F.abs(value - F.col("value"))).otherwise(0.0)
        return state.join(leaving(state), "id", "left").select("id", "norm", "in", value.alias("value"), moved.alias("moved"))

    state, steps = loop.iterate(start, step, {"moved": F.max("moved")}, _settled(m), supersteps)
    rank = F.coalesce("sum", F.lit(0.0)) + F.col("in") * F.col("value")
    ranks = loop.given(state.join(leaving(state), "id", "left").select("id", rank.alias("rank")))
    links.close()
    return Ranks(numbered.named(ranks), steps, loop.scratch)
