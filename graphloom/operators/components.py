"""Weakly and strongly connected components, and aggregation over them."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.graph import PropertyGraph
from graphloom.plans import blocks
from graphloom.plans.superstep import Links, Loop, Numbered, as_data
from graphloom.runtime import Scratch, ship_package


def connected_components(edges: DataFrame, scratch: Scratch, check: Callable[[int], None] | None = None) -> DataFrame:
    """(id, component) of every end of ``edges`` (src, dst), component being the smallest id.

    Local contraction (Lacki et al. 2018): in a round each vertex joins the vertex
    of its neighbourhood, itself included, whose hash is smallest in that round;
    edges then lead between what is left, and edges within go. A round leaves a
    fraction of the vertices, whatever the graph's diameter, so the rounds are
    logarithmic and their sizes add up to a few times the first. The hash makes
    that so for any numbering, the sorted path included. The chain of joined
    vertices is followed backwards at the end. The minimum is a partial
    aggregate, and joins are equi-joins that adaptive planning can split, so a
    vertex with a third of all edges is no bottleneck. Rounds are written.

    Direction, repeated edges and self-loops make no difference; null ends are
    ignored. An end that has self-loops only is a component of its own.
    """
    ends = edges.where("src is not null and dst is not null").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now = scratch.table(ends, "ends")
    e, joined, n = now.where("u <> v"), [], 1
    while n:
        if check:
            check(len(joined))
        order = lambda c, r=len(joined): F.struct(F.xxhash64(c, F.lit(r)).alias("h"), F.col(c).alias("p"))
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(order("v")).alias("m")).select("u", F.least("m", order("u"))["p"].alias("p"))
        to = scratch.table(least, "joined")
        joined.append(to)
        watch, before = Observation(), e
        moved = e.join(to.select("u", F.col("p").alias("pu")), "u").join(to.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v").where("pu <> pv")
        moved = moved.select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct()
        e = scratch.table(moved.observe(watch, F.count(F.lit(1)).alias("n")), "edges")
        n = watch.get["n"]
        if len(joined) > 1:
            scratch.drop(before)
    root = joined.pop().select("u", F.col("p").alias("root"))
    for to in reversed(joined):
        root = to.join(root.select(F.col("u").alias("p"), "root"), "p", "left").select("u", F.coalesce("root", "p").alias("root"))
    roots = scratch.table(root, "roots")
    names = roots.groupBy("root").agg(F.min("u").alias("component"))
    found = roots.join(names, "root").select(F.col("u").alias("id"), "component")
    loops = now.where("u = v").select("u")
    alone = loops.join(roots, "u", "left_anti").select(F.col("u").alias("id"), F.col("u").alias("component"))
    return found.union(alone)


@dataclass(frozen=True)
class Components:
    """``members`` is (id, component); a component's id is the smallest of its vertices."""

    graph: PropertyGraph
    members: DataFrame
    scratch: Scratch

    @cached_property
    def count(self) -> int:
        return self.members.select("component").distinct().count()


def weakly_connected_components(graph: PropertyGraph, cancelled=None, report=None) -> Components:
    """Components by edges of either direction; isolated vertices are their own."""
    loop = Loop(graph.vertices.sparkSession, "wcc", cancelled, report)
    numbered = Numbered(graph, loop.scratch)
    found = connected_components(numbered.edges, loop.scratch, loop.check)
    members = numbered.vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return Components(graph, numbered.named(loop.scratch.table(members, "members"), "id", "component"), loop.scratch)


def strongly_connected_components(graph: PropertyGraph, local_edges: int = 200_000, cancelled=None, report=None) -> Components:
    """Components whose vertices reach each other along edges.

    First blocks of vertices with near numbers are contracted in memory, a block
    a task of bounded size, as long as that leaves at most three quarters of the
    edges; a graph of one block is done by that. Then rounds of: trimming vertices without an incoming or outgoing edge; joining
    chains of vertices with one edge in and one out into one edge, so that the
    steps follow what branches, not the length of paths; colouring each vertex
    with the first vertex that reaches it, in the order of a hash that is another
    in each round, so that a row of components falls into several colours, however
    it is numbered; of each colour, the vertices that reach its origin are one
    component. Edges between components and colours go.
    Once at most ``local_edges`` edges are left they are finished on the driver,
    which that number bounds; with 0 everything stays distributed.
    """
    loop = Loop(graph.vertices.sparkSession, "scc", cancelled, report)
    numbered = Numbered(graph, loop.scratch)
    members = numbered.vertices.join(strong_members(numbered.edges, loop, local_edges), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return Components(graph, numbered.named(loop.scratch.table(members, "members"), "id", "component"), loop.scratch)


def strong_members(edges: DataFrame, loop: Loop, local_edges: int = 0) -> DataFrame:
    """(id, component) of the vertices in components of more than one, the smallest included, by edges of numbers; some others may be in it too."""
    scratch = loop.scratch
    loop.check(0)
    watch = Observation()
    edges = scratch.table(edges.where("src <> dst").distinct().observe(watch, F.count(F.lit(1)).alias("n")), "edges")
    edges, n, levels = _contracted(edges, watch.get["n"], local_edges, loop)
    found, rounds = [], 0
    chains: list[DataFrame] = []
    while n:
        loop.check(rounds)
        rounds += 1
        edges, left = _trim(edges, scratch)
        if left > local_edges:
            edges, chain, left = _without_chains(edges, scratch)
            chains += chain
        if left == 0:
            break
        if left <= local_edges:
            rows = _tarjan([(r.src, r.dst) for r in edges.toLocalIterator()])
            found.append(scratch.table(loop.user.createDataFrame(rows, "id long, component long"), "local"))
            break
        colour = _reach_first(edges, rounds, loop)
        ends = edges.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst")
        inner = scratch.table(ends.where("cs = cd").select("src", "dst", F.col("cs").alias("c")), "inner")
        part = _back(inner, colour, loop)
        found.append(part)
        done = part.select("id")
        edges = scratch.table(inner.select("src", "dst").join(done, F.col("src") == F.col("id"), "left_anti").join(done, F.col("dst") == F.col("id"), "left_anti"), "edges")
    found = found or [loop.user.createDataFrame([], "id long, component long")]
    for chain in reversed(chains):
        if len(found) > 8:
            found = [scratch.table(_all(found), "known")]
        found.append(scratch.table(_inside(chain, _all(found)), "inside"))
    known = _all(found)
    for level in reversed(levels):
        known = scratch.table(_spread(*level, known), "spread")
    least = known.groupBy("component").agg(F.least(F.min("id"), "component").alias("least"))
    named = known.join(least, "component").select("id", F.col("least").alias("component"))
    # A component's first name may be a vertex that no row speaks of.
    return named.union(least.select(F.col("component").alias("id"), F.col("least").alias("component"))).distinct()


def _contracted(edges: DataFrame, n: int, local_edges: int, loop: Loop) -> tuple[DataFrame, int, list[tuple[DataFrame, int]]]:
    """Edges that contraction within blocks leaves, their number, and of each level of it the rows and the number of blocks."""
    scratch, levels = loop.scratch, []
    while n > local_edges and blocks.BLOCK_ROWS:
        loop.check(len(levels))
        ship_package(loop.user)
        row = lambda v: F.struct(F.col(v).alias("v"), "src", "dst")
        ends = edges.select(F.inline(F.array(row("src"), row("dst"))))
        number, single = -(-2 * n // blocks.BLOCK_ROWS), None
        if number > 1:
            # A vertex with a large part of a block's edges stays outside of all blocks.
            found = ends.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > blocks.BLOCK_ROWS // 4).select("v").collect()
            if found:
                hubs = F.broadcast(loop.user.createDataFrame(found, "v long"))
                single = edges.join(hubs, F.col("src") == F.col("v"), "left_semi")
                ends = ends.join(hubs, "v", "left_anti")
        dealt = ends.repartitionByRange(number, "v") if number > 1 else ends.coalesce(1)
        level = scratch.table(dealt.mapInArrow(blocks.contract, blocks.FORM), "blocks")
        pairs = lambda kind: level.where(F.col("kind") == kind).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        across = pairs(blocks.ACROSS) if single is None else pairs(blocks.ACROSS).union(single.select("src", "dst"))
        names = level.where(F.col("kind") == blocks.NAME).select(F.col("a").alias("dst"), "b", F.lit(True).alias("new"))
        across = across.join(names, "dst", "left").select("src", F.when(F.col("new"), F.col("b")).otherwise(F.col("dst")).alias("dst"))
        watch, before = Observation(), n
        rest = pairs(blocks.WITHIN).union(across.where("dst is not null and src <> dst")).distinct()
        edges = scratch.table(rest.observe(watch, F.count(F.lit(1)).alias("n")), "edges")
        n = watch.get["n"]
        levels.append((level, number))
        if number == 1 or 4 * n > 3 * before:
            break
    return edges, n, levels


def _spread(level: DataFrame, number: int, known: DataFrame) -> DataFrame:
    """(id, component) of the vertices before a level of contraction, from those that it left."""
    left = level.where(F.col("kind") == blocks.LEFT).join(known, F.col("a") == F.col("id")).select("kind", "block", "seq", "a", F.col("component").alias("b"), "c")
    rows = level.where(F.col("kind").isin(blocks.MEMBER, blocks.CHAIN)).union(left)
    inside = rows.repartition(number, "block").mapInArrow(blocks.spread, "id long, component long")
    # Vertices outside of all blocks are known by themselves.
    return inside.union(known).distinct()


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _trim(edges: DataFrame, scratch: Scratch, rounds: int = 4) -> tuple[DataFrame, int]:
    """Edges without those at vertices that nothing enters or nothing leaves, a few layers of them, and their number."""
    before = -1
    for _ in range(rounds):
        ends = edges.select("src", F.lit(1).alias("side")).union(edges.select("dst", F.lit(2).alias("side")))
        both = ends.groupBy(F.col("src").alias("id")).agg(F.bit_or("side").alias("sides")).where("sides = 3").select("id")
        watch = Observation()
        kept = edges.join(both, F.col("src") == F.col("id"), "left_semi").join(both, F.col("dst") == F.col("id"), "left_semi")
        edges = scratch.table(kept.observe(watch, F.count(F.lit(1)).alias("n")), "trimmed")
        n = watch.get["n"]
        if n in (before, 0):
            break
        before = n
    return edges, n


def _without_chains(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame], int]:
    """Edges with chains joined into single ones, what was taken out as (id, first, last), and the edges' number.

    A vertex with one edge in and one out is taken out, if its hash is smaller
    than those of its neighbours that are such vertices too: no two neighbours
    go at once, and about a third of a chain goes in a round. The hash of a long
    is one-to-one, so there are no ties.
    """
    taken: list[DataFrame] = []
    none = F.lit(None).cast("long")
    row = lambda **columns: F.struct(*(c.alias(k) for k, c in columns.items()))
    while True:
        hash_ = F.xxhash64("id", as_data(len(taken), F.col("id")))
        ends = edges.select(F.inline(F.array(row(id=F.col("dst"), first=F.col("src"), last=none), row(id=F.col("src"), first=none, last=F.col("dst")))))
        inner = ends.groupBy("id").agg(F.count("first").alias("ins"), F.count("last").alias("outs"), F.min("first").alias("first"), F.min("last").alias("last")).where("ins = 1 and outs = 1")
        sent = inner.select(F.inline(F.array(row(id=F.col("id"), first=F.col("first"), last=F.col("last"), h=none), *(row(id=F.col(c), first=none, last=none, h=hash_) for c in ("first", "last")))))
        met = sent.groupBy("id").agg(F.max("first").alias("first"), F.max("last").alias("last"), F.min("h").alias("h"))
        watch = Observation()
        out = met.where(F.col("first").isNotNull() & (F.col("h").isNull() | (hash_ < F.col("h")))).select("id", "first", "last")
        out = scratch.table(out.observe(watch, F.count(F.lit(1)).alias("n")), "chain")
        if watch.get["n"] == 0:
            return edges, taken, edges.count()
        taken.append(out)
        gone = out.select("id")
        rest = edges.join(gone, F.col("src") == F.col("id"), "left_anti").join(gone, F.col("dst") == F.col("id"), "left_anti")
        # A chain that leads from a vertex to itself needs no edge: its members are known by that.
        edges = scratch.table(rest.union(out.where("first <> last").select("first", "last")).distinct(), "edges")


def _inside(chain: DataFrame, known: DataFrame) -> DataFrame:
    """(id, component) of what the ``known`` components say of vertices taken out.

    Such a vertex belongs to a component if both its ends do, or if it leads from
    a vertex to itself; that vertex is then known too.
    """
    none = F.lit(None).cast("long")
    ends = chain.select(F.col("id").alias("of"), F.posexplode(F.array("first", "last")).alias("last", "id"))
    said = known.join(ends, "id").select(F.col("of").alias("id"), none.alias("first"), none.alias("last"), F.when(F.col("last") == 0, F.col("component")).alias("ca"), F.when(F.col("last") == 1, F.col("component")).alias("cb"))
    rows = chain.select("id", "first", "last", none.alias("ca"), none.alias("cb")).union(said)
    inside = rows.groupBy("id").agg(*(F.max(c).alias(c) for c in ("first", "last", "ca", "cb"))).where("first = last or ca = cb")
    own, origin = F.struct("id", F.coalesce("ca", "first").alias("component")), F.struct(F.col("first").alias("id"), F.col("first").alias("component"))
    return inside.select(F.inline(F.when(F.col("ca").isNull(), F.array(own, origin)).otherwise(F.array(own)))).distinct()


def _reach_first(edges: DataFrame, salt: int, loop: Loop) -> DataFrame:
    """(id, c): the vertex of the smallest salted hash from which each vertex can be reached."""
    links = Links(loop, edges)
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    state = loop.laid(loop.taken(ends.withColumn("c", F.struct(F.xxhash64("id", F.lit(salt)).alias("h"), F.col("id").alias("v"))).withColumn("new", F.lit(True))), "id")

    def step(now: DataFrame, _: dict) -> DataFrame:
        sent = links.reach(now.where("new").select("id", "c")).groupBy("id").agg(F.min("c").alias("m"))
        return now.join(sent, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), F.coalesce(F.col("m") < F.col("c"), F.lit(False)).alias("new"))

    done = loop.iterate(state, step, {"new": F.count_if("new")}, lambda m: m["new"] == 0, sys.maxsize)[0]
    links.close()
    return loop.given(done.select("id", F.col("c.v").alias("c")), "colour")


def _back(inner: DataFrame, colour: DataFrame, loop: Loop) -> DataFrame:
    """(id, component) of the vertices that reach their colour's origin within the colour."""
    links = Links(loop, inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    state = loop.laid(loop.taken(colour.select("id", "c", (F.col("id") == F.col("c")).alias("hit"), (F.col("id") == F.col("c")).alias("new"))), "id")

    def step(now: DataFrame, _: dict) -> DataFrame:
        sent = links.reach(now.where("new").select("id")).distinct().withColumn("sent", F.lit(True))
        return now.join(sent, "id", "left").select("id", "c", (F.col("hit") | F.col("sent").isNotNull()).alias("hit"), (~F.col("hit") & F.col("sent").isNotNull()).alias("new"))

    done = loop.iterate(state, step, {"new": F.count_if("new")}, lambda m: m["new"] == 0, sys.maxsize)[0]
    links.close()
    return loop.given(done.where("hit").select("id", F.col("c").alias("component")), "part")


def _tarjan(edges: list[tuple]) -> list[tuple]:
    """(vertex, smallest vertex of its component), with an explicit stack."""
    follow: dict = {}
    for a, b in edges:
        follow.setdefault(a, []).append(b)
        follow.setdefault(b, [])
    index, low, on, stack, out = {}, {}, set(), [], []
    for root in follow:
        if root in index:
            continue
        work = [(root, iter(follow[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, nexts = work[-1]
            for w in nexts:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(follow[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = [stack.pop()]
                    while members[-1] != v:
                        members.append(stack.pop())
                    on.difference_update(members)
                    least = min(members)
                    out += [(m, least) for m in members]
    return out


def component_histogram(components: Components, attribute: str, field: str | None = None) -> DataFrame:
    """(component, value, count, size): how often each string value occurs in a component.

    Only strings count (or, with ``field``, the string field of an object);
    components without any have one row with a null value.
    """
    graph = components.graph
    column = F.col(graph.require(attribute))
    kind = graph.vertices.schema[graph.require(attribute)].dataType
    if field is not None:
        if isinstance(kind, T.StructType):
            value, kind = column.getField(field), kind[field].dataType
        else:
            value = F.variant_get(column, f"$.{field}", "variant") if isinstance(kind, T.VariantType) else F.get_json_object(column, f"$.{field}")
            kind = T.VariantType() if isinstance(kind, T.VariantType) else T.StringType()
    else:
        value = column
    if isinstance(kind, T.VariantType):
        value = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    elif not isinstance(kind, T.StringType):
        value = F.lit(None).cast("string")
    rows = components.members.join(graph.vertices.select("id", value.alias("value")), "id")
    counts = rows.groupBy("component", "value").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("component").agg(F.sum("n").alias("size"))
    found = counts.where("value is not null").select("component", "value", F.col("n").alias("count"))
    return sizes.join(found, "component", "left").select("component", "value", "count", "size")


def aggregate_components(components: Components, attribute: str, field: str | None = None) -> DataFrame:
    """(_key, representative, size, aggregation): a map from value to count for each component."""
    flat = component_histogram(components, attribute, field)
    pairs = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("value", "count"))))
    return flat.groupBy("component").agg(F.first("size").alias("size"), F.map_from_entries(pairs).alias("aggregation")).select(F.col("component").cast("string").alias("_key"), F.col("component").alias("representative"), "size", "aggregation")
