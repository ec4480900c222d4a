"""The superstep driver: tables that keep one layout, one action a step, an end when it settles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from graphloom.runtime import Scratch, delete_path, shared_root

#: A vertex with more than one in so many links, and more than HUB_LINKS, is a hub: there are fewer than HUB_SHARE of them.
HUB_SHARE, HUB_LINKS = 1000, 10_000
_COPIED = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.caseSensitive")


class Cancelled(RuntimeError):
    """Raised between supersteps once a job has been cancelled."""


def as_data(value: float | int, row: Column) -> Column:
    """``value`` as data of the plan. A constant would stand in the generated code, which is then compiled anew whenever it changes; ``row``, any column without nulls, keeps it from being folded into one."""
    return F.element_at(F.array(F.lit(value), F.lit(value)), F.when(row.isNull(), 2).otherwise(1))


class Loop:
    """The tables of one iteration: dealt by a key, sorted by it, and cut off from their lineage.

    They are dealt by hash into as many partitions as the session shuffles to and
    written by reliable checkpoints, which keep partitioning and order, so a join
    or an aggregate on the key moves and sorts nothing. That needs a session of
    its own without adaptive planning, which would merge partitions; hot keys,
    for which one would want it, are ``Links``' business.
    """

    def __init__(self, spark: SparkSession, name: str, cancelled: Callable[[], bool] | None = None, report: Callable[[int], None] | None = None):
        shared_root(spark)
        self.user, self.scratch, self.cancelled, self.report = spark, Scratch(spark, name), cancelled, report
        self.session = spark.newSession()
        for key in _COPIED:
            self.session.conf.set(key, spark.conf.get(key))
        self.session.conf.set("spark.sql.adaptive.enabled", "false")
        self.session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        self.session.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        self.parts = int(self.session.conf.get("spark.sql.shuffle.partitions"))

    def taken(self, df: DataFrame) -> DataFrame:
        """A table of the user's session, written, as one of this session."""
        return self.session.read.schema(df.schema).parquet(self.scratch.write(df, "in"))

    def laid(self, df: DataFrame, *keys: str) -> DataFrame:
        """A table of this session, dealt and sorted by ``keys``."""
        return self.cut(df.repartition(self.parts, *keys).sortWithinPartitions(*keys))

    def cut(self, df: DataFrame) -> DataFrame:
        return df.checkpoint()

    def drop(self, df: DataFrame) -> None:
        """Delete a table that ``cut`` made."""
        delete_path(self.user, df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())

    def given(self, df: DataFrame, name: str = "out") -> DataFrame:
        """A table of this session, written, as one of the user's."""
        return self.user.read.schema(df.schema).parquet(self.scratch.write(df, name))

    def check(self, steps: int = 0) -> None:
        if self.cancelled and self.cancelled():
            raise Cancelled(f"cancelled after {steps} supersteps")
        if self.report:
            self.report(steps)

    def iterate(self, start: DataFrame, step: Callable[[DataFrame, dict], DataFrame], metrics: dict[str, Column], done: Callable[[dict], bool], supersteps: int, first: dict | None = None) -> tuple[DataFrame, int]:
        """State after at most ``supersteps`` steps, and the number of steps made.

        ``step`` gets the state and the metrics of the step before. Writing a
        state is one action, which also observes its metrics; the state before
        is then dropped.
        """
        state, seen, steps = start, dict(first or {}), 0
        while steps < supersteps:
            self.check(steps)
            watch = Observation()
            new = self.cut(step(state, seen).observe(watch, *(c.alias(k) for k, c in metrics.items())))
            seen = watch.get
            self.drop(state)
            state = new
            steps += 1
            if done(seen):
                break
        return state, steps


class Links:
    """Links (src, dst, ...) from vertices to others, written and dealt by source.

    Hubs' links are dealt by both ends instead and meet the hubs' rows in a
    broadcast of fewer than ``HUB_SHARE`` rows, so that no task holds a vertex
    with a large part of all links.
    """

    def __init__(self, loop: Loop, df: DataFrame):
        plain = loop.taken(df)
        n = plain.count()
        self.loop, self.hubs = loop, []
        if n > HUB_LINKS:
            self.hubs = [r.src for r in plain.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(HUB_LINKS, n / HUB_SHARE)).collect()]
        hub = F.col("src").isin(self.hubs) if self.hubs else F.lit(False)
        self.few = loop.laid(plain.where(~hub), "src")
        self.many = loop.laid(plain.where(hub), "src", "dst") if self.hubs else None

    def reach(self, state: DataFrame) -> DataFrame:
        """For each link from a row of ``state`` (id, ...): its target as id, and the other columns of both."""
        others = [c for c in state.columns if c != "id"]
        mine = [c for c in self.few.columns if c not in ("src", "dst")]
        rows = state.withColumnRenamed("id", "src")
        out = self.few.join(rows, "src").select(F.col("dst").alias("id"), *mine, *others)
        if self.hubs:
            hubs = F.broadcast(rows.where(F.col("src").isin(self.hubs)))
            out = out.union(self.many.join(hubs, "src").select(F.col("dst").alias("id"), *mine, *others))
        return out

    def degrees(self, name: str) -> DataFrame:
        """(id, name): the sum of a vertex's ``times`` as a source, where it has links."""
        sums = lambda t: t.groupBy(F.col("src").alias("id")).agg(F.sum("times").alias(name))
        return sums(self.few).union(sums(self.many)) if self.hubs else sums(self.few)

    def close(self) -> None:
        for table in (self.few, self.many):
            if table is not None:
                self.loop.drop(table)


class Numbered:
    """A graph whose vertices are numbers in the order of their ids; edges are taken to end in vertices.

    Ids that are whole numbers stay what they are. ``edges`` is a plan, for one use.
    """

    def __init__(self, graph, scratch: Scratch):
        self.graph = graph
        self.kind = graph.vertices.schema["id"].dataType.simpleString()
        if self.kind in ("bigint", "int", "smallint", "tinyint"):
            self.ids, self.vertices = None, graph.vertices.select(F.col("id").cast("long").alias("id"))
            self.edges = graph.edges.where("src is not null and dst is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
            return
        # Ranges in ascending order, sorted within: a row's place grows with its id. Written before it is used.
        ordered = graph.vertices.select("id").repartitionByRange("id").sortWithinPartitions("id")
        places = scratch.table(ordered.select(F.monotonically_increasing_id().alias("place"), "id"), "ids")
        # From places in ranges to 0, 1, 2, ..., so that numbers do not depend on the ranges; one row for each range.
        sizes = sorted(places.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
        before = [(r.part, sum(x.n for x in sizes[:k])) for k, r in enumerate(sizes)]
        offsets = graph.vertices.sparkSession.createDataFrame(before, "part long, before long")
        numbered = places.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(offsets), "part")
        self.ids = numbered.select((F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("vid"), "id")
        self.vertices = self.ids.select(F.col("vid").alias("id"))
        end = lambda c: self.ids.select(F.col("vid").alias(f"{c}_n"), F.col("id").alias(c))
        numbers = graph.edges.select("src", "dst").join(end("src"), "src").join(end("dst"), "dst")
        self.edges = numbers.select(F.col("src_n").alias("src"), F.col("dst_n").alias("dst"))

    def of(self, rows: DataFrame) -> DataFrame:
        """``rows`` (id, ...) of vertices with their numbers as id."""
        if self.ids is None:
            return rows.withColumn("id", F.col("id").cast("long"))
        return rows.join(self.ids, "id").drop("id").withColumnRenamed("vid", "id").select(rows.columns)

    def named(self, rows: DataFrame, *columns: str) -> DataFrame:
        """``rows`` with ids instead of numbers in ``columns``."""
        for c in columns or ("id",):
            if self.ids is None:
                rows = rows.withColumn(c, F.col(c).cast(self.kind))
            else:
                names = self.ids.select(F.col("vid").alias(c), F.col("id").alias("_name"))
                rows = rows.join(names, c, "left").select(*(F.col("_name").alias(c) if x == c else x for x in rows.columns))
        return rows
