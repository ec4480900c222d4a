"""The registered graph queries, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.values import label_list, label_text
from graphloom.graph import COLLECTION, PropertyGraph
from graphloom.operators.components import aggregate_components, component_histogram, strongly_connected_components, weakly_connected_components
from graphloom.operators.custom import custom
from graphloom.operators.propagate import attribute_propagation, label_propagation
from graphloom.operators.rank import i_rank, line_rank, page_rank
from graphloom.engine import Engine
from graphloom.plans.fixtures import geography, journeys, orders_and_parts, users
from graphloom.runtime import scratch_path
from graphloom.sources import generators, readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
STEPS, DAMPING = 10, 0.85

# -- fixture graphs in SQL

USERS = """
v AS (SELECT DISTINCT user_id AS id FROM events),
e AS (SELECT DISTINCT a.user_id AS src, b.user_id AS dst FROM events a JOIN events b ON b.event_id = a.event_id + 1
      WHERE a.user_id <> b.user_id)"""
JOURNEYS = """
j AS (SELECT event_id AS id, user_id, event_type AS kind, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next,
             CASE WHEN event_type = 'error' THEN max(event_id) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS back FROM events),
v AS (SELECT id FROM j),
e AS (SELECT id AS src, next AS dst FROM j WHERE next IS NOT NULL UNION ALL SELECT id, back FROM j WHERE back IS NOT NULL)"""
OPS = """
v AS (SELECT 'O/' || o_orderkey AS id, 'O' AS c FROM orders UNION ALL SELECT 'P/' || p_partkey, 'P' FROM part),
e AS (SELECT 'O/' || l_orderkey AS src, 'P/' || l_partkey AS dst FROM lineitem)"""
GEO = """
v AS (SELECT 'region/' || r_regionkey AS id, 'region' AS c FROM region UNION ALL SELECT 'nation/' || n_nationkey, 'nation' FROM nation
      UNION ALL SELECT 'customer/' || c_custkey, 'customer' FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, 'supplier' FROM supplier
      UNION ALL SELECT 'orders/' || o_orderkey, 'orders' FROM orders),
e AS (SELECT 'nation/' || n_nationkey AS src, 'region/' || n_regionkey AS dst FROM nation UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer
      UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier UNION ALL SELECT 'orders/' || o_orderkey, 'customer/' || o_custkey FROM orders)"""


def rank_sql(graph: str, steps: int, by_collection: bool) -> str:
    base = "1.0::DOUBLE / count(*) OVER (PARTITION BY c)" if by_collection else "1.0::DOUBLE / count(*) OVER ()"
    parts = [
        f"WITH {graph.strip()}",
        "d AS MATERIALIZED (SELECT src, count(*) AS o FROM e GROUP BY src)",
        f"r0 AS MATERIALIZED (SELECT id, {base} AS base, {base} AS rank FROM v)",
    ]
    for k in range(steps):
        parts.append(
            f"r{k + 1} AS MATERIALIZED (SELECT v.id, v.base, {1 - DAMPING!r} * v.base + coalesce(m.s, 0) + {DAMPING} * k.s / k.n AS rank FROM r{k} v"
            f" LEFT JOIN (SELECT dst, sum({DAMPING} * rank / o) AS s FROM e JOIN r{k} ON src = id JOIN d USING (src) GROUP BY dst) m ON m.dst = v.id,"
            f" (SELECT coalesce(sum(rank) FILTER (d.src IS NULL), 0) AS s, count(*) AS n FROM r{k} LEFT JOIN d ON d.src = r{k}.id) k)"
        )
    return ",\n".join(parts) + f"\nSELECT id, round(rank, 9) AS rank FROM r{steps}"


def line_rank_sql(steps: int) -> str:
    parts = [
        f"WITH {JOURNEYS.strip()}",
        "m AS (SELECT count(*) AS m FROM e)",
        "d AS (SELECT src, count(*) AS o FROM e GROUP BY src)",
        "x0 AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / m AS x FROM e, m)",
    ]
    for k in range(steps):
        parts.append(
            f"x{k + 1} AS MATERIALIZED (SELECT a.src, a.dst, coalesce({DAMPING} * s.s / d.o, 0) + {1 - DAMPING!r} / m AS x FROM x{k} a"
            f" LEFT JOIN (SELECT src, sum(x) AS s FROM x{k} GROUP BY src) s ON s.src = a.dst LEFT JOIN d ON d.src = a.dst, m)"
        )
    ends = f"SELECT src AS id, x FROM x{steps} UNION ALL SELECT dst, x FROM x{steps}"
    return ",\n".join(parts) + f"\nSELECT v.id, round(coalesce(sum(x), 0), 9) AS rank FROM v LEFT JOIN ({ends}) t ON t.id = v.id GROUP BY v.id"


BOTH_WAYS = "s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
#: A journey is one weak component. Two events in a row are strongly connected if an error after the first leads back to it or before it.
WCC_JOURNEYS = f"WITH {JOURNEYS.strip()},\ncc AS (SELECT id, kind, min(id) OVER (PARTITION BY user_id) AS component FROM j)"
SCC_JOURNEYS = f"""WITH {JOURNEYS.strip()},
on_ AS (SELECT id, user_id, kind, coalesce(min(back) OVER (PARTITION BY user_id ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) <= id, FALSE) AS on_ FROM j),
cut AS (SELECT *, NOT coalesce(lag(on_) OVER (PARTITION BY user_id ORDER BY id), FALSE) AS starts FROM on_),
cc AS (SELECT id, kind, max(CASE WHEN starts THEN id END) OVER (PARTITION BY user_id ORDER BY id) AS component FROM cut)"""


def label_sql(steps: int, graph: str = USERS, label: str = "lpad(id::VARCHAR, 8, '0')") -> str:
    parts = [f"WITH {graph.strip()}", "s AS MATERIALIZED (SELECT src AS id, dst AS nbr FROM e UNION ALL SELECT dst, src FROM e)", f"l0 AS MATERIALIZED (SELECT id, {label} AS label FROM v)"]
    for k in range(steps):
        parts.append(
            f"l{k + 1} AS MATERIALIZED (SELECT a.id, coalesce(w.label, a.label) AS label FROM l{k} a LEFT JOIN (SELECT id, label FROM (SELECT s.id, label, row_number() OVER (PARTITION BY s.id ORDER BY count(*) DESC, label) AS n"
            f" FROM s JOIN l{k} x ON x.id = s.nbr GROUP BY s.id, label) WHERE n = 1) w ON w.id = a.id)"
        )
    return ",\n".join(parts) + f"\nSELECT id, label FROM l{steps}"


def _as_table(sql: str, name: str) -> str:
    """The common tables of a query, and its result as one more of them."""
    head, last = sql.rsplit("\n", 1)
    return head.removeprefix("WITH ").removeprefix(",").lstrip() + f",\n{name} AS ({last})"


def attribute_sql(backwards: bool) -> str:
    a, b = ("dst", "src") if backwards else ("src", "dst")
    return f"""WITH RECURSIVE {USERS.strip()},
r(id, label) AS (SELECT id, lpad(id::VARCHAR, 8, '0') FROM v WHERE id % 3 = 0 UNION SELECT e.{b}, r.label FROM r JOIN e ON e.{a} = r.id)
SELECT v.id, count(label) AS n_labels, coalesce(string_agg(label, ',' ORDER BY label), '') AS labels FROM v LEFT JOIN r USING (id) GROUP BY v.id"""


def _ranks(ranks: DataFrame) -> DataFrame:
    return ranks.select("id", F.round("rank", 9).alias("rank"))


def _flat_labels(df: DataFrame) -> DataFrame:
    return df.select("id", F.size("labels").cast("long").alias("n_labels"), F.array_join("labels", ",").alias("labels"))


# -- queries


def q_pagerank(spark, d):
    return _ranks(page_rank(orders_and_parts(spark, d), STEPS, DAMPING).ranks)


def q_pagerank_top(spark, d):
    ranks = _ranks(page_rank(journeys(spark, d), STEPS, DAMPING).ranks)
    return ranks.orderBy(F.desc("rank"), "id").limit(20)


def q_irank(spark, d):
    return _ranks(i_rank(geography(spark, d), STEPS, DAMPING).ranks)


def q_linerank(spark, d):
    return _ranks(line_rank(journeys(spark, d), STEPS, DAMPING).ranks)


def q_wcc(spark, d):
    return weakly_connected_components(journeys(spark, d)).members


def q_wcc_ops(spark, d):
    """Sizes of the components of the orders and parts."""
    members = weakly_connected_components(orders_and_parts(spark, d)).members
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n_components"))


def q_scc(spark, d):
    return strongly_connected_components(journeys(spark, d)).members


def q_scc_distributed(spark, d):
    """Without the finish on the driver."""
    return strongly_connected_components(journeys(spark, d), local_edges=0).members


def q_aggregate_wcc(spark, d):
    flat = component_histogram(weakly_connected_components(journeys(spark, d)), "kind")
    return flat.select("component", "value", F.col("count").alias("n"), "size")


def q_aggregate_scc(spark, d):
    """The map form of the aggregation, one text for each component."""
    out = aggregate_components(strongly_connected_components(journeys(spark, d)), "kind")
    entries = F.transform(F.map_entries("aggregation"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("_key", "representative", "size", F.array_join(F.array_sort(entries), ",").alias("aggregation"))


def q_label_sync(spark, d):
    return label_propagation(users(spark, d), "label", 5).labels


def q_label_random(spark, d):
    return label_propagation(users(spark, d), "label", 5, random_tiebreak=True, seed=3).labels


def q_label_async(spark, d):
    return label_propagation(users(spark, d), "label", synchronous=False).labels


def q_label_async_batched(spark, d):
    return label_propagation(journeys(spark, d), "@id", 2, synchronous=False, sequential_edges=0).labels


def q_attribute_forward(spark, d):
    return _flat_labels(attribute_propagation(users(spark, d), "seed", synchronous=False).labels)


def q_attribute_backward(spark, d):
    return _flat_labels(attribute_propagation(users(spark, d), "seed", backwards=True, synchronous=False).labels)


def q_attribute_id(spark, d):
    g = users(spark, d)
    return _flat_labels(attribute_propagation(PropertyGraph(g.vertices.select("id"), g.edges), "@id", 3).labels)


def q_degrees(spark, d):
    g = orders_and_parts(spark, d)
    return g.out_degrees().join(g.in_degrees(), "id")


def q_neighbours(spark, d):
    g = orders_and_parts(spark, d)
    return g.out_neighbours("O/1").withColumn("way", F.lit("out")).union(g.in_neighbours("P/1").withColumn("way", F.lit("in")))


def q_dangling(spark, d):
    g = orders_and_parts(spark, d)
    half = PropertyGraph(g.vertices.where("id not like '%7'"), g.edges)
    return half.dangling_edges().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def q_validated(spark, d):
    """Edges that stay when a part of the vertices is missing and others come twice."""
    g = orders_and_parts(spark, d)
    kept = PropertyGraph.validated(g.vertices.where("id not like '%7'").union(g.vertices.where("id like '%1'")), g.edges)
    return spark.createDataFrame([(kept.vertex_count, kept.edge_count)], "n_vertices long, n_edges long")


def q_symmetrised(spark, d):
    return users(spark, d).symmetrised().groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("dst").alias("total"))


def q_subgraph(spark, d):
    g = geography(spark, d).subgraph(F.col(COLLECTION).isin("customer", "nation"), None)
    return g.edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


def q_collections(spark, d):
    g = geography(spark, d)
    plain = PropertyGraph(g.vertices.select("id"), g.edges).with_collections()
    return plain.vertices.groupBy(F.col(COLLECTION).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def q_labels_text(spark, d):
    """Start labels of either propagation from numbers, nulls, empty strings and lists."""
    t = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id")
    mixed = t.select("event_id", F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("number"), F.when(F.col("user_id") % 3 == 0, F.array(F.lit("a"), F.lit(""), F.lit(None).cast("string"), F.lit("b"))).alias("list"))
    kinds = mixed.schema
    return mixed.select("event_id", label_text(F.col("number"), kinds["number"].dataType).alias("text"), F.array_join(label_list(F.col("list"), kinds["list"].dataType), ",").alias("labels"))


def q_load_json(spark, d):
    """Documents written as JSON Lines, loaded by a graph definition, ranked."""
    g, path = geography(spark, d), scratch_path(spark, "load_json")
    g.vertices.select(F.col("id").alias("_id"), F.col(COLLECTION).alias("kind")).write.json(f"{path}/things")
    g.edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to")).write.json(f"{path}/links")
    definition = {"name": "geo", "edgeDefinitions": [{"collection": "links", "from": ["things"], "to": ["things"]}, {"collection": "links", "from": ["things"], "to": ["things"]}]}
    loaded = readers.load(spark, definition, root=path, vertex_attributes=["kind", COLLECTION])
    return loaded.in_degrees().join(loaded.vertices, "id").groupBy("kind", F.col(COLLECTION).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum("in_degree").alias("in_edges"))


def q_load_sql(spark, d):
    spark.read.parquet(f"{d}/nation.parquet").createOrReplaceTempView("graphloom_nation")
    spark.read.parquet(f"{d}/customer.parquet").createOrReplaceTempView("graphloom_customer")
    g = readers.from_sql(
        spark,
        "SELECT concat('n/', n_nationkey) AS _id, n_name AS name FROM graphloom_nation UNION ALL SELECT concat('c/', c_custkey), NULL FROM graphloom_customer",
        "SELECT concat('c/', c_custkey) AS _from, concat('n/', c_nationkey) AS _to FROM graphloom_customer",
    )
    return g.in_degrees().join(g.vertices.where("name is not null"), "id").select("name", "in_degree")


def q_load_ldbc(spark, d):
    """Plain id and edge files with counts, loaded and checked."""
    g, path = users(spark, d), scratch_path(spark, "load_ldbc")
    n, m = g.vertex_count, g.edge_count
    g.vertices.select(F.col("id").cast("string").alias("value")).write.text(f"{path}/u.v")
    g.edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(f"{path}/u.e")
    spark.createDataFrame([(f"graph.u.meta.vertices = {n}",), (f"graph.u.meta.edges = {m}",)], "value string").write.text(f"{path}/u.properties")
    return readers.from_ldbc(spark, f"{path}/u").out_degrees()


def q_store(spark, d):
    """Two results side by side, written, then updated with a third."""
    g, path = journeys(spark, d), scratch_path(spark, "store")
    sinks.store([g.out_degrees(), g.in_degrees()], ["o", "i"], path)
    return sinks.store([weakly_connected_components(g).members], ["component"], path, mode="update")


def q_custom_spark(spark, d):
    """A user function over DataFrames: mutual edges of each vertex."""

    def mutual(vertices: DataFrame, edges: DataFrame) -> DataFrame:
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return edges.join(back, ["src", "dst"], "left_semi").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("result"))

    return custom(users(spark, d), mutual, "spark", "long")


def q_custom_component(spark, d):
    """A user function over each component's edges, on the executors."""
    return custom(journeys(spark, d), _ends_of_component, "component", "long")


def _ends_of_component(edges):
    import pandas as pd

    ends = pd.concat([edges["src"], edges["dst"]])
    return pd.DataFrame({"id": ends.unique(), "result": len(edges)})


def q_custom_local(spark, d):
    return custom(users(spark, d), lambda edges: edges.groupby("src").size().to_dict(), "local", "long")


def q_generators(spark, d):
    """Ranks of the star, whose hub gathers almost half, and sizes of the others."""
    star = page_rank(generators.star(spark, 10), 100, DAMPING)
    rows = [(g.name, g.vertex_count, g.edge_count) for g in (generators.cycle(spark, 10), generators.binary_tree(spark, 5), generators.complete(spark, 5))]
    sizes = spark.createDataFrame(rows, "name string, n_vertices long, n_edges long").withColumn("rank", F.lit(None).cast("double"))
    hub = star.ranks.where("id = 'V/K9'").select(F.lit("star").alias("name"), F.lit(10).cast("long").alias("n_vertices"), F.lit(star.steps).cast("long").alias("n_edges"), F.round("rank", 5).alias("rank"))
    return sizes.union(hub)


def q_engine_store(spark, d):
    """A service session: load collections, rank, find components and communities, store them side by side."""
    g, path = geography(spark, d), scratch_path(spark, "engine")
    g.vertices.select(F.col("id").alias("_id")).write.parquet(f"{path}/things")
    g.edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to")).write.parquet(f"{path}/links")
    e = Engine(spark)
    try:
        load, graph = e.load(vertex_collections=["things"], edge_collections=["links"], database=path, fmt="parquet", vertex_attributes=[COLLECTION])
        e.wait(load)
        jobs = [e.irank(graph, STEPS, DAMPING), e.wcc(graph), e.labelpropagation(graph, "@id", synchronous=True, maximum_supersteps=3)]
        e.wait(e.store(jobs, ["rank", "component", "label"], f"{path}/out"))
        e.drop_graph(graph)
    finally:
        e.shutdown()
    return spark.read.parquet(f"{path}/out").select("id", F.round("rank", 9).alias("rank"), "component", "label")


def q_engine_aggregate(spark, d):
    """A service session over queries: strong components of the journeys, and what kinds of events they hold."""
    g = journeys(spark, d)
    g.vertices.createOrReplaceTempView("graphloom_events")
    g.edges.createOrReplaceTempView("graphloom_ways")
    e = Engine(spark)
    try:
        load, graph = e.load_sql("SELECT id AS _id, kind FROM graphloom_events", "SELECT src AS _from, dst AS _to FROM graphloom_ways")
        e.wait(load)
        components = e.scc(graph)
        out = e.results(e.aggregate_components(graph, components, "kind"))
    finally:
        e.shutdown()
    entries = F.transform(F.map_entries("aggregation"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return out.select("_key", "size", F.array_join(F.array_sort(entries), ",").alias("aggregation"))


def q_memory(spark, d):
    g = users(spark, d)
    return spark.createDataFrame([(g.vertex_count, g.edge_count, g.memory_bytes() > 0)], "n_vertices long, n_edges long, known boolean")


QUERIES: dict[str, Query] = {
    "pagerank": q_pagerank,
    "pagerank_top": q_pagerank_top,
    "irank": q_irank,
    "linerank": q_linerank,
    "wcc": q_wcc,
    "wcc_sizes": q_wcc_ops,
    "scc": q_scc,
    "scc_distributed": q_scc_distributed,
    "aggregate_wcc": q_aggregate_wcc,
    "aggregate_scc": q_aggregate_scc,
    "label_propagation_sync": q_label_sync,
    "label_propagation_random": q_label_random,
    "label_propagation_async": q_label_async,
    "label_propagation_async_batched": q_label_async_batched,
    "attribute_propagation_forward": q_attribute_forward,
    "attribute_propagation_backward": q_attribute_backward,
    "attribute_propagation_id": q_attribute_id,
    "degrees": q_degrees,
    "neighbours": q_neighbours,
    "dangling_edges": q_dangling,
    "validated_graph": q_validated,
    "symmetrised": q_symmetrised,
    "subgraph": q_subgraph,
    "collections": q_collections,
    "start_labels": q_labels_text,
    "load_json": q_load_json,
    "load_sql": q_load_sql,
    "load_ldbc": q_load_ldbc,
    "store": q_store,
    "custom_spark": q_custom_spark,
    "custom_component": q_custom_component,
    "custom_local": q_custom_local,
    "generators": q_generators,
    "memory": q_memory,
    "engine_store": q_engine_store,
    "engine_aggregate": q_engine_aggregate,
}

_HISTOGRAM = "h AS (SELECT component, kind AS value, count(*) AS n FROM cc GROUP BY ALL), z AS (SELECT component, sum(n)::BIGINT AS size FROM h GROUP BY component)"
ORACLES: dict[str, str] = {
    "pagerank": rank_sql(OPS, STEPS, False),
    "pagerank_top": rank_sql(JOURNEYS, STEPS, False) + " ORDER BY rank DESC, id LIMIT 20",
    "irank": rank_sql(GEO, STEPS, True),
    "linerank": line_rank_sql(STEPS),
    "wcc": WCC_JOURNEYS + "\nSELECT id, component FROM cc",
    "wcc_sizes": f"""WITH RECURSIVE {OPS.strip()},
{BOTH_WAYS},
cc(id, component) USING KEY (id) AS (
  SELECT id, id FROM v
  UNION
  SELECT s.src, min(n.component) FROM cc n JOIN s ON s.dst = n.id JOIN recurring.cc x ON x.id = s.src WHERE n.component < x.component GROUP BY s.src)
SELECT size, count(*) AS n_components FROM (SELECT component, count(*) AS size FROM cc GROUP BY component) GROUP BY size""",
    "scc": SCC_JOURNEYS + "\nSELECT id, component FROM cc",
    "scc_distributed": SCC_JOURNEYS + "\nSELECT id, component FROM cc",
    "aggregate_wcc": f"{WCC_JOURNEYS},\n{_HISTOGRAM}\nSELECT component, value, n, size FROM h JOIN z USING (component)",
    "aggregate_scc": f"{SCC_JOURNEYS},\n{_HISTOGRAM}\nSELECT component::VARCHAR AS _key, component AS representative, size, string_agg(value || '=' || n, ',' ORDER BY value) AS aggregation FROM h JOIN z USING (component) GROUP BY component, size",
    "label_propagation_sync": label_sql(5),
    "attribute_propagation_forward": attribute_sql(False),
    "attribute_propagation_backward": attribute_sql(True),
    "attribute_propagation_id": f"""WITH {USERS.strip()},
p0 AS (SELECT id, id::VARCHAR AS label FROM v), p1 AS (SELECT * FROM p0 UNION SELECT dst, label FROM p0 JOIN e ON src = id),
p2 AS (SELECT * FROM p1 UNION SELECT dst, label FROM p1 JOIN e ON src = id), p3 AS (SELECT * FROM p2 UNION SELECT dst, label FROM p2 JOIN e ON src = id)
SELECT id, count(*) AS n_labels, string_agg(label, ',' ORDER BY label) AS labels FROM p3 GROUP BY id""",
    "degrees": f"WITH {OPS.strip()}\nSELECT id, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree FROM v LEFT JOIN (SELECT src AS id, count(*) AS o FROM e GROUP BY src) USING (id) LEFT JOIN (SELECT dst AS id, count(*) AS i FROM e GROUP BY dst) USING (id)",
    "neighbours": f"WITH {OPS.strip()}\nSELECT dst AS id, 'out' AS way FROM e WHERE src = 'O/1' UNION ALL SELECT src, 'in' FROM e WHERE dst = 'P/1'",
    "dangling_edges": f"WITH {OPS.strip()}\nSELECT src, dst, count(*) AS n FROM e WHERE src NOT IN (SELECT id FROM v WHERE id NOT LIKE '%7') OR dst NOT IN (SELECT id FROM v WHERE id NOT LIKE '%7') GROUP BY src, dst",
    "validated_graph": f"WITH {OPS.strip()},\nk AS (SELECT id FROM v WHERE id NOT LIKE '%7')\nSELECT (SELECT count(*) FROM k) AS n_vertices, (SELECT count(*) FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)) AS n_edges",
    "symmetrised": f"WITH {USERS.strip()}\nSELECT src, count(*) AS n, sum(dst)::BIGINT AS total FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) GROUP BY src",
    "subgraph": f"WITH {GEO.strip()},\nk AS (SELECT id FROM v WHERE c IN ('customer', 'nation'))\nSELECT dst, count(*) AS n FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) GROUP BY dst",
    "collections": f"WITH {GEO.strip()}\nSELECT split_part(id, '/', 1) AS name, count(*) AS n FROM v GROUP BY 1",
    "start_labels": "SELECT event_id, coalesce(CASE WHEN user_id % 5 <> 0 THEN user_id::VARCHAR END, 'null') AS text, CASE WHEN user_id % 3 = 0 THEN 'a,b' ELSE '' END AS labels FROM events",
    "load_json": f"WITH {GEO.strip()}\nSELECT c AS kind, split_part(id, '/', 1) AS name, count(*) AS n, sum(coalesce(i, 0))::BIGINT AS in_edges FROM v LEFT JOIN (SELECT dst AS id, count(*) AS i FROM e GROUP BY dst) USING (id) GROUP BY 1, 2",
    "load_sql": "SELECT n_name AS name, count(c_custkey) AS in_degree FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name",
    "load_ldbc": f"WITH {USERS.strip()}\nSELECT v.id::VARCHAR AS id, count(src) AS out_degree FROM v LEFT JOIN e ON src = id GROUP BY v.id",
    "store": f"{WCC_JOURNEYS}\nSELECT cc.id, coalesce(o, 0) AS o, coalesce(i, 0) AS i, component FROM cc LEFT JOIN (SELECT src AS id, count(*) AS o FROM e GROUP BY src) USING (id) LEFT JOIN (SELECT dst AS id, count(*) AS i FROM e GROUP BY dst) USING (id)",
    "custom_spark": f"WITH {USERS.strip()}\nSELECT v.id, nullif(count(b.src), 0) AS result FROM v LEFT JOIN (SELECT x.src FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src) b ON b.src = v.id GROUP BY v.id",
    "custom_component": f"{WCC_JOURNEYS}\nSELECT cc.id, n AS result FROM cc LEFT JOIN (SELECT component, count(*) AS n FROM e JOIN cc ON src = id GROUP BY component) k USING (component)",
    "custom_local": f"WITH {USERS.strip()}\nSELECT v.id, nullif(count(src), 0) AS result FROM v LEFT JOIN e ON src = id GROUP BY v.id",
    "generators": "SELECT * FROM (VALUES ('cycle', 10::BIGINT, 10::BIGINT, NULL::DOUBLE), ('btree', 31, 30, NULL), ('complete', 5, 10, NULL), ('star', 10, 60, 0.49008)) t(name, n_vertices, n_edges, rank)",
    "engine_store": f"""WITH RECURSIVE {rank_sql(GEO, STEPS, True).removeprefix("WITH ").replace("SELECT id, round(rank, 9) AS rank FROM", "ranked AS (SELECT id, round(rank, 9) AS rank FROM").replace(chr(10) + "ranked", "," + chr(10) + "ranked")}),
{BOTH_WAYS},
cc(id, component) USING KEY (id) AS (
  SELECT id, id FROM v
  UNION
  SELECT s.src, min(n.component) FROM cc n JOIN s ON s.dst = n.id JOIN recurring.cc x ON x.id = s.src WHERE n.component < x.component GROUP BY s.src),
{_as_table(label_sql(3, "", "id"), "labelled").replace("s AS MATERIALIZED", "near AS MATERIALIZED").replace("FROM s JOIN", "FROM near s JOIN")}
SELECT id, rank, component, label FROM ranked JOIN cc USING (id) JOIN labelled USING (id)""",
    "engine_aggregate": f"{SCC_JOURNEYS},\n{_HISTOGRAM}\nSELECT component::VARCHAR AS _key, size, string_agg(value || '=' || n, ',' ORDER BY value) AS aggregation FROM h JOIN z USING (component) GROUP BY component, size",
    "memory": f"WITH {USERS.strip()}\nSELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM e) AS n_edges, TRUE AS known",
}
