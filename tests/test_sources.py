import json

import pandas as pd
import pyarrow as pa
import pytest

from graphloom.graph import GraphError, PropertyGraph
from graphloom.operators.custom import custom
from graphloom.sources import generators, readers, sinks


def write_lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


@pytest.fixture
def collections(tmp_path):
    write_lines(tmp_path / "v", [{"_id": "v/1", "name": "a", "n": 1}, {"_id": "v/2", "name": None}, {"_id": "v/2", "name": "b"}, {"name": "no id"}])
    write_lines(tmp_path / "w", [{"_id": "w/1", "x": 1.5}])
    write_lines(tmp_path / "e", [{"_from": "v/1", "_to": "w/1"}, {"_from": "v/1", "_to": "v/9"}, {"_from": "v/2", "_to": "v/2"}])
    return tmp_path


def test_load_collections(spark, collections):
    at = lambda *names: [f"file://{collections}/{n}" for n in names]
    g = readers.load(spark, vertex_collections=at("v", "w", "v"), edge_collections=at("e"), vertex_attributes=["name", "n", "@collectionname", "missing"], vertex_attribute_types=["string", "integer", "string", "float"])
    rows = {r.id: r for r in g.vertices.collect()}
    assert set(rows) == {"v/1", "v/2", "w/1"}
    assert rows["v/1"].n == 1 and rows["w/1"]["@collectionname"] == "w" and rows["w/1"].missing is None
    assert sorted((e.src, e.dst) for e in g.edges.collect()) == [("v/1", "w/1"), ("v/2", "v/2")]
    with pytest.raises(GraphError):
        readers.load(spark, vertex_collections=at("v", "w"), edge_collections=at("e"), dangling="error")
    with pytest.raises(GraphError):
        readers.load(spark, vertex_collections=at("v", "w"), edge_collections=at("e"), duplicates="error")


def test_load_definition(spark, collections):
    definition = {"edgeDefinitions": [{"collection": "e", "from": ["v"], "to": ["v", "w"]}]}
    (collections / "graph.json").write_text(json.dumps(definition))
    for d in (definition, f"file://{collections}/graph.json"):
        assert readers.load(spark, d, root=f"file://{collections}").edge_count == 2


@pytest.mark.parametrize("request_", [{}, {"graph_name": {"edgeDefinitions": []}}, {"vertex_collections": ["v"]}, {"graph_name": "g", "vertex_collections": ["v"]}])
def test_load_contradictions(spark, request_):
    with pytest.raises(GraphError):
        readers.load(spark, **request_)


def test_ldbc(spark, tmp_path):
    (tmp_path / "t.v").write_text("1\n2\n3\n\n")
    (tmp_path / "t.e").write_text("1 2\n2 3\n")
    (tmp_path / "t.properties").write_text("# graph\ngraph.t.meta.vertices = 3\ngraph.t.meta.edges = 2\n")
    (tmp_path / "t-PR").write_text("1 0.25\n2 0.5\n")
    g = readers.from_ldbc(spark, f"file://{tmp_path}/t", id_prefix="v/")
    assert g.edge_count == 2 and {r.id for r in g.vertices.collect()} == {"v/1", "v/2", "v/3"}
    assert readers.ldbc_results(spark, f"file://{tmp_path}/t-PR").count() == 2
    (tmp_path / "t.properties").write_text("graph.t.meta.vertices = 4\n")
    with pytest.raises(GraphError):
        readers.from_ldbc(spark, f"file://{tmp_path}/t")


def test_generators(spark):
    assert [(r.src, r.dst) for r in generators.cycle(spark, 2).edges.collect()] == [("V/K0", "V/K1"), ("V/K1", "V/K0")]
    assert generators.binary_tree(spark, 3).edge_count == 6
    assert generators.star(spark, 1).edge_count == 0
    assert generators.complete(spark, 5).edge_count == 10


def test_neighbours_and_degrees(spark):
    g = PropertyGraph.create(spark, list("ABCDEFG"), [("E", "B"), ("A", "D"), ("A", "C"), ("B", "G")])
    assert sorted(r.id for r in g.out_neighbours("A").collect()) == ["C", "D"]
    assert [r.id for r in g.in_neighbours("G").collect()] == ["B"]
    assert {r.id: r.out_degree for r in g.out_degrees().collect()} == {"A": 2, "B": 1, "C": 0, "D": 0, "E": 1, "F": 0, "G": 0}
    assert g.subgraph("id < 'D'").edge_count == 1
    assert g.reversed().edges.where("src = 'D'").first().dst == "A"
    assert g.persist().memory_bytes() > 0


def test_store(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, v long")
    b = spark.createDataFrame([("y", "q"), ("z", "r")], "id string, w string")
    out = f"file://{tmp_path}/out"
    got = {r.id: (r.a, r.b) for r in sinks.store([a, b], ["a", "b"], out).collect()}
    assert got == {"x": (1, None), "y": (2, "q"), "z": (None, "r")}
    again = sinks.store([a.selectExpr("id", "v * 10 as v")], ["a"], out, mode="update")
    assert {r.id: (r.a, r.b) for r in again.collect()} == {"x": (10, None), "y": (20, "q"), "z": (None, "r")}
    for names in ([], ["a", "a"], ["id", "b"]):
        with pytest.raises(ValueError):
            sinks.store([a, b], names, out)


def test_custom(spark):
    g = PropertyGraph.create(spark, list("ABCDEF"), [("D", "B"), ("A", "D"), ("A", "C"), ("B", "F")])
    count = lambda e: e.groupby("src").size()
    want = {"A": 2.0, "B": 1.0, "C": None, "D": 1.0, "E": None, "F": None}
    forms = [lambda e: count(e).to_dict(), lambda e: count(e).rename("Result").rename_axis("Node").reset_index(), lambda e: pa.Table.from_pandas(pd.DataFrame({"Node": list(count(e).index), "Result": list(count(e))}))]
    for fn in forms:
        assert {r.id: r.result for r in custom(g, fn).collect()} == want
    by_part = custom(g, lambda e: pd.DataFrame({"id": e["src"].unique(), "result": float(len(e))}), "component")
    assert {r.id: r.result for r in by_part.collect()} == {"A": 4.0, "B": 4.0, "C": None, "D": 4.0, "E": None, "F": None}


@pytest.mark.parametrize("bad", [lambda e: 3, lambda e: None, lambda e: pd.DataFrame({"a": [1]}), lambda e: 1 / 0, lambda: {}, lambda e: {"A": "no number"}, lambda e: e.missing, lambda e: [1, 2]])
def test_custom_bad_functions(spark, bad):
    g = PropertyGraph.create(spark, ["A"], [("A", "A")])
    with pytest.raises(Exception):  # noqa: B017
        custom(g, bad).collect()


def test_custom_limits(spark):
    g = PropertyGraph.create(spark, ["A"], [("A", "A")])
    with pytest.raises(ValueError):
        custom(g, lambda e: {}, max_local_edges=0)
    with pytest.raises(ValueError):
        custom(g, lambda e: {}, "elsewhere")
    with pytest.raises(TypeError):
        custom(g, "worker")


def test_custom_local_brings_all_edges(spark):
    many = PropertyGraph(spark.range(3), spark.range(1_200_000).selectExpr("id % 2 as src", "2L as dst"))
    got = custom(many, lambda e: e.groupby("src").size().to_dict(), "local", "long")
    assert {r.id: r.result for r in got.collect()} == {0: 600_000, 1: 600_000, 2: None}


def test_load_relative_to_a_database(spark, collections):
    g = readers.load(spark, vertex_collections=["v", "w"], edge_collections=["e"], database=f"file://{collections}", parallelism=5, batch_size=400_000)
    assert g.edge_count == 2
    named = {"edgeDefinitions": [{"collection": "e", "from": ["v"], "to": ["w"]}]}
    assert readers.load(spark, named, database=f"file://{collections}").edge_count == 2


def test_store_that_fails_leaves_the_target(spark, tmp_path):
    from pyspark.sql import functions as F

    path = f"file://{tmp_path}/out"
    ids = spark.range(5).select("id", F.col("id").alias("x"))
    sinks.store([ids], ["x"], path, mode="update")
    broken = spark.range(5).select("id", F.raise_error(F.lit("no")).cast("long").alias("y"))
    with pytest.raises(Exception, match="no"):
        sinks.store([broken], ["y"], path, mode="update")
    assert [tuple(r) for r in spark.read.parquet(path).orderBy("id").collect()] == [(i, i) for i in range(5)]
    out = sinks.store([spark.range(3, 7).select("id", (F.col("id") * 2).alias("x"))], ["x"], path, mode="update")
    assert sorted(tuple(r) for r in out.collect()) == [(0, 0), (1, 1), (2, 2), (3, 6), (4, 8), (5, 10), (6, 12)]
    import os

    assert os.listdir(tmp_path) == ["out"]


def test_files_for_programs_outside(spark, tmp_path):
    from graphloom.graph import GraphBuilder, GraphError

    b = GraphBuilder(["kind"])
    b.insert_vertex("a", kind="x")
    b.insert_vertex("b")
    b.insert_edge("a", "b")
    b.insert_edge("a", "nowhere", checked=False)
    for bad in (lambda: b.insert_edge("a", "nowhere"), lambda: b.insert_vertex("a"), lambda: b.insert_vertex("c", other=1)):
        with pytest.raises(GraphError):
            bad()
    g = b.seal(spark)
    assert g.vertex_count == 2 and [tuple(e) for e in g.edges.collect()] == [("a", "b")]
    sinks.write_edges(g, f"{tmp_path}/e")
    assert [(r._from, r._to) for r in spark.read.parquet(f"{tmp_path}/e").collect()] == [("a", "b")]
    sinks.write_results(g.out_degrees(), f"{tmp_path}/r")
    assert sorted(map(tuple, readers.read_results(spark, f"{tmp_path}/r").collect())) == [("a", 1), ("b", 0)]
    with pytest.raises(GraphError):
        readers.read_results(spark, f"{tmp_path}/e")
