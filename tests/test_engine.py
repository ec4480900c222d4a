import time

import pytest

from graphloom.engine import Engine
from graphloom.graph import GraphError, PropertyGraph


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    yield e
    e.shutdown()


@pytest.fixture
def graph_id(spark, engine):
    return engine.register(PropertyGraph.create(spark, list("ABCD"), [("A", "B"), ("B", "A"), ("C", "D")], kind=list("xyxx")))


def test_jobs(spark, engine, graph_id, tmp_path):
    jobs = {
        "WCC": engine.wcc(graph_id),
        "SCC": engine.scc(graph_id),
        "pagerank": engine.pagerank(graph_id),
        "linerank": engine.linerank(graph_id),
        "Label Propagation": engine.labelpropagation(graph_id, "kind"),
        "Attribute Propagation": engine.attributepropagation(graph_id, "@id", True),
        "Custom": engine.custom(graph_id, lambda e: {"A": 1.0}),
    }
    for kind, job in jobs.items():
        info = engine.job(job).wait().info()
        assert info["comp_type"] == kind and not info["error"], info
        assert info["progress"] == info["total"] and info["runtime_in_microseconds"] > 0
        assert engine.results(job).count() == 4
    assert engine.results(jobs["WCC"], ["A"]).count() == 1
    total = engine.aggregate_components(graph_id, jobs["SCC"], "kind")
    assert engine.results(total).count() == 3
    with pytest.raises(GraphError):
        engine.aggregate_components(graph_id, jobs["pagerank"], "kind")
    stored = engine.store([jobs["WCC"], jobs["pagerank"]], ["component", "rank"], f"file://{tmp_path}/out")
    assert not engine.job(stored).wait().error
    assert set(spark.read.parquet(f"file://{tmp_path}/out").columns) == {"id", "component", "rank"}
    assert len(engine.jobs()) == engine.statistics()["jobs_started"] == 9
    engine.drop_job(stored)
    with pytest.raises(KeyError):
        engine.job(stored)
    assert any("finished" in x for x in engine.logs())


def test_load_and_drop(spark, engine):
    spark.createDataFrame([("v/1",), ("v/2",)], "_id string").createOrReplaceTempView("t_v")
    spark.createDataFrame([("v/1", "v/2")], "_from string, _to string").createOrReplaceTempView("t_e")
    job, graph = engine.load_sql("SELECT * FROM t_v", "SELECT * FROM t_e")
    info = engine.job(job).wait().info()
    assert info["graph_id"] == graph and info["progress"] == 2
    assert engine.graph_info(graph)["number_of_edges"] == 1 and len(engine.graphs()) == 1
    rank = engine.pagerank(graph)
    engine.drop_graph(graph)
    assert engine.results(rank).count() == 2
    with pytest.raises(KeyError):
        engine.graph(graph)


def test_failures(engine, graph_id):
    job, graph = engine.load(graph_name={"edgeDefinitions": []})
    assert engine.job(job).wait().error
    with pytest.raises(GraphError):
        engine.wcc(graph)
    bad = engine.irank(graph_id)
    assert "attribute" in engine.job(bad).wait().error
    with pytest.raises(GraphError):
        engine.results(bad)
    with pytest.raises(GraphError):
        engine.attributepropagation(graph_id, "")
    with pytest.raises(GraphError):
        engine.store([1], [])
    with pytest.raises(KeyError):
        engine.wcc(99)
    assert engine.version()["api_min_version"] == 1


def test_cancel(spark, engine, graph_id):
    """A job that would run for hours ends at once, inside a Spark job as well as between steps."""

    def endless(vertices, edges):
        return spark.range(1 << 40).selectExpr("string(id) as id", "double(hash(id)) as result").groupBy("id").max("result").withColumnRenamed("max(result)", "result")

    pair = PropertyGraph.create(spark, ["A", "B"], [("A", "B")], label=["a", "b"])  # its labels swap for ever
    number = engine.register(pair)
    jobs = [engine.custom(graph_id, endless, "spark"), engine.labelpropagation(number, "label", True, maximum_supersteps=1 << 40)]
    time.sleep(4)
    assert not any(engine.job(j).done for j in jobs)
    for j in jobs:
        engine.cancel(j)
    for j in jobs:
        done = engine.job(j).wait(60)
        assert done.error == "cancelled" and done.runtime < 60 and done.info()["error"]
        with pytest.raises(GraphError):
            engine.results(j)


def test_progress(spark, engine):
    number = engine.register(PropertyGraph(spark.range(2000), spark.range(1999).selectExpr("id as src", "id + 1 as dst")))
    job = engine.wcc(number)
    seen = set()
    while not engine.job(job).done:
        seen.add(engine.job(job).progress)
        time.sleep(0.05)
    assert engine.wait(job).progress == 100 and len(seen) > 3 and max(seen) < 100
