import math

import pytest

from graphloom.graph import GraphError, PropertyGraph
from graphloom.operators.rank import i_rank, line_rank, page_rank
from graphloom.sources.generators import cycle, star


def ranks(r):
    return {x.id: x.rank for x in r.ranks.collect()}


def test_pagerank_star_converges(spark):
    r = page_rank(star(spark, 10), 100, 0.85)
    got = ranks(r)
    assert 50 < r.steps < 70
    assert 0.49 < got["V/K9"] < 0.50 and 0.05 < got["V/K0"] < 0.06
    assert math.isclose(sum(got.values()), 1, abs_tol=1e-9)


def test_pagerank_cycle_is_uniform_at_once(spark):
    r = page_rank(cycle(spark, 10), 5, 0.85)
    assert r.steps == 1
    assert all(math.isclose(x, 0.1) for x in ranks(r).values())


def test_pagerank_small(spark):
    g = PropertyGraph.create(spark, ["A", "B", "C", "D"], [("A", "A"), ("A", "B"), ("A", "C"), ("C", "B")])
    got = ranks(page_rank(g, 50, 0.85))
    assert math.isclose(got["A"], got["C"], rel_tol=1e-6)
    assert got["B"] > got["A"] > got["D"]


def test_pagerank_edge_cases(spark):
    empty = page_rank(PropertyGraph.create(spark, [], []), 5, 0.85)
    assert ranks(empty) == {} and empty.steps == 1
    two = page_rank(PropertyGraph.create(spark, ["A", "B"], []), 5, 0.85)
    assert ranks(two) == {"A": 0.5, "B": 0.5} and two.steps == 1
    still = page_rank(star(spark, 10), 5, 0.0)
    assert still.steps == 1 and all(math.isclose(x, 0.1) for x in ranks(still).values())
    none = page_rank(star(spark, 10), 0, 0.85)
    assert none.steps == 0 and all(math.isclose(x, 0.1) for x in ranks(none).values())


def test_pagerank_counts_parallel_edges(spark):
    g = PropertyGraph.create(spark, ["A", "B", "C"], [("A", "B"), ("A", "B"), ("A", "C")])
    got = ranks(page_rank(g, 1, 0.85))
    assert math.isclose(got["B"] - got["C"], 0.85 / 3 / 3)


def test_irank(spark):
    g = PropertyGraph.create(spark, ["V/A", "V/B", "W/C"], []).with_collections()
    assert ranks(i_rank(g, 0, 0.85)) == {"V/A": 0.5, "V/B": 0.5, "W/C": 1.0}
    halves = star(spark, 10)
    halves = PropertyGraph(halves.vertices.selectExpr("id", "if(id < 'V/K5', 'c', 'd') as `@collection_name`"), halves.edges)
    assert math.isclose(sum(ranks(i_rank(halves, 100, 0.85)).values()), 2.0, abs_tol=1e-6)
    with pytest.raises(GraphError):
        i_rank(star(spark, 3))


@pytest.mark.parametrize(
    ("ids", "edges", "want", "last"),
    [
        ("ABCD", ["AB", "BC", "BD"], [0.0925, 0.1925, 0.05, 0.05], 2),
        ("ABCD", ["AB", "BC", "CD"], [0.128625, 0.221125, 0.1425, 0.05], 3),
        ("ABC", ["AB", "BC", "CA"], [2 / 3] * 3, 0),
    ],
)
def test_linerank(spark, ids, edges, want, last):
    r = line_rank(PropertyGraph.create(spark, list(ids), [tuple(e) for e in edges]), 20, 0.85)
    got = ranks(r)
    assert r.last_step == last
    assert all(math.isclose(got[i], w, abs_tol=1e-9) for i, w in zip(ids, want, strict=True))


def test_ranks_of_many_do_not_settle_early(spark, monkeypatch):
    """Ranks far below 1e-7 move by less than that from the first step on."""
    from graphloom.operators import rank

    many = spark.range(30_000_000).selectExpr("id % 3 as src", "id % 3 + 1 as dst")
    r = line_rank(PropertyGraph(spark.range(4), many), 20, 0.85)
    got = ranks(r)
    assert r.last_step == 3
    assert all(math.isclose(got[i], w, abs_tol=1e-9) for i, w in enumerate([0.128625, 0.221125, 0.1425, 0.05]))
    monkeypatch.setattr(rank, "TOLERANCE", 0.1)
    assert page_rank(star(spark, 30), 5, 0.85).steps == 5


def test_hubs_make_no_difference(spark, monkeypatch):
    """Links of vertices with many are dealt apart; ranks, labels and attributes stay the same."""
    from graphloom.operators.propagate import attribute_propagation, label_propagation
    from graphloom.plans import superstep

    edges = [("hub", f"v{i}") for i in range(40)] + [(f"v{i}", "hub") for i in range(0, 40, 3)] + [(f"v{i}", f"v{(i * 7) % 40}") for i in range(40)]
    ids = ["hub", *(f"v{i}" for i in range(40)), "alone"]
    g = PropertyGraph.create(spark, ids, edges, tag=[i if len(i) == 2 else None for i in ids])

    def everything():
        out = [{r.id: round(r.rank, 12) for r in f(g).ranks.collect()} for f in (page_rank, line_rank)]
        out.append({r.id: r.label for r in label_propagation(g, "@id", 3).labels.collect()})
        out.append({r.id: r.labels for r in attribute_propagation(g, "tag").labels.collect()})
        return out

    plain = everything()
    monkeypatch.setattr(superstep, "HUB_LINKS", 5)
    monkeypatch.setattr(superstep, "HUB_SHARE", 10)
    assert superstep.Links(superstep.Loop(spark, "t"), g.edges).hubs == ["hub"]
    assert everything() == plain


def test_numbers_do_not_depend_on_partitions(spark):
    from graphloom.plans.superstep import Numbered
    from graphloom.runtime import Scratch

    ids = [f"x{i:03d}" for i in range(200)]
    for parts in (1, 7):
        g = PropertyGraph.create(spark, ids, [("x000", "x199")])
        g = PropertyGraph(g.vertices.repartition(parts), g.edges)
        numbered = Numbered(g, Scratch(spark, "t"))
        assert [r.id for r in numbered.ids.orderBy("vid").collect()] == ids
        assert sorted(r.vid for r in numbered.ids.collect()) == list(range(200))
        assert [tuple(r) for r in numbered.edges.collect()] == [(0, 199)]
