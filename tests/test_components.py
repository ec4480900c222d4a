import random

import pytest

from graphloom.graph import PropertyGraph
from graphloom.operators import components
from graphloom.operators.components import aggregate_components, strongly_connected_components, weakly_connected_components


def parts(c):
    out = {}
    for r in c.members.collect():
        out.setdefault(r.component, set()).add(r.id)
    assert all(k == min(v) for k, v in out.items())
    return sorted(map(sorted, out.values()))


def graph(spark, ids, edges, **more):
    return PropertyGraph.create(spark, list(ids), [tuple(e) for e in edges], **more)


def test_wcc(spark):
    assert parts(weakly_connected_components(graph(spark, "ABCDEF", ["AB", "AC", "EF"]))) == [["A", "B", "C"], ["D"], ["E", "F"]]
    assert parts(weakly_connected_components(graph(spark, "ABC", ["BA", "AC"]))) == [["A", "B", "C"]]
    assert parts(weakly_connected_components(graph(spark, "AB", ["AA"]))) == [["A"], ["B"]]
    assert parts(weakly_connected_components(graph(spark, "", []))) == []


@pytest.mark.parametrize("local", [0, 1000])
def test_scc(spark, local):
    assert parts(strongly_connected_components(graph(spark, "AB", ["AB", "BA"]), local)) == [["A", "B"]]
    assert parts(strongly_connected_components(graph(spark, "AB", ["AB"]), local)) == [["A"], ["B"]]
    edges = ["12", "23", "31", "34", "45", "54", "68", "89", "96", "67"]
    assert parts(strongly_connected_components(graph(spark, "123456789", edges), local)) == [["1", "2", "3"], ["4", "5"], ["6", "8", "9"], ["7"]]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    ids = [f"{i:02d}" for i in range(30)]
    edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(38)]
    g = PropertyGraph.create(spark, ids, edges)
    reach = {i: {i} for i in ids}
    for _ in ids:
        for a, b in edges:
            for s in reach.values():
                if a in s:
                    s.add(b)
    want = sorted(map(list, {tuple(sorted(j for j in ids if j in reach[i] and i in reach[j])) for i in ids}))
    assert parts(strongly_connected_components(g)) == parts(strongly_connected_components(g, 0)) == want
    whole = parts(weakly_connected_components(g))
    assert all(any(set(s) <= set(w) for w in whole) for s in want)


def test_aggregation(spark):
    g = graph(spark, "ABCDE", ["AB", "BC", "DE"], kind=["x", "x", None, "y", "x"], n=[1, 2, 3, 4, 5])
    got = {r._key: (r.representative, r.size, r.aggregation) for r in aggregate_components(weakly_connected_components(g), "kind").collect()}
    assert got == {"A": ("A", 3, {"x": 2}), "D": ("D", 2, {"x": 1, "y": 1})}
    numbers = {r._key: r.aggregation for r in aggregate_components(strongly_connected_components(g), "n").collect()}
    assert set(numbers) == set("ABCDE") and not any(numbers.values())


def test_aggregation_of_json(spark):
    g = graph(spark, "ABC", ["AB", "BC"], doc=['{"k": "x"}', '{"k": 3}', '"x"'])
    g = PropertyGraph(g.vertices.selectExpr("id", "parse_json(doc) as doc"), g.edges)
    c = weakly_connected_components(g)
    assert aggregate_components(c, "doc").first().aggregation == {"x": 1}
    assert aggregate_components(c, "doc", "k").first().aggregation == {"x": 1}


@pytest.mark.parametrize("seed", range(4))
def test_long_chains_without_the_driver(spark, seed):
    """Long cycles, paths and chains between components, against the local algorithm."""
    r = random.Random(seed)
    edges, n = [], 0
    for size in (40, 3, 2):
        edges += [(n + i, n + (i + 1) % size) for i in range(size)]
        n += size
    edges += [(n + i, n + i + 1) for i in range(60)]  # a path
    for _ in range(6):  # chains from anywhere to anywhere
        size, a, b = r.randint(1, 12), r.randrange(n), r.randrange(n)
        inner = range(n + 100, n + 100 + size)
        edges += list(zip([a, *inner], [*inner, b], strict=True))
        n += 120
    edges += [(r.randrange(45), r.randrange(45)) for _ in range(6)]
    names = r.sample(range(10_000), 3000)
    edges = [(names[a], names[b]) for a, b in edges]
    ids = sorted({x for e in edges for x in e})
    g = PropertyGraph(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "src long, dst long"))
    want = {i: i for i in ids} | dict(components._tarjan(edges))
    assert {x.id: x.component for x in strongly_connected_components(g, local_edges=0).members.collect()} == want
    assert {x.id: x.component for x in strongly_connected_components(g).members.collect()} == want


@pytest.mark.parametrize("rows", [0, 8, 30, 100, 300_000])
def test_blocks_of_any_size(spark, monkeypatch, rows):
    """Cycles, chains, a hub and random edges by blocks of a few rows, of one block, and without blocks."""
    from graphloom.plans import blocks

    monkeypatch.setattr(blocks, "BLOCK_ROWS", rows)
    r = random.Random(rows)
    edges = [(i, i + 1) for i in range(60)] + [(20, 11), (50, 31), (44, 2)]
    edges += [(100, 200 + i) for i in range(30)] + [(200 + i, 100) for i in range(0, 30, 4)]
    edges += [(r.randrange(300, 340), r.randrange(300, 340)) for _ in range(50)] + [(59, 300), (330, 5), (210, 60)]
    ids = sorted({x for e in edges for x in e})
    g = PropertyGraph(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "src long, dst long"))
    want = {i: i for i in ids} | dict(components._tarjan(edges))
    assert {x.id: x.component for x in strongly_connected_components(g, local_edges=0).members.collect()} == want


def test_long_journeys_take_few_rounds(spark, monkeypatch):
    """Paths of near numbers with ways back: contraction leaves nothing for rounds of jobs."""
    rounds = []
    edges = spark.range(40_000).selectExpr("id as src", "id + 7 as dst").union(spark.range(0, 40_000, 11).selectExpr("id + 70 as src", "id as dst"))
    monkeypatch.setattr(components.blocks, "BLOCK_ROWS", 20_000)
    found = strongly_connected_components(PropertyGraph(spark.range(40_071), edges), 0, report=rounds.append)
    assert {x.id: x.component for x in found.members.collect() if x.id != x.component} == {a: b for a, b in components._tarjan([tuple(e) for e in edges.collect()]) if a != b}
    assert len(rounds) < 6


def test_sorted_path_takes_few_rounds(spark):
    rounds = []
    g = PropertyGraph(spark.range(3000), spark.range(2999).selectExpr("id as src", "id + 1 as dst"))
    assert weakly_connected_components(g, report=rounds.append).count == 1
    assert len(rounds) < 14


def test_cancelled_between_rounds(spark):
    from graphloom.plans.superstep import Cancelled

    g = PropertyGraph(spark.range(300), spark.range(299).selectExpr("id as src", "id + 1 as dst"))
    calls = iter([False, True])
    with pytest.raises(Cancelled):
        weakly_connected_components(g, cancelled=lambda: next(calls))
    with pytest.raises(Cancelled):
        strongly_connected_components(g, cancelled=lambda: True)


def test_inner_vertices_of_chains(spark):
    known = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, component long")
    # Within a component, between two, from a known vertex to itself, twice from an unknown one, between unknown ones.
    chain = spark.createDataFrame([(10, 1, 2), (11, 1, 3), (12, 3, 3), (13, 7, 7), (14, 7, 7), (15, 8, 9)], "id long, first long, last long")
    got = sorted(tuple(r) for r in components._inside(chain, known).collect())
    assert got == [(7, 7), (10, 1), (12, 3), (13, 7), (14, 7)]
    assert components._inside(chain.limit(0), known).count() == 0


def test_chains_are_joined_into_edges(spark):
    scratch = components.Scratch(spark, "test")
    edges = spark.createDataFrame([(a, a + 1) for a in range(40)] + [(0, 100), (100, 40), (40, 200), (40, 201)], "src long, dst long")
    rest, taken, n = components._without_chains(edges, scratch)
    rows = [r for t in taken for r in t.collect()]
    assert sorted((r.src, r.dst) for r in rest.collect()) == [(0, 40), (40, 200), (40, 201)] and n == 3
    assert sorted(r.id for r in rows) == [*range(1, 40), 100]
    for t in taken:  # no two neighbours at once
        ids = {r.id for r in t.collect()}
        assert not any(r.first in ids or r.last in ids for r in t.collect())
    scratch.close()
