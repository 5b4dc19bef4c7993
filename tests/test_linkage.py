"""Minimum spanning forest and components against a union-find in plain Python."""

import random

import pytest

from tidemark.operators import linkage


def _brute(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    forest = []
    for d, a, b in sorted({(d, min(a, b), max(a, b)) for a, b, d in edges if a != b}):
        if top(a) != top(b):
            up[max(top(a), top(b))] = min(top(a), top(b))
            forest.append((a, b, d))
    return sorted(forest), top


def _graph(kind):
    rnd = random.Random(5)
    if kind == "random":
        return [(rnd.randrange(120), rnd.randrange(120), rnd.random()) for _ in range(400)]
    if kind == "ties":   # few lengths, repeated and reversed edges, loops, several components
        e = [(rnd.randrange(90), rnd.randrange(90), float(rnd.randrange(3))) for _ in range(110)]
        return e + [(b, a, d) for a, b, d in e[:30]] + e[:20] + [(7, 7, 0.0)]
    if kind == "path":   # the diameter is 400; lengths fall along the path, one tree in one round
        return [(i, i + 1, 1.0 / (i + 1)) for i in range(400)]
    return [(0, i, 1.0) for i in range(1, 300)]   # a star of equal lengths


@pytest.mark.parametrize("kind", ["random", "ties", "path", "star"])
def test_forest_and_components_equal_union_find(spark, kind):
    edges = _graph(kind)
    df = spark.createDataFrame(edges, "a long, b long, dist double")
    want, top = _brute(edges)
    assert sorted(tuple(r) for r in linkage.spanning_forest(df).collect()) == want
    ids = list(range(410))
    got = linkage.components(spark.createDataFrame([(i,) for i in ids], "id long"), df).collect()
    assert {r.id: r.comp for r in got} == {i: top(i) for i in ids}


def test_graphs_are_kept_apart_and_nulls_are_no_edges(spark):
    df = spark.createDataFrame([(0, 1, 2, .5), (0, 2, 3, .1), (1, 1, 3, .2), (1, None, 2, .0), (1, 2, 3, None), (1, 3, 1, .9)],
                               "level int, a long, b long, dist double")
    forest = linkage.spanning_forest(df, ["level"])
    assert sorted(tuple(r) for r in forest.collect()) == [(0, 1, 2, .5), (0, 2, 3, .1), (1, 1, 3, .2)]
    nodes = spark.createDataFrame([(x, i) for x in (0, 1) for i in (1, 2, 3)], "level int, id long")
    got = {(r.level, r.id): r.comp for r in linkage.components(nodes, df, ["level"]).collect()}
    assert got == {(0, 1): 1, (0, 2): 1, (0, 3): 1, (1, 1): 1, (1, 2): 2, (1, 3): 1}


def test_no_edges(spark):
    df = spark.createDataFrame([], "a long, b long, dist double")
    assert linkage.spanning_forest(df).collect() == []
    nodes = spark.createDataFrame([(4,), (2,), (4,)], "id long")
    assert sorted(tuple(r) for r in linkage.components(nodes, df).collect()) == [(2, 2), (4, 4)]


def test_rounds_do_not_grow_with_the_diameter(spark):
    edges = [(i, i + 1, float((i * 7919) % 1009)) for i in range(600)]
    rounds = list(linkage._rounds(spark.createDataFrame(edges, "a long, b long, dist double"), []))
    assert len(rounds) <= 9   # log2 of 601 nodes


def test_nodes_meet_their_component_once(spark, monkeypatch):
    rnd = random.Random(3)   # lengths without order along a path: several rounds
    df = spark.createDataFrame([(i, i + 1, rnd.random()) for i in range(200)], "a long, b long, dist double")
    nodes, frozen = spark.createDataFrame([(i,) for i in range(203)], "id long"), []

    def freeze(table):
        out = real(table)
        frozen.append((set(out.columns), out.count()))
        return out

    real = linkage.freeze
    monkeypatch.setattr(linkage, "freeze", freeze)
    got = {r.id: r.comp for r in linkage.components(nodes, df).collect()}
    assert got == {i: 0 if i <= 200 else i for i in range(203)}
    assert sum("e" in cols and "ca" in cols for cols, _ in frozen) > 3   # the edges left after each round
    assert sum(n for cols, n in frozen if "id" in cols) == 203
