"""Cut vertices and cut edges against removal of each, on small random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import biconnected


def parts(nodes, edges):
    near = {n: set() for n in nodes}
    for a, b in edges:
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    seen, n = set(), 0
    for v in nodes:
        if v not in seen:
            n += 1
            stack = [v]
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen.add(x)
                    stack += near[x]
    return n


def graph(seed):
    """Several graphs side by side: sparse random ones, paths, cycles, cliques on a string, a star."""
    rng, edges, base = random.Random(seed), [], 0
    for k in range(14):
        n = rng.randint(2, 14)
        edges += [(base + rng.randrange(n), base + rng.randrange(n)) for _ in range(rng.randint(1, n + 4))]
        base += n
    edges += [(base + i, base + i + 1) for i in range(150)]  # a path longer than two levels of blocks
    base += 200
    edges += [(base + i, base + (i + 1) % 70) for i in range(70)]
    base += 100
    edges += [(base + 4 * k + i, base + 4 * k + j) for k in range(5) for i in range(5) for j in range(i)]
    base += 100
    edges += [(base, base + i) for i in range(1, 90)] + [(base + 1, base + 2)]
    return edges + [(b, a) for a, b in edges[::5]]


def test_cut_vertices_and_edges(spark):
    edges = graph(4)
    simple = {(min(e), max(e)) for e in edges if e[0] != e[1]}
    nodes = {v for e in simple for v in e}
    whole = parts(nodes, simple)
    frame = spark.createDataFrame(edges, "src long, dst long")
    assert {r.id for r in biconnected.articulation_points(frame).collect()} == {v for v in nodes if parts(nodes - {v}, simple) > whole}
    assert {(r.a, r.b) for r in biconnected.cut_edges(frame).collect()} == {e for e in simple if parts(nodes, simple - {e}) > whole}


def test_nothing_to_cut(spark):
    assert biconnected.articulation_points(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert biconnected.articulation_points(spark.createDataFrame([(1, 1), (2, 3), (3, 2)], "src long, dst long")).count() == 0


def shallow(seed):
    """Random graphs side by side, dense and sparse, none of them deep; stars, cycles and cliques that hang together, an id below zero."""
    rng, edges, base = random.Random(seed), [(-1, 5), (5, 6)], 0
    for k in range(16):
        n = rng.randint(2, 30)
        edges += [(base + rng.randrange(n), base + rng.randrange(n)) for _ in range(rng.randint(1, 2 * n))]
        base += n
    edges += [(base, base + i) for i in range(1, 60)] + [(base + i, base + i + 1) for i in range(1, 40, 3)]
    edges += [(base + 100 + i, base + 100 + (i + 1) % 20) for i in range(20)] + [(base + 100, base)]
    edges += [(base + 200 + 4 * k + i, base + 200 + 4 * k + j) for k in range(5) for i in range(5) for j in range(i)]
    return edges + [(b, a) for a, b in edges[::5]]


@pytest.mark.parametrize("seed", [1, 2])
def test_both_methods_find_the_same_blocks(spark, monkeypatch, seed):
    edges = shallow(seed)
    frame = spark.createDataFrame(edges, "src long, dst long")
    simple = {(min(e), max(e)) for e in edges if e[0] != e[1]}
    nodes = {v for e in simple for v in e}
    whole = parts(nodes, simple)
    ways = []
    monkeypatch.setattr(biconnected, "_by_preorder", lambda pairs, run=biconnected._by_preorder: (ways.append("preorder"), run(pairs))[1])
    found = biconnected.blocks(frame)
    assert not ways  # shallow: no list is ranked
    vertices = lambda rows: {frozenset(v) for v in rows.selectExpr("explode(array(parent, child)) AS v", "block").groupBy("block").agg(F.collect_set("v").alias("v")).toPandas().v}
    got = vertices(found)
    cut = {v for v in nodes if sum(v in b for b in got) > 1}
    assert cut == {v for v in nodes if parts(nodes - {v}, simple) > whole}
    assert {tuple(sorted(b)) for b in got if len(b) == 2} == {e for e in simple if parts(nodes, simple - {e}) > whole}
    monkeypatch.setattr(biconnected, "_LEVELS", 1)
    assert vertices(biconnected.blocks(frame)) == got and ways == ["preorder"]


def test_first_forest_shallow_and_second_deep(spark, monkeypatch):
    """A wheel: without its spokes the rim is a long cycle."""
    n = 40
    edges = [(0, i) for i in range(1, n + 1)] + [(i, i % n + 1) for i in range(1, n + 1)] + [(0, 100), (100, 101)]
    monkeypatch.setattr(biconnected, "_LEVELS", 5)
    monkeypatch.setattr(biconnected, "_by_preorder", None)
    frame = spark.createDataFrame(edges, "src long, dst long")
    assert {(r.a, r.b) for r in biconnected.cut_edges(frame).collect()} == {(0, 100), (100, 101)}
    assert {r.id for r in biconnected.articulation_points(frame).collect()} == {0, 100}
