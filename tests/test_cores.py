"""Core numbers against peeling node by node, and what a round may exchange."""

import random

from tessera.operators import centrality
from tessera.sources.adapters import Graph


def peeled(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    core, k = {}, 0
    while near:
        least = min(near, key=lambda v: len(near[v]))
        k = core[least] = max(k, len(near[least]))
        for v in near.pop(least):
            near[v].discard(least)
    return core


def graph(spark, edges, nodes):
    return Graph(spark.createDataFrame([(v,) for v in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long"))


def test_core_numbers_of_random_graphs(spark):
    rng, edges = random.Random(7), []
    for k, n in enumerate((6, 12, 25, 40)):
        edges += [(100 * k + rng.randrange(n), 100 * k + rng.randrange(n)) for _ in range(n * (k + 1))]
    edges += [(1000 + i, 1000 + j) for i in range(8) for j in range(i)] + [(1000, 1100 + i) for i in range(60)]  # a clique with a star
    edges += [(2000 + i, 2001 + i) for i in range(9)] + [(b, a) for a, b in edges[::3]] + edges[::4]
    nodes = range(2100)
    got = {r.id: r.core for r in centrality.core_numbers(graph(spark, edges, nodes)).collect()}
    want = peeled(edges)
    assert got == {v: want.get(v, 0) for v in nodes}


def test_edges_lie_still_while_numbers_settle(spark, monkeypatch):
    """Every table of a round lies in buckets, so a join moves neither the edges nor the nodes."""
    plans, kept = [], centrality.bucketed
    monkeypatch.setattr(centrality, "bucketed", lambda df, *a, **k: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, *a, **k))[1])
    centrality.core_numbers(graph(spark, [(i, i + 1) for i in range(12)], range(13))).collect()
    assert len(plans) > 4 and all(p.count("Exchange") == 1 for p in plans[2:])
    assert not any("SortMergeJoin" in p for p in plans)


def test_core_numbers_without_edges(spark):
    assert [tuple(r) for r in centrality.core_numbers(graph(spark, [(1, 1)], [1, 2])).orderBy("id").collect()] == [(1, 0), (2, 0)]


def test_the_registered_query_numbers_every_node(spark):
    """No table of the query goes by a name that a step of it takes away."""
    from tessera.plans import graph_queries
    from tessera.sources.adapters import commerce_graph

    d = "/root/testdata/sf0.001"
    g = commerce_graph(spark, d)
    want = peeled([tuple(r) for r in g.edges.select("src", "dst").collect()])
    got = {r.id: r.core for r in graph_queries.queries()["core_numbers"](spark, d).collect()}
    assert got == {r.id: want.get(r.id, 0) for r in g.nodes.select("id").collect()}
