"""Graph operators on small hand-made graphs with literal results."""

import pytest

from tessera import schemas
from tessera.operators import biconnected, centrality, changes, communities, flows, motifs, primitives, structure, traversal
from tessera.sources.adapters import Graph


def graph(spark, edges, kinds=None, tests=(), uris=None, kind="calls"):
    names = sorted({x for e in edges for x in e[:2]} | set(kinds or {}))
    ids = {n: i + 1 for i, n in enumerate(names)}
    nodes = [(ids[n], (kinds or {}).get(n, "function"), n, f"app::{n}", (uris or {}).get(n, "app.py"), 1, 5, 4, n in tests, None, None, None) for n in names]
    rows = [(i + 1, ids[e[0]], ids[e[1]], e[2] if len(e) > 2 else kind, e[3] if len(e) > 3 else "extracted", 1.0 if len(e) < 4 or e[3] == "extracted" else 0.0) for i, e in enumerate(edges)]
    return Graph(spark.createDataFrame(nodes, schemas.NODES), spark.createDataFrame(rows, schemas.EDGES)), ids


@pytest.fixture(scope="module")
def tail(spark):
    return graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "tail")])


def test_cycle_with_tail(tail):
    g, ids = tail
    assert {r.id for r in centrality.cyclic_components(g.edges).collect()} == {ids[x] for x in "abc"}
    assert [r.id for r in biconnected.articulation_points(g.edges).collect()] == [ids["c"]]
    cores = {r.id: r.core for r in centrality.core_numbers(g).collect()}
    assert cores == {ids["a"]: 2, ids["b"]: 2, ids["c"]: 2, ids["tail"]: 1}
    score = {r.id: r.score for r in centrality.betweenness(g).collect()}
    assert score[ids["c"]] > score.get(ids["tail"], 0)


def test_self_loop_is_cyclic(spark):
    g, ids = graph(spark, [("loop", "loop"), ("large", "loop")])
    assert [r.id for r in centrality.cyclic_components(g.edges).collect()] == [ids["loop"]]


def test_motifs(spark):
    g, ids = graph(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("b", "a"), ("e", "d"), ("a", "e")])
    found = structure.diamonds(g.edges).collect()
    assert {(r.a, r.b, r.c, r.d) for r in found} >= {(ids["a"], ids["b"], ids["c"], ids["d"])}
    assert {(r.src, r.dst) for r in structure.feedback(g.edges).collect()} == {(ids["a"], ids["b"])}
    assert [r.id for r in structure.fan(g, incoming=True).collect()] == [ids["d"]]
    assert [r.id for r in structure.fan(g, incoming=False).collect()] == [ids["a"]]
    chain = motifs.chain("calls", 2).match(g)
    assert chain.filter("v0 = v2").count() == 0 and chain.count() > 0


def test_pagerank_sink_and_seed(spark):
    g, ids = graph(spark, [("n0", "n1"), ("n2", "n1")])
    rank = {r.id: r.rank for r in centrality.pagerank(g).collect()}
    assert rank[ids["n1"]] == max(rank.values()) and sum(rank.values()) == pytest.approx(1)
    seeded = {r.id: r.rank for r in centrality.pagerank(g, seeds=spark.createDataFrame([(ids["n0"], 1.0)], "id long, weight double")).collect()}
    assert seeded[ids["n0"]] > seeded[ids["n2"]]


def test_traced_flow(spark):
    g, ids = graph(spark, [("1", "2"), ("2", "3", "calls", "ambiguous")])
    members = flows.trace(g, spark.createDataFrame([(ids["1"],)], "id long"))
    assert {(r.id, r.depth) for r in members.collect()} == {(ids["1"], 0), (ids["2"], 1)}


def test_flows_rank_production_over_tests(spark):
    g, ids = graph(spark, [("main", "helper"), ("test_main", "helper")], tests=("test_main",))
    f = {r.entry: r.criticality for r in flows.materialise_flows(g, min_size=1)[0].collect()}
    assert f[ids["main"]] > f[ids["test_main"]]


def test_community_quality(spark):
    g, ids = graph(spark, [("handle", "validate"), ("validate", "persist")])
    c = spark.createDataFrame([(ids["handle"], 1), (ids["validate"], 1), (ids["persist"], 2)], "id long, community long")
    assert {r.community: r.cohesion for r in communities.cohesion(g, c).collect()} == {1: 1.0, 2: 1.0}
    q = communities.partition_quality(g, c).first()
    assert (q.communities, q.singletons, q.smallest, q.largest) == (2, 1, 1, 2) and q.mean_conductance > 0


def test_louvain_finds_two_cliques(spark):
    pairs = [(f"{s}{i}", f"{s}{j}") for s in "xy" for i in range(4) for j in range(i)] + [("x0", "y0")]
    g, ids = graph(spark, pairs)
    for detect in (communities.louvain, communities.leiden):
        c = {r.id: r.community for r in detect(g).collect()}
        assert len({c[ids[f"x{i}"]] for i in range(4)}) == 1 and len(set(c.values())) == 2


def test_paths_and_hops(spark):
    g, ids = graph(spark, [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e")])
    at = spark.createDataFrame([(ids["a"],)], "id long")
    paths = {tuple(r.path) for r in traversal.simple_paths(g, at, max_hops=2, target=ids["d"]).collect()}
    assert paths == {(ids["a"], ids["b"], ids["d"]), (ids["a"], ids["c"], ids["d"])}
    assert {(r.id, r.depth) for r in traversal.callees(g, at, max_hops=2).collect()} == {(ids["b"], 1), (ids["c"], 1), (ids["d"], 2)}
    assert traversal.max_depth(g, at).first().max_depth == 3


def test_upsert_fills_only_nulls(spark):
    old = spark.createDataFrame([(1, "q", None)], "id long, qualified_name string, uri string")
    new = spark.createDataFrame([(2, "q", "u"), (3, "r", "v")], "id long, qualified_name string, uri string")
    got = {r.qualified_name: (r.id, r.uri) for r in primitives.upsert(old, new, fill=["uri"]).collect()}
    assert got == {"q": (1, "u"), "r": (3, "v")}


def test_diff_hunks_and_affected_symbols(spark):
    text = "--- a/app.py\n+++ b/app.py\n@@ -2,2 +3,2 @@\n-x\n+y\n@@ -9,1 +20 @@\n+z"
    hunks = changes.parse_diff(spark.createDataFrame([(text,)], "diff string"))
    assert {(r.file_path, r.line_start, r.line_end) for r in hunks.collect()} == {("app.py", 3, 4), ("app.py", 20, 20)}
    g, ids = graph(spark, [("main", "helper")])
    hit = changes.affected_symbols(g.nodes, hunks)
    assert {r.line_start for r in hit.collect()} == {3}
    assert {r.risk for r in changes.hunk_risk(g, hunks).collect()} == {2.5}


def test_empty_graph(spark):
    g = Graph(spark.createDataFrame([], schemas.NODES), spark.createDataFrame([], schemas.EDGES))
    assert primitives.call_resolution_stats(g).first().rate == 1.0
    assert structure.hub_nodes(g).count() == 0 and changes.risk_scores(g).count() == 0
    assert centrality.connected_components(g).count() == 0
    assert traversal.bfs(g, g.nodes.select("id")).count() == 0
