"""Registered queries do the whole job on hand-made graphs and tables."""

import duckdb
import pytest

from tessera.operators import centrality, communities, dedup, motifs, overview, resolution
from tessera import schemas
from tessera.plans import check_queries, graph_queries, pass_queries, report_queries, retrieval_queries, source_queries, text_queries
from tessera.sources.adapters import Graph
from test_graph import graph


def run(monkeypatch, spark, name, g):
    monkeypatch.setattr(graph_queries, "commerce_graph", lambda spark, d: g)
    return graph_queries.queries()[name](spark, "").collect()


def test_k_core_peels_until_nothing_changes(spark, monkeypatch):
    # The square of a path loses one node at each end a round: its 3-core is empty after more than 8 rounds.
    g, _ = graph(spark, [(f"n{i:02}", f"n{i + d:02}") for i in range(24) for d in (1, 2)], kind="imports")
    assert run(monkeypatch, spark, "k_core", g) == []


def test_flows_reach_the_end_of_a_chain(spark, monkeypatch):
    g, ids = graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")])
    assert {r.id: r.depth for r in run(monkeypatch, spark, "flow_trace", g)} == {ids[x]: i for i, x in enumerate("abcde")}
    assert [(r.node_count, r.depth) for r in run(monkeypatch, spark, "flow_criticality", g)] == [(5, 4)]


SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def both(spark, name, sf_dir, modules=(graph_queries, text_queries, pass_queries, report_queries, retrieval_queries, source_queries, check_queries)):
    """Rows of a registered query and of its SQL, columns by name."""
    module = next(m for m in modules if name in m.queries())
    found = module.queries()[name](spark, sf_dir)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    c = db.execute(module.oracle_sql()[name])
    columns, want = [x[0] for x in c.description], c.fetchall()
    assert sorted(columns) == sorted(found.columns)
    flat = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    return flat(tuple(r) for r in found.select(columns).collect()), flat(want)


@pytest.mark.parametrize("name", ["fuzzy_ratio", "fuzzy_partial_ratio", "fuzzy_token_sort", "fuzzy_token_set", "jaro_winkler", "text_lines", "vector_threshold"])
def test_text_queries_equal_their_sql_on_whole_tables(spark, name):
    got, want = both(spark, name, SF)
    assert got == want and got


@pytest.mark.parametrize("name", [n for m in (report_queries, retrieval_queries, source_queries, check_queries) for n in m.oracle_sql()])
def test_reports_and_searches_equal_their_sql(spark, name):
    got, want = both(spark, name, "/root/testdata/sf0.001")
    assert got == want and got


def test_jaro_winkler_sql_follows_the_reference():
    parts = duckdb.sql(f"SELECT p_partkey, p_name FROM '{SF}/part.parquet' ORDER BY p_partkey").fetchall()
    score = {i: round(dedup.jaro_winkler_value(a, b), 6) for (i, a), (_, b) in zip(parts, parts[1:])}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    got = dict(db.execute(text_queries.oracle_sql()["jaro_winkler"]).fetchall())
    assert got == pytest.approx({i: x for i, x in score.items() if x > 0.8}, abs=2e-6)


def test_threshold_search_has_no_limit(spark, monkeypatch):
    rows = spark.range(1500).selectExpr("id AS vec_id", "transform(sequence(0, 63), i -> CASE WHEN i % 3 = 0 THEN 1.0D ELSE -1.0D END) AS embedding")
    monkeypatch.setattr(text_queries, "read_table", lambda s, d, name: rows)
    assert text_queries.queries()["vector_threshold"](spark, "").count() == 1500


def test_betweenness_is_undirected_and_has_no_hop_cap(spark):
    g, ids = graph(spark, [("b", "a"), ("b", "c")])
    assert {r.id: r.score for r in centrality.betweenness(g).collect()}[ids["b"]] == 2.0
    chain, ids = graph(spark, [(f"n{i:02}", f"n{i + 1:02}") for i in range(16)])
    got = {r.id: r.score for r in centrality.betweenness(chain).collect()}
    assert got[ids["n08"]] == 2 * 8 * 8 and got[ids["n01"]] == 2 * 15


def test_bridge_scores_by_hand(spark):
    g, ids = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    com = spark.createDataFrame([(ids[x], 1 if x in "abc" else 2) for x in "abcd"], "id long, community long")
    got = {r.id: (r.touched, r.degree, r.articulation, r.score) for r in overview.bridge_scores(g, com).collect()}
    assert got[ids["c"]] == (2, 3, True, round(6 + 3 + 12 + 4**0.5, 4)) and got[ids["d"]] == (1, 1, False, 4.0)


def test_first_fit_passes_over_what_does_not_fit(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate([900, 800, 600, 50, 100, 100])], "place int, tokens long")
    assert [r.place for r in overview.first_fit(rows, budget=1600, order=["place"]).orderBy("place").collect()] == [0, 2, 3]
    big = spark.createDataFrame([(0, 5000), (1, 10)], "place int, tokens long")
    assert [r.place for r in overview.first_fit(big, budget=1600, order=["place"]).collect()] == [0]


def test_diamonds_of_every_call(spark, monkeypatch):
    g, ids = graph(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    assert [tuple(r) for r in run(monkeypatch, spark, "motif_diamond", g)] == [tuple(ids[x] for x in "abcd")]
    assert [tuple(r) for r in run(monkeypatch, spark, "motif_diamond_counts", g)] == [(ids["a"], ids["d"], 1)]


def test_surprise_pairs_count_calls_and_label_every_node(spark, monkeypatch):
    g, ids = graph(spark, [("a", "b"), ("a", "c"), ("a", "d")], uris={"a": "x", "b": "x", "c": "y", "d": "y"})
    assert [tuple(r) for r in run(monkeypatch, spark, "surprise_pairs", g)] == [(str(ids["a"]), str(ids["c"]), 2)]


def test_motif_match_keeps_every_owner(spark, monkeypatch):
    g, ids = graph(spark, [("own", "call", "defines"), ("call", "to", "calls")], kinds={"own": "class"})
    monkeypatch.setattr(text_queries, "commerce_graph", lambda s, d: g)
    got = [(r.owner, r.caller, r.callee) for r in text_queries.queries()["motif_match"](spark, "").collect()]
    assert got == [(ids["own"], ids["call"], ids["to"])]


def test_calls_resolved_by_scope_are_returned(spark, monkeypatch):
    rows = [(1, "method", "f", "app::x::f", "a/f.py"), (2, "function", "n", "app::x::n", "b/g.py"), (3, "function", "n", "other::y::n", "c/h.py"), (4, "function", "n", "call::n", None)]
    nodes = spark.createDataFrame([(*r, 1, 5, 4, False, None, None, None) for r in rows], schemas.NODES)
    g = Graph(nodes, spark.createDataFrame([(9, 1, 4, "calls", "ambiguous", 0.0)], schemas.EDGES))
    monkeypatch.setattr(pass_queries, "placeholder_graph", lambda s, d: g)
    assert [tuple(r) for r in pass_queries.queries()["call_resolve_unique"](spark, "").collect()] == [(9, 2, 3, "inferred")]


@pytest.mark.parametrize("detect", [communities.louvain, communities.leiden, communities.infomap])
def test_two_cliques_are_two_communities(spark, detect):
    cliques = [(f"{k}{a}", f"{k}{b}") for k in "xy" for a in range(5) for b in range(a)]
    g, ids = graph(spark, [*cliques, ("x0", "y0")])
    got = {r.id: r.community for r in detect(g).collect()}
    assert len({got[ids[f"x{i}"]] for i in range(5)}) == 1 and len({got[ids[f"y{i}"]] for i in range(5)}) == 1 and got[ids["x1"]] != got[ids["y1"]]


def test_infomap_shortens_the_code(spark):
    ring = [(f"{k}{a}", f"{k}{b}") for k in "abcdef" for a in range(4) for b in range(a)] + [(f"{a}0", f"{b}1") for a, b in zip("abcdef", "bcdefa")]
    g, _ = graph(spark, ring)
    bits = lambda c: communities.map_equation(g, c).first()["bits"]
    alone = g.nodes.selectExpr("id", "id AS community")
    assert bits(communities.infomap(g)) < min(bits(alone), bits(g.nodes.selectExpr("id", "1L AS community")))


def test_receivers_resolve_in_tier_four(spark):
    rows = [(1, "method", "f", "app::x::f", "a/f.py"), (2, "method", "n", "lib::Graph::n", "b/g.py"), (3, "method", "n", "lib::Node::n", "c/h.py"), (4, "function", "n", "call::n", None), (5, "function", "hash", "call::hash", None), (6, "function", "Hash", "z::hash", "z/z.py")]
    nodes = spark.createDataFrame([(*r, 1, 5, 4, False, None, None, None) for r in rows], schemas.NODES)
    g = Graph(nodes, spark.createDataFrame([(9, 1, 4, "calls", "ambiguous", 0.0), (10, 1, 5, "calls", "ambiguous", 0.0)], schemas.EDGES))
    receivers = spark.createDataFrame([(9, "Node")], "edge_id long, type string")
    assert [tuple(r) for r in resolution.resolve_calls(g, receivers=receivers).collect()] == [(9, 3, 4, "inferred")]
    assert resolution.resolve_calls(g, receivers=receivers, suppress=["N"]).count() == 0


def test_a_catalogue_is_read_from_toml(spark):
    text = """
    [[pattern]]
    id = "orders"
    name_regex = "^order"
    kinds = ["method"]
    edge_kind = "calls"
    min_nodes = 2
    """
    assert [tuple(r) for r in motifs.load_catalogue(spark, text).collect()] == [("orders", "^order", ["method"], "calls", 2)]
