"""Registered queries over the commerce projection, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import biconnected, centrality, changes, communities, flows, primitives, structure, traversal
from tessera.sources.adapters import COMMERCE_SQL, Graph, commerce_graph

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[Graph], DataFrame], sql: str | None = None, *, recursive: bool = False) -> None:
    _Q[name] = lambda spark, d, run=run: run(commerce_graph(spark, d))
    if sql is not None:
        _SQL[name] = f"WITH {'RECURSIVE ' * recursive}{COMMERCE_SQL}{sql}"


def _ids(g: Graph, *ids: int) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame([(i,) for i in ids], "id long")


O1, C1, P1 = 6 * 10**15, 4 * 10**15, 5 * 10**15  # first ids of orders, customers and parts
R = lambda x, n=6: F.round(x, n)

# --- primitives ---
_add("node_kind_counts", lambda g: primitives.kind_counts(g.nodes), "SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
_add("edge_kind_counts", lambda g: primitives.kind_counts(g.edges), "SELECT kind, count(*) AS n FROM edges GROUP BY kind")
_add("graph_status", primitives.status, "SELECT * FROM (SELECT count(*) AS nodes, count(DISTINCT kind) AS node_kinds, count(DISTINCT source_uri) AS sources FROM nodes), (SELECT count(*) AS edges, count(DISTINCT kind) AS edge_kinds, count(*) FILTER (WHERE conf_class = 'extracted') AS extracted FROM edges)")
_add("in_degree_by_kind", lambda g: primitives.in_degree_by_kind(g, "calls"), "SELECT dst, count(*) AS in_degree FROM edges WHERE kind = 'calls' GROUP BY dst")
_add("out_neighbors", lambda g: primitives.neighbours(g, C1 + 7), f"SELECT n.id, e.kind AS edge_kind, e.id AS edge_id, n.qualified_name, n.kind FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.src = {C1 + 7}")
_add("in_neighbors", lambda g: primitives.neighbours(g, P1 + 7, incoming=True), f"SELECT n.id, e.kind AS edge_kind, e.id AS edge_id, n.qualified_name, n.kind FROM edges e JOIN nodes n ON n.id = e.src WHERE e.dst = {P1 + 7}")
_add("find_by_qname", lambda g: primitives.find_by_qname(g, "part::7").select("id", "kind", "name", "qualified_name"), "SELECT id, kind, name, qualified_name FROM nodes WHERE qualified_name = 'part::7'")
_add("remove_nodes", lambda g: primitives.kind_counts(primitives.remove_nodes(g, g.nodes.filter("kind = 'class'")).edges), "SELECT kind, count(*) AS n FROM edges WHERE src NOT IN (SELECT id FROM nodes WHERE kind = 'class') AND dst NOT IN (SELECT id FROM nodes WHERE kind = 'class') GROUP BY kind")
_add("remove_first_parallel", lambda g: primitives.remove_first_parallel(g, "calls").edges.select("id"), "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, kind ORDER BY id) AS nth FROM edges) WHERE kind <> 'calls' OR nth <> 1")
_add(
    "merge_nodes",
    lambda g: primitives.merge_nodes(g, g.nodes.filter("kind = 'function' AND id % 10 = 3").select(F.col("id").alias("loser"), (F.col("id") - 1).alias("winner"))).edges.select("id", "src", "dst", "kind"),
    """, m AS (SELECT id AS loser, id - 1 AS winner FROM nodes WHERE kind = 'function' AND id % 10 = 3),
    e AS (SELECT e.id, coalesce(a.winner, e.src) AS src, coalesce(b.winner, e.dst) AS dst, e.kind, (a.winner IS NOT NULL OR b.winner IS NOT NULL) AS moved FROM edges e LEFT JOIN m a ON a.loser = e.src LEFT JOIN m b ON b.loser = e.dst)
    SELECT id, src, dst, kind FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, kind ORDER BY moved::INT, id) AS nth FROM e) WHERE NOT moved OR (src <> dst AND nth = 1)""",
)
_add(
    "merge_upsert",
    lambda g: primitives.upsert(g.nodes.filter("kind = 'class'").select("id", "qualified_name", "name", F.when(F.col("id") % 2 == 0, F.col("source_uri")).alias("source_uri")), g.nodes.filter("kind IN ('class', 'function')").select("id", "qualified_name", F.upper("name").alias("name"), "source_uri"), fill=["source_uri"]),
    " SELECT id, qualified_name, CASE WHEN kind = 'class' THEN name ELSE upper(name) END AS name, source_uri FROM nodes WHERE kind IN ('class', 'function')",
)
_add("scope_keys", lambda g: g.nodes.filter("kind = 'function'").select("id", primitives.scope_key(F.col("qualified_name"), F.col("id")).alias("scope"), primitives.name_of(F.col("qualified_name")).alias("last")), " SELECT id, qualified_name AS scope, split_part(qualified_name, '::', -1) AS last FROM nodes WHERE kind = 'function'")
_add("call_resolution_stats", primitives.call_resolution_stats, " SELECT count(*) AS resolved, 0::BIGINT AS unresolved, count(*) AS total, 1.0::DOUBLE AS rate FROM edges WHERE kind = 'calls'")
_add("merge_graphs", lambda g: primitives.kind_counts(primitives.merge_graphs(Graph(g.nodes.filter("kind <> 'method'"), g.edges.filter("kind NOT IN ('calls', 'defines')")), g).edges), " SELECT kind, count(*) AS n FROM (SELECT src, dst, kind FROM edges WHERE kind NOT IN ('calls', 'defines') UNION ALL SELECT DISTINCT src, dst, kind FROM edges WHERE kind IN ('calls', 'defines')) GROUP BY kind")

# --- structure ---
_DEG = ", deg AS (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY id)"
_add("hub_nodes", structure.hub_nodes, _DEG + " SELECT d.id, in_degree, out_degree, degree, qualified_name, kind FROM deg d JOIN nodes n ON n.id = d.id ORDER BY degree DESC, d.id LIMIT 20")
_add("hub_nodes_simple", structure.hub_nodes_simple, ", p AS (SELECT DISTINCT src, dst FROM edges), d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM p UNION ALL SELECT dst FROM p) GROUP BY id) SELECT d.id, qualified_name, round(degree / (SELECT count(*) - 1 FROM nodes)::DOUBLE, 6) AS centrality FROM d JOIN nodes n ON n.id = d.id ORDER BY centrality DESC, d.id LIMIT 20")
_add("god_nodes_degree", structure.god_nodes_degree, _DEG + " SELECT d.id, qualified_name, kind, degree FROM deg d JOIN nodes n ON n.id = d.id WHERE degree >= 20")
_add("fan_in", lambda g: structure.fan(g, incoming=True), " SELECT dst AS id, count(DISTINCT src) AS n FROM edges GROUP BY dst HAVING count(DISTINCT src) >= 3")
_add("fan_out", lambda g: structure.fan(g, incoming=False), " SELECT src AS id, count(DISTINCT dst) AS n FROM edges GROUP BY src HAVING count(DISTINCT dst) >= 3")
_SHARED = lambda g: g.edges.filter("kind = 'imports'").select(F.col("dst").alias("src"), (F.col("src") % 50 + 3 * 10**15).alias("dst"))
_SHARED_SQL = ", s AS (SELECT DISTINCT dst AS src, src % 50 + 3000000000000000 AS dst FROM edges WHERE kind = 'imports')"
_add("motif_feedback", lambda g: structure.feedback(_SHARED(g)), _SHARED_SQL + " SELECT a.src, a.dst FROM s a JOIN s b ON a.src = b.dst AND a.dst = b.src WHERE a.src <= a.dst")
_DIA = lambda g: g.edges.filter("kind IN ('calls', 'imports')")
_DIA_SQL = ", p AS (SELECT DISTINCT src, dst FROM edges WHERE kind IN ('calls', 'imports')), two AS (SELECT x.src AS a, x.dst AS m, y.dst AS d FROM p x JOIN p y ON x.dst = y.src WHERE x.src <> y.dst AND x.src <> x.dst AND y.src <> y.dst)"
_add("motif_diamond", lambda g: structure.diamonds(_DIA(g)), _DIA_SQL + ", f AS (SELECT a, d FROM two GROUP BY a, d HAVING count(*) > 1 ORDER BY a, d LIMIT 50), t AS (SELECT two.* FROM two JOIN f USING (a, d)) SELECT l.a, l.m AS b, r.m AS c, l.d FROM t l JOIN t r ON l.a = r.a AND l.d = r.d AND l.m < r.m ORDER BY l.a, l.d, b, c LIMIT 50")
_add("motif_diamond_counts", lambda g: structure.diamond_counts(_DIA(g)), _DIA_SQL + " SELECT a, d, (count(*) * (count(*) - 1) // 2)::BIGINT AS diamonds FROM two GROUP BY a, d HAVING count(*) > 1")
_add("large_functions", lambda g: structure.large_functions(g).withColumn("lines", F.col("lines").cast("long")), " SELECT id, qualified_name, (line_end - 1)::BIGINT AS lines FROM nodes WHERE kind IN ('function', 'method') AND line_end - 1 >= 30")
_USED = "('calls', 'imports', 'tested_by', 'inherits', 'implements', 'reads_writes', 'data_flow', 'mentions', 'depends_on')"
_add("dead_code", structure.dead_code, f" SELECT id, qualified_name, kind FROM nodes WHERE kind IN ('function', 'method', 'class') AND NOT is_test AND id NOT IN (SELECT dst FROM edges WHERE kind IN {_USED})")
_add("isolated_nodes", structure.isolated, " SELECT id, qualified_name, kind FROM nodes WHERE id NOT IN (SELECT src FROM edges) AND id NOT IN (SELECT dst FROM edges)")
_add("knowledge_gaps_isolated", structure.gaps, _DEG + " SELECT n.id, qualified_name, coalesce(degree, 0) AS degree, CASE WHEN coalesce(degree, 0) = 0 THEN 'isolated' ELSE 'weakly_connected' END AS gap FROM nodes n LEFT JOIN deg d ON n.id = d.id WHERE coalesce(degree, 0) <= 1")
_add("untested_hotspots", structure.untested_hotspots, _DEG + " SELECT n.id, degree FROM nodes n JOIN deg d ON n.id = d.id WHERE kind IN ('function', 'method', 'class') AND NOT is_test AND degree >= 5 AND n.id NOT IN (SELECT e.dst FROM edges e JOIN nodes t ON t.id = e.src WHERE t.is_test AND e.kind = 'calls')")
_add(
    "graph_coverage",
    structure.coverage,
    """, ends AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), o AS (SELECT DISTINCT src AS id FROM edges WHERE kind = 'calls'), i AS (SELECT DISTINCT dst AS id FROM edges WHERE kind = 'calls')
    SELECT kind, count(*) AS n, round(avg((source_uri IS NOT NULL)::INT), 4) AS source_rate, round(avg((line_end IS NOT NULL)::INT), 4) AS location_rate, round(avg((ends.id IS NOT NULL)::INT), 4) AS connectivity,
           round(avg((i.id IS NOT NULL)::INT), 4) AS caller_rate, round(avg((o.id IS NOT NULL)::INT), 4) AS callee_rate
    FROM nodes LEFT JOIN ends USING (id) LEFT JOIN o USING (id) LEFT JOIN i USING (id) GROUP BY kind""",
)
_add("diagnostics", structure.diagnostics, " SELECT kind, count(*) AS n, count(*) FILTER (WHERE conf_class = 'extracted') AS extracted, count(*) FILTER (WHERE conf_class = 'inferred') AS inferred, count(*) FILTER (WHERE conf_class = 'ambiguous') AS ambiguous FROM edges GROUP BY kind")

# --- traversal ---
_STARTS = (O1 + 1, O1 + 2, O1 + 3, C1 + 7, C1 + 10)
_LIST = ", ".join(map(str, _STARTS))


def _walk(pairs: str, hops: int, lists: str = _LIST) -> str:
    sql = f", pairs AS ({pairs}), l0 AS (SELECT DISTINCT id AS start, id, 0 AS depth FROM nodes WHERE id IN ({lists}))"
    for h in range(1, hops + 1):
        anti = " AND ".join(f"NOT EXISTS (SELECT 1 FROM l{k} x WHERE x.start = s.start AND x.id = s.id)" for k in range(h))
        sql += f", l{h} AS (SELECT start, id, {h} AS depth FROM (SELECT DISTINCT f.start, p.there AS id FROM l{h - 1} f JOIN pairs p ON p.here = f.id) s WHERE {anti})"
    return sql + ", walk AS (" + " UNION ALL ".join(f"SELECT * FROM l{h}" for h in range(hops + 1)) + ")"


_OUT = "SELECT DISTINCT src AS here, dst AS there FROM edges"
_BOTH = _OUT + " UNION SELECT DISTINCT dst, src FROM edges"
_add("bfs_callees", lambda g: traversal.callees(g, _ids(g, *_STARTS), max_hops=2), _walk(_OUT + " WHERE kind = 'calls'", 2) + " SELECT start, id, depth FROM walk WHERE depth > 0")
_PARTS = (P1 + 1, P1 + 2, P1 + 7)
_PLIST = ", ".join(map(str, _PARTS))
_add("bfs_callers", lambda g: traversal.callers(g, _ids(g, *_PARTS), max_hops=2), _walk("SELECT DISTINCT dst AS here, src AS there FROM edges WHERE kind = 'calls' AND confidence >= 0.5", 2, _PLIST) + " SELECT start, id, depth FROM walk WHERE depth > 0")
_add("max_depth", lambda g: traversal.max_depth(g, _ids(g, *_STARTS), max_hops=3), _walk(_OUT + " WHERE kind = 'calls'", 3) + " SELECT start, max(depth) AS max_depth FROM walk GROUP BY start")
_add("impact_bfs", lambda g: traversal.impact_bfs(g, _ids(g, *_STARTS), max_hops=3), _walk(_OUT, 3) + " SELECT start, id, depth, round(1.0::DOUBLE / (depth + 1), 6) AS score FROM walk WHERE depth > 0")
_add("traverse_both", lambda g: traversal.bfs(g, _ids(g, O1 + 1), direction="both", max_hops=2), _walk(_BOTH, 2, str(O1 + 1)) + " SELECT start, id, depth FROM walk")
_add("minimal_context", lambda g: traversal.minimal_context(g, _ids(g, C1 + 7), max_hops=2), _walk(_BOTH, 2, str(C1 + 7)) + " SELECT start, id, depth FROM walk ORDER BY depth, id LIMIT 50")
_add(
    "traverse_budget",
    lambda g: traversal.traverse_budget(g, _ids(g, C1 + 7), max_hops=2, token_budget=60).select("start", "id", "depth", "running"),
    _walk(_BOTH, 2, str(C1 + 7)) + " SELECT start, id, depth, running FROM (SELECT w.*, sum(greatest(1, length(qualified_name) // 4)) OVER (PARTITION BY start ORDER BY depth, w.id)::BIGINT AS running FROM walk w JOIN nodes n ON n.id = w.id) WHERE running <= 60",
)
_PATHS = """, pairs AS (SELECT DISTINCT src AS here, dst AS there FROM edges), w AS (
    SELECT id AS start, [id] AS path, id AS target, 0 AS hops FROM nodes WHERE id = {0}
    UNION ALL SELECT start, list_append(path, there), there, hops + 1 FROM w JOIN pairs ON here = target WHERE hops < {1} AND NOT list_contains(path, there))"""
_add("simple_paths", lambda g: traversal.simple_paths(g, _ids(g, C1 + 7), max_hops=3).select("start", "target", F.array_join("path", ">").alias("path"), "hops"), _PATHS.format(C1 + 7, 3) + " SELECT start, target, array_to_string(path, '>') AS path, hops FROM w WHERE hops > 0", recursive=True)
_COST = "CASE kind WHEN 'calls' THEN 1.0 WHEN 'defines' THEN 0.35 WHEN 'imports' THEN 1.35 WHEN 'depends_on' THEN 1.35 WHEN 'member_of' THEN 3.0 ELSE 1.5 END::DOUBLE / greatest(confidence, 0.05)"
_add(
    "top_paths",
    lambda g: traversal.top_paths(g, _ids(g, C1 + 7), max_hops=3).select("start", "rank", F.array_join("path", ">").alias("path"), "cost"),
    f""", steps AS (SELECT src AS here, dst AS there, min({_COST}) AS step FROM edges GROUP BY ALL), w AS (
        SELECT id AS start, [id] AS path, id AS last, 0.0::DOUBLE AS cost, 0 AS hops FROM nodes WHERE id = {C1 + 7}
        UNION ALL SELECT start, list_append(path, there), there, cost + step, hops + 1 FROM w JOIN steps ON here = last WHERE hops < 3 AND NOT list_contains(path, there))
    SELECT start, rank::INT AS rank, array_to_string(path, '>') AS path, round(cost, 6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY cost, len(path), path) AS rank FROM w WHERE hops > 0) WHERE rank <= 10""",
    recursive=True,
)
_add(
    "top_paths_target",
    lambda g: traversal.top_paths(g, _ids(g, C1 + 7), target=10**15 + 1, max_hops=5, limit=20).select("start", "rank", F.array_join("path", ">").alias("path"), "cost"),
    f""", steps AS (SELECT src AS here, dst AS there, min({_COST}) AS step FROM edges GROUP BY ALL), w AS (
        SELECT id AS start, [id] AS path, id AS last, 0.0::DOUBLE AS cost, 0 AS hops FROM nodes WHERE id = {C1 + 7}
        UNION ALL SELECT start, list_append(path, there), there, cost + step, hops + 1 FROM w JOIN steps ON here = last WHERE hops < 5 AND NOT list_contains(path, there))
    SELECT start, rank::INT AS rank, array_to_string(path, '>') AS path, round(cost, 6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY cost, len(path), path) AS rank FROM w WHERE last = {10**15 + 1}) WHERE rank <= 20""",
    recursive=True,
)
_add("top_paths_diverse", lambda g: traversal.top_diverse_paths(g, _ids(g, C1 + 7, C1 + 10), max_hops=3).select("start", "rank", F.array_join("path", ">").alias("path"), "cost"))
_REV = "CASE kind WHEN 'calls' THEN 1.0 WHEN 'defines' THEN 1.25 WHEN 'imports' THEN 1.6 WHEN 'depends_on' THEN 1.6 WHEN 'member_of' THEN 5.0 ELSE 1.5 END::DOUBLE / greatest(confidence, 0.05)"
_FWD = "CASE kind WHEN 'calls' THEN 2.25 WHEN 'imports' THEN 2.5 WHEN 'depends_on' THEN 2.5 END::DOUBLE / greatest(confidence, 0.05)"


def _impact_sql(hops: int, where: str) -> str:
    sql = f", steps AS (SELECT here, there, min(step) AS step FROM (SELECT dst AS here, src AS there, {_REV} AS step FROM edges UNION ALL SELECT src, dst, {_FWD} FROM edges WHERE kind IN ('calls', 'imports', 'depends_on')) GROUP BY ALL), b0 AS (SELECT id AS start, id, 0.0::DOUBLE AS cost, 0 AS hops FROM nodes WHERE {where})"
    for h in range(1, hops + 1):
        sql += f", b{h} AS (SELECT start, id, min({{'c': cost, 'h': hops}}).c AS cost, min({{'c': cost, 'h': hops}}).h AS hops FROM (SELECT * FROM b{h - 1} UNION ALL SELECT start, there, cost + step, {h} FROM b{h - 1} JOIN steps ON here = id WHERE hops = {h - 1}) GROUP BY start, id)"
    boost = "CASE kind WHEN 'function' THEN 1.3 WHEN 'method' THEN 1.3 WHEN 'class' THEN 1.3 WHEN 'module' THEN 0.95 WHEN 'package' THEN 0.95 ELSE 0.8 END"
    return sql + f", impact AS (SELECT start, b.id, qualified_name, source_uri, hops, round(cost, 6) AS cost, round({boost}::DOUBLE / (1 + cost), 4) AS score FROM b{hops} b JOIN nodes n ON n.id = b.id WHERE hops > 0)"


_add("impact_ranked", lambda g: traversal.impact_ranked(g, _ids(g, P1 + 1, P1 + 2), max_hops=2), _impact_sql(2, f"id IN ({P1 + 1}, {P1 + 2})") + " SELECT * FROM impact")
_add("predict_affected_files", lambda g: traversal.affected_files(g, "customer/7", max_hops=2), _impact_sql(2, "source_uri = 'customer/7'") + " SELECT source_uri, max(score) AS score FROM impact WHERE source_uri IS NOT NULL AND source_uri <> 'customer/7' GROUP BY source_uri ORDER BY score DESC, source_uri LIMIT 10")
_add("call_neighbors", lambda g: traversal.call_neighbours(g, P1 + 7, incoming=True), f" SELECT DISTINCT n.id, qualified_name FROM edges e JOIN nodes n ON n.id = e.src WHERE e.kind = 'calls' AND confidence >= 0.5 AND dst = {P1 + 7}")
_add("find_related", lambda g: traversal.related(g, C1 + 7), f" SELECT id, qualified_name, kind FROM nodes WHERE id IN (SELECT dst FROM edges WHERE src = {C1 + 7} UNION SELECT src FROM edges WHERE dst = {C1 + 7})")
_add("rename_sites", lambda g: traversal.rename_sites(g, P1 + 7), f" SELECT id, 'definition' AS site, 'HIGH' AS confidence FROM nodes WHERE id = {P1 + 7} UNION ALL SELECT src, kind, min(CASE WHEN conf_class = 'extracted' THEN 'HIGH' ELSE 'MEDIUM' END) FROM edges WHERE dst = {P1 + 7} AND kind IN ('calls', 'imports') GROUP BY src, kind")
_add(
    "rename_counts",
    lambda g: traversal.rename_counts(traversal.rename_sites(g, P1 + 7)),
    f", u AS (SELECT id, 'definition' AS site, 'HIGH' AS confidence FROM nodes WHERE id = {P1 + 7} UNION ALL SELECT src, kind, min(CASE WHEN conf_class = 'extracted' THEN 'HIGH' ELSE 'MEDIUM' END) FROM edges WHERE dst = {P1 + 7} AND kind IN ('calls', 'imports') GROUP BY src, kind) SELECT confidence, count(*) AS sites, count(DISTINCT id) AS nodes FROM u GROUP BY confidence",
)
_HOLE = 6 * 10**15 + 1


def _counterfactual(g: Graph) -> DataFrame:
    first = g.edges.filter(f"src = {C1 + 7} AND kind = 'defines'").agg(F.min("dst")).first()[0]
    return traversal.counterfactual(g, C1 + 7, first, max_hops=2)


_add(
    "counterfactual",
    _counterfactual,
    f", hole AS (SELECT min(dst) AS h FROM edges WHERE src = {C1 + 7} AND kind = 'defines')" + _walk(_OUT, 2, str(C1 + 7)) + f", k1 AS (SELECT DISTINCT there AS id FROM pairs, hole WHERE here = {C1 + 7} AND there <> h), k2 AS (SELECT DISTINCT p.there AS id FROM pairs p JOIN k1 ON p.here = k1.id, hole WHERE p.there <> h) SELECT id, depth FROM walk WHERE id <> {C1 + 7} AND id NOT IN (SELECT id FROM k1) AND id NOT IN (SELECT id FROM k2)",
)

# --- centrality ---
_TRANS = "(CASE kind WHEN 'calls' THEN 1.0 WHEN 'defines' THEN 0.7 WHEN 'imports' THEN 0.55 WHEN 'depends_on' THEN 0.55 WHEN 'member_of' THEN 0.05 ELSE 0.5 END * CASE conf_class WHEN 'extracted' THEN 1.0 ELSE 0.0 END)::DOUBLE"
_T = f", w0 AS (SELECT src, dst, sum({_TRANS}) AS w FROM edges WHERE conf_class = 'extracted' GROUP BY src, dst), t AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM w0)"
_add("transitions", lambda g: centrality.transitions(g.edges).select("src", "dst", R("p").alias("p")), _T + " SELECT src, dst, round(p, 6) AS p FROM t")


def _pagerank_sql(iterations: int, teleport: str, select: str) -> str:
    sql = _T + f", tele AS ({teleport}), outs AS (SELECT DISTINCT src FROM t), r0 AS MATERIALIZED (SELECT id, t AS rank FROM tele)"
    for i in range(1, iterations + 1):
        sql += f", r{i} AS MATERIALIZED (SELECT tele.id, 0.15::DOUBLE * t + 0.85::DOUBLE * (coalesce(got, 0.0) + (SELECT coalesce(sum(rank), 0.0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM outs)) * t) AS rank FROM tele LEFT JOIN (SELECT dst, sum(p * rank) AS got FROM t JOIN r{i - 1} ON r{i - 1}.id = t.src GROUP BY dst) g ON g.dst = tele.id)"
    return sql + select.format(f"r{iterations}")


_ALL = "SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS t FROM nodes"
_add("pagerank", lambda g: centrality.pagerank(g, iterations=30).select("id", R("rank", 7).alias("rank")), _pagerank_sql(30, _ALL, " SELECT id, round(rank, 7) AS rank FROM {}"))
_add(
    "personalized_pagerank",
    lambda g: centrality.pagerank(g, iterations=10, seeds=g.nodes.filter("kind = 'class' AND id % 5 = 0").select("id", F.lit(1.0).alias("weight"))).select("id", R("rank", 7).alias("rank")),
    _pagerank_sql(10, "SELECT id, CASE WHEN kind = 'class' AND id % 5 = 0 THEN 1.0::DOUBLE / (SELECT count(*) FROM nodes WHERE kind = 'class' AND id % 5 = 0) ELSE 0.0::DOUBLE END AS t FROM nodes", " SELECT id, round(rank, 7) AS rank FROM {}"),
)
_add("god_nodes", centrality.god_nodes, _pagerank_sql(30, _ALL, " SELECT r.id, qualified_name, kind, round(rank, 6) AS rank FROM {} r JOIN nodes n ON n.id = r.id WHERE NOT regexp_matches(name, '^(.|[0-9]+)$') ORDER BY round(rank, 6) DESC, r.id LIMIT 20"))
def _components_sql(rounds: int) -> str:
    """Least label among the neighbours, round by round; no two nodes of the table's graph are further apart than the rounds."""
    sql = ", near AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), l0 AS (SELECT id, id AS c FROM nodes)"
    for i in range(1, rounds + 1):
        sql += f", l{i} AS MATERIALIZED (SELECT l.id, least(l.c, coalesce(m.c, l.c)) AS c FROM l{i - 1} l LEFT JOIN (SELECT a AS id, min(c) AS c FROM near JOIN l{i - 1} x ON x.id = b GROUP BY a) m ON m.id = l.id)"
    return sql + f" SELECT id, c AS component FROM l{rounds}"


_add("connected_components", centrality.connected_components, _components_sql(14))
_add(
    "k_core",
    lambda g: centrality.k_core(g.edges, 3),
    ", e0 AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst)"
    + "".join(f", k{i} AS MATERIALIZED (SELECT id FROM (SELECT a AS id FROM e{i} UNION ALL SELECT b FROM e{i}) GROUP BY id HAVING count(*) >= 3), e{i + 1} AS MATERIALIZED (SELECT * FROM e{i} WHERE a IN (SELECT id FROM k{i}) AND b IN (SELECT id FROM k{i}))" for i in range(24))
    + " SELECT a AS id FROM e24 UNION SELECT b FROM e24",
)


def _cores_sql(rounds: int, where: str) -> str:
    """Each node's number falls to the h-index of its neighbours' numbers, ``rounds`` times; more change nothing once it is stable."""
    sql = f", e AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges WHERE {where} AND src <> dst UNION SELECT dst, src FROM edges WHERE {where} AND src <> dst), c0 AS MATERIALIZED (SELECT a AS id, count(*) AS core FROM e GROUP BY a)"
    for i in range(rounds):
        sql += f", c{i + 1} AS MATERIALIZED (SELECT id, least(c{i}.core, h) AS core FROM c{i} JOIN (SELECT a, max(least(place, core)) AS h FROM (SELECT a, core, row_number() OVER (PARTITION BY a ORDER BY core DESC) AS place FROM e JOIN c{i} ON id = b) GROUP BY a) ON a = id)"
    return sql


_add("core_numbers", centrality.core_numbers, _cores_sql(60, "true") + " SELECT n.id, coalesce(core, 0) AS core FROM nodes n LEFT JOIN c60 ON c60.id = n.id")
_add(
    "scc",
    lambda g: centrality.cyclic_components(_SHARED(g)).groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).select("n", "first"),
    _SHARED_SQL + ", reach AS (SELECT src AS a, dst AS b FROM s UNION SELECT r.a, s.dst FROM reach r JOIN s ON s.src = r.b), mutual AS (SELECT x.a, min(x.b) AS first FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a) SELECT count(*) AS n, first FROM mutual GROUP BY first",
    recursive=True,
)
def _between_sql(levels: int, where: str) -> str:
    """Brandes by levels: forward path counts, then dependencies from the deepest level up."""
    sql = f", p AS MATERIALIZED (SELECT src AS u, dst AS v FROM edges WHERE {where} AND src <> dst UNION SELECT dst, src FROM edges WHERE {where} AND src <> dst), l0 AS MATERIALIZED (SELECT id AS s, id, 1.0::DOUBLE AS sigma FROM nodes ORDER BY id LIMIT 64)"
    for h in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT s, id FROM l{k}" for k in range(max(0, h - 2), h))
        sql += f", l{h} AS MATERIALIZED (SELECT s, v AS id, sum(sigma) AS sigma FROM l{h - 1} JOIN p ON u = id WHERE (s, v) NOT IN ({seen}) GROUP BY s, v)"
    sql += f", d{levels} AS MATERIALIZED (SELECT s, id, sigma, 0.0::DOUBLE AS delta FROM l{levels})"
    for h in range(levels - 1, -1, -1):
        sql += f", d{h} AS MATERIALIZED (SELECT a.s, a.id, a.sigma, coalesce(sum(a.sigma / b.sigma * (1 + b.delta)), 0.0::DOUBLE) AS delta FROM l{h} a LEFT JOIN (SELECT p.u, d.* FROM p JOIN d{h + 1} d ON p.v = d.id) b ON b.u = a.id AND b.s = a.s GROUP BY a.s, a.id, a.sigma)"
    return sql + " SELECT id, round(sum(delta), 6) AS score FROM (" + " UNION ALL ".join(f"SELECT * FROM d{h}" for h in range(levels + 1)) + ") WHERE id <> s GROUP BY id"


_add("betweenness_approx", centrality.betweenness, _between_sql(12, "true"))
_add("articulation_points", lambda g: biconnected.articulation_points(g.edges))
_add("cut_edges", lambda g: biconnected.cut_edges(g.edges))

# --- communities ---
_COM = ", com AS (SELECT id, min(id) OVER (PARTITION BY source_uri) AS community FROM nodes WHERE source_uri IS NOT NULL), lab AS (SELECT e.*, a.community AS a, b.community AS b FROM edges e JOIN com a ON a.id = e.src JOIN com b ON b.id = e.dst), und AS (SELECT DISTINCT least(src, dst) AS s, greatest(src, dst) AS d FROM edges WHERE src <> dst), ulab AS (SELECT a.community AS a, b.community AS b FROM und JOIN com a ON a.id = s JOIN com b ON b.id = d)"
_add("community_cohesion", lambda g: communities.cohesion(g, communities.by_source(g)), _COM + " SELECT c.community, size, CASE WHEN size < 2 THEN 1.0::DOUBLE ELSE round(coalesce(pairs, 0) / (size::DOUBLE * (size - 1) / 2), 6) END AS cohesion FROM (SELECT community, count(*) AS size FROM com GROUP BY community) c LEFT JOIN (SELECT a AS community, count(*) AS pairs FROM ulab WHERE a = b GROUP BY a) p ON p.community = c.community")
_CON = _COM + ", vol AS (SELECT c AS community, count(*) AS volume, sum(x)::BIGINT AS cut FROM (SELECT a AS c, (a <> b)::INT AS x FROM lab UNION ALL SELECT b, (a <> b)::INT FROM lab) GROUP BY c), con AS (SELECT community, volume, cut, CASE WHEN least(volume, 2 * (SELECT count(*) FROM lab) - volume) > 0 THEN round(cut / least(volume, 2 * (SELECT count(*) FROM lab) - volume)::DOUBLE, 6) ELSE 0.0::DOUBLE END AS conductance FROM vol)"
_add("community_conductance", lambda g: communities.conductance(g, communities.by_source(g)), _CON + " SELECT * FROM con")
_add("modularity", lambda g: communities.modularity(g, communities.by_source(g)), _COM + " SELECT round(sum(i / (SELECT count(*) FROM ulab)::DOUBLE - pow(d / (2.0::DOUBLE * (SELECT count(*) FROM ulab)), 2)), 6) AS modularity FROM (SELECT c, count(*) AS d, sum(x) AS i FROM (SELECT a AS c, (a = b)::INT AS x FROM ulab UNION ALL SELECT b, 0 FROM ulab) GROUP BY c)")
_add("partition_quality", lambda g: communities.partition_quality(g, communities.by_source(g)), _CON + ", sz AS (SELECT count(*) AS size FROM com GROUP BY community) SELECT * FROM (SELECT count(*) AS communities, min(size) AS smallest, max(size) AS largest, count(*) FILTER (WHERE size = 1) AS singletons, round(sqrt(sum(pow(size / (SELECT count(*) FROM com)::DOUBLE, 2))), 6) AS concentration FROM sz), (SELECT round(avg(conductance), 6) AS mean_conductance, max(conductance) AS max_conductance FROM con)")
_add("cross_coupling", lambda g: communities.coupling(g, communities.by_source(g)), _COM + " SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM lab WHERE a <> b GROUP BY ALL")
_add("architecture_warnings", lambda g: communities.warnings(g, communities.by_source(g)), _COM + ", cp AS (SELECT least(a, b) AS x, greatest(a, b) AS y, count(*) AS n FROM lab WHERE a <> b GROUP BY ALL), sz AS (SELECT community, count(*) AS size FROM com GROUP BY community), co AS (SELECT sz.community, CASE WHEN size < 2 THEN 1.0 ELSE round(coalesce(pairs, 0) / (size::DOUBLE * (size - 1) / 2), 6) END AS cohesion FROM sz LEFT JOIN (SELECT a AS community, count(*) AS pairs FROM ulab WHERE a = b GROUP BY a) p ON p.community = sz.community) SELECT x || '-' || y AS subject, CASE WHEN n >= 20 THEN 'high_coupling' ELSE 'coupling' END AS warning FROM cp WHERE n >= 5 UNION ALL SELECT community::VARCHAR, 'low_cohesion' FROM co WHERE cohesion < 0.1")
_add("community_summaries", lambda g: communities.summaries(g, communities.by_source(g)), _COM + ", k AS (SELECT community, kind, count(*) AS n, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, kind) AS r FROM com JOIN nodes USING (id) GROUP BY community, kind) SELECT community, sum(n)::BIGINT AS size, string_agg(kind, ',' ORDER BY r) FILTER (WHERE r <= 3) AS top_kinds FROM k GROUP BY community")
_add("community_split", lambda g: communities.split_half(communities.by_source(g), max_size=10), _COM + ", p AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY id) AS place, count(*) OVER (PARTITION BY community) AS size FROM com) SELECT id, CASE WHEN size > 10 AND place > size // 2 THEN community + (SELECT max(community) FROM com) + 1 ELSE community END AS community FROM p")
_add("surprise_pairs", lambda g: structure.surprise_pairs(g, communities.by_source(g)), _COM + ", c AS (SELECT * FROM com), p AS (SELECT coalesce(a.community::VARCHAR, 'unknown') AS a, coalesce(b.community::VARCHAR, 'unknown') AS b FROM edges e LEFT JOIN c a ON a.id = src LEFT JOIN c b ON b.id = dst) SELECT least(a, b) AS left_community, greatest(a, b) AS right_community, count(*) AS n FROM p WHERE a <> b GROUP BY ALL")
_add("surprise_edges", lambda g: structure.surprise_edges(g, communities.by_source(g)), _COM + _DEG + " SELECT l.id, l.src, l.dst, round(0.25::DOUBLE * CASE conf_class WHEN 'ambiguous' THEN 1.0 WHEN 'inferred' THEN 0.5 ELSE 0.0 END + 0.20::DOUBLE * (x.kind <> y.kind)::INT + 0.15::DOUBLE * (x.source_uri IS DISTINCT FROM y.source_uri)::INT + 0.20::DOUBLE + 0.20::DOUBLE * (least(dx.degree, dy.degree) <= 2 AND greatest(dx.degree, dy.degree) >= 5)::INT, 4) AS score FROM lab l JOIN nodes x ON x.id = l.src JOIN nodes y ON y.id = l.dst JOIN deg dx ON dx.id = l.src JOIN deg dy ON dy.id = l.dst WHERE a <> b")
_add("community_working_graph", lambda g: communities.working_graph(g.edges).select("src", "dst", R("w").alias("w")), " SELECT src, dst, round(sum(CASE WHEN conf_class = 'ambiguous' THEN 0.15 ELSE CASE kind WHEN 'calls' THEN 0.55 WHEN 'defines' THEN 0.7 WHEN 'imports' THEN 0.45 WHEN 'depends_on' THEN 0.45 WHEN 'member_of' THEN 0.1 ELSE 0.55 END END::DOUBLE), 6) AS w FROM edges GROUP BY src, dst")
_SMALL = lambda g: Graph(g.nodes.filter("kind IN ('class', 'function', 'module', 'package')"), g.edges.filter("kind IN ('imports', 'depends_on', 'member_of')"))
_add("louvain", communities.louvain)
_add("leiden", communities.leiden)
_add("infomap", lambda g: communities.infomap(_SMALL(g)))
_add("label_propagation", communities.label_propagation)
_add(
    "map_equation",
    lambda g: communities.map_equation(g, communities.by_source(g)),
    """, sn AS (SELECT * FROM nodes), sc AS (SELECT id, min(id) OVER (PARTITION BY source_uri) AS c FROM sn WHERE source_uri IS NOT NULL),
    w AS (SELECT src, dst, sum(CASE WHEN conf_class = 'ambiguous' THEN 0.15 ELSE CASE kind WHEN 'calls' THEN 0.55 WHEN 'defines' THEN 0.7 WHEN 'imports' THEN 0.45 WHEN 'depends_on' THEN 0.45 ELSE 0.1 END END::DOUBLE) AS w FROM edges GROUP BY src, dst),
    l AS (SELECT w.*, x.c AS a, y.c AS b FROM w JOIN sc x ON x.id = src JOIN sc y ON y.id = dst), m AS (SELECT 2 * sum(w) AS m FROM l),
    n AS (SELECT id, c, sum(w) / m AS p, sum(o) / m AS q FROM (SELECT src AS id, a AS c, w, CASE WHEN a <> b THEN w ELSE 0 END AS o FROM l UNION ALL SELECT dst, b, w, CASE WHEN a <> b THEN w ELSE 0 END FROM l), m GROUP BY id, c, m),
    k AS (SELECT c, sum(p) AS p, sum(q) AS q, sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) AS i FROM n GROUP BY c),
    t AS (SELECT sum(q) AS q, sum(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) AS ql, sum(CASE WHEN p + q > 0 THEN (p + q) * log2(p + q) ELSE 0 END) AS pq, sum(i) AS i FROM k)
    SELECT round(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END - 2 * ql + pq - i, 6) AS bits FROM t""",
)

# --- flows, changes ---
_CRIT = ", en AS (SELECT n.id, n.name, n.is_test FROM nodes n WHERE kind IN ('function', 'method') AND (is_test OR regexp_matches(lower(name), '^(main|run|start|serve|handler|cli)$') OR n.id NOT IN (SELECT dst FROM edges WHERE kind = 'calls')))"
_add("flow_entry_points", flows.entry_points, _CRIT + " SELECT id, name, is_test FROM en")
_FLOW = _CRIT + ", re AS (SELECT * FROM edges WHERE kind = 'calls' AND conf_class <> 'ambiguous'), fi AS (SELECT dst AS id, count(*) AS fan_in FROM re GROUP BY dst), m1 AS (SELECT DISTINCT en.id AS entry, re.dst AS id, 1 AS depth FROM en JOIN re ON re.src = en.id), m AS (SELECT id AS entry, id, 0 AS depth FROM en UNION ALL SELECT * FROM m1), mm AS (SELECT entry, m.id, depth, coalesce(fan_in, 0) AS fan_in FROM m LEFT JOIN fi ON fi.id = m.id)"
_add("flow_trace", lambda g: flows.trace(g, flows.entry_points(g)), _FLOW + " SELECT entry, id, depth, fan_in FROM mm")
_CRITICALITY = "SELECT entry, node_count, depth, round(greatest(0.0, least(1.0, least(0.1::DOUBLE * node_count, 0.6) + least(fan / 8, 0.25) + CASE WHEN regexp_matches(lower(name), 'main|handle|process|run') THEN 0.15 ELSE 0.0 END - CASE WHEN is_test THEN 0.2 ELSE 0.0 END)), 6) AS criticality FROM (SELECT entry, count(*) AS node_count, max(depth) AS depth, avg(fan_in) AS fan FROM mm GROUP BY entry HAVING count(*) >= 3) JOIN nodes n ON n.id = entry"
_add("flow_criticality", lambda g: flows.materialise_flows(g)[0], _FLOW + " " + _CRITICALITY)
_HUNKS = lambda g: g.nodes.filter("kind = 'function'").select(F.col("source_uri").alias("file_path"), (F.col("line_end") - 1).alias("line_start"), (F.col("line_end") + 2).alias("line_end")).distinct()
_HSQL = ", h AS (SELECT DISTINCT source_uri AS file_path, line_end - 1 AS line_start, line_end + 2 AS line_end FROM nodes WHERE kind = 'function'), af AS (SELECT h.file_path, h.line_start, h.line_end, n.id, qualified_name, kind FROM h JOIN nodes n ON n.source_uri = h.file_path WHERE n.line_end IS NOT NULL AND 1 <= h.line_end AND n.line_end >= h.line_start)"
_add("affected_symbols", lambda g: changes.affected_symbols(g.nodes, _HUNKS(g)), _HSQL + " SELECT * FROM af")
_add("hunk_risk", lambda g: changes.hunk_risk(g, _HUNKS(g)), _HSQL + " SELECT file_path, line_start, line_end, least(sum(CASE WHEN kind IN ('function', 'method') THEN 1.0 WHEN kind = 'class' THEN 2.0 ELSE 0.0 END::DOUBLE + CASE WHEN id IN (SELECT dst FROM edges) THEN 0.5 ELSE 0.0 END), 10.0) AS risk FROM af GROUP BY ALL")
def _risk_sql(flow: str = "", join: str = "") -> str:
    return f""", ca AS (SELECT e.dst AS id, sum((s.source_uri IS DISTINCT FROM t.source_uri)::INT) AS crossing, count(DISTINCT CASE WHEN s.is_test THEN e.src END) AS tests FROM edges e JOIN nodes s ON s.id = e.src JOIN nodes t ON t.id = e.dst WHERE e.kind = 'calls' GROUP BY e.dst),
    sc AS (SELECT n.id, qualified_name, round({flow}least(coalesce(crossing, 0) * 0.05::DOUBLE, 0.15) + 0.30::DOUBLE - 0.25::DOUBLE * least(coalesce(tests, 0) / 5.0::DOUBLE, 1.0) + CASE WHEN regexp_matches(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]', ' ', 'g'), '{"|".join(changes.SECURITY)}') THEN 0.20 ELSE 0.0 END + least(coalesce(in_degree, 0) / 20.0::DOUBLE, 0.10), 4) AS score FROM nodes n LEFT JOIN ca ON ca.id = n.id LEFT JOIN deg ON deg.id = n.id {join}WHERE kind IN ('function', 'method', 'class') AND NOT is_test)
    SELECT id, qualified_name, score, CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.70 THEN 'high' WHEN score >= 0.40 THEN 'medium' ELSE 'low' END AS level FROM sc"""


_add("risk_scores", changes.risk_scores, _DEG + _risk_sql())
_add(
    "risk_scores_flows",
    lambda g: changes.risk_scores(g, flows.participation(*flows.materialise_flows(g))),
    _FLOW + f", fl AS ({_CRITICALITY}), fp AS (SELECT mm.id, round(sum(criticality), 6) AS criticality FROM mm JOIN fl ON fl.entry = mm.entry GROUP BY mm.id)" + _DEG + _risk_sql("least(coalesce(fp.criticality, 0.0), 0.25::DOUBLE) + ", "LEFT JOIN fp ON fp.id = n.id "),
)
_add("test_coverage", changes.test_coverage, " SELECT id, kind, id IN (SELECT e.dst FROM edges e JOIN nodes t ON t.id = e.src WHERE t.is_test AND e.kind = 'calls') AS tested FROM nodes WHERE kind IN ('function', 'method', 'class') AND NOT is_test")
_add("graph_diff_nodes", lambda g: changes.graph_diff_nodes(g.nodes.filter("id % 5 <> 0"), g.nodes.filter("id % 7 <> 0").withColumn("name", F.when(F.col("id") % 11 == 0, F.upper("name")).otherwise(F.col("name"))), ["name", "kind", "source_uri"]), ", b AS (SELECT * FROM nodes WHERE id % 5 <> 0), h AS (SELECT * REPLACE (CASE WHEN id % 11 = 0 THEN upper(name) ELSE name END AS name) FROM nodes WHERE id % 7 <> 0), d AS (SELECT coalesce(b.qualified_name, h.qualified_name) AS qualified_name, CASE WHEN b.id IS NULL THEN 'added' WHEN h.id IS NULL THEN 'removed' WHEN b.name <> h.name THEN 'modified' END AS change FROM b FULL JOIN h ON b.qualified_name = h.qualified_name) SELECT * FROM d WHERE change IS NOT NULL")
_add("graph_diff_edges", lambda g: changes.graph_diff_edges(g.edges.filter("id % 5 <> 0"), g.edges.filter("id % 7 <> 0")), ", b AS (SELECT DISTINCT src, dst, kind FROM edges WHERE id % 5 <> 0), h AS (SELECT DISTINCT src, dst, kind FROM edges WHERE id % 7 <> 0) SELECT *, 'added' AS change FROM (SELECT * FROM h EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM h)")


def _versions(g: Graph) -> tuple[DataFrame, changes.History]:
    """Nodes with commits of a straight history 0 .. 9 as validity, and that history."""
    v = g.nodes.withColumn("valid_from", (F.col("id") % 10).cast("string")).withColumn("valid_to", F.when(F.col("id") % 3 == 0, (F.col("id") % 10 + 2).cast("string")))
    line = g.nodes.sparkSession.createDataFrame([(str(i), str(i - 1)) for i in range(1, 10)], "commit string, parent string")
    return v.select("qualified_name", "kind", "valid_from", "valid_to"), changes.history(line)


_VER = ", v AS (SELECT qualified_name, kind, id % 10 AS f, CASE WHEN id % 3 = 0 THEN id % 10 + 2 END AS t FROM nodes)"
_add("temporal_active_at", lambda g: changes.active_at(*_versions(g), "6").select("qualified_name", "kind"), _VER + " SELECT qualified_name, kind FROM v WHERE f <= 6 AND (t IS NULL OR t >= 6)")
_add("temporal_diff", lambda g: changes.temporal_diff(*_versions(g), "4", "7"), _VER + ", b AS (SELECT * FROM v WHERE f <= 4 AND (t IS NULL OR t >= 4)), h AS (SELECT * FROM v WHERE f <= 7 AND (t IS NULL OR t >= 7)) SELECT qualified_name, kind, 'added' AS change FROM h WHERE qualified_name NOT IN (SELECT qualified_name FROM b) UNION ALL SELECT qualified_name, kind, 'removed' FROM b WHERE qualified_name NOT IN (SELECT qualified_name FROM h)")
_add("file_hash_diff", lambda g: changes.file_diff(g.nodes.filter("id % 5 <> 0").select(F.col("qualified_name").alias("path"), F.md5("name").alias("hash")), g.nodes.filter("id % 7 <> 0").select(F.col("qualified_name").alias("path"), F.md5(F.when(F.col("id") % 11 == 0, F.upper("name")).otherwise(F.col("name"))).alias("hash"))), ", b AS (SELECT qualified_name, name FROM nodes WHERE id % 5 <> 0), h AS (SELECT qualified_name, CASE WHEN id % 11 = 0 THEN upper(name) ELSE name END AS name FROM nodes WHERE id % 7 <> 0), d AS (SELECT coalesce(b.qualified_name, h.qualified_name) AS path, CASE WHEN h.name IS NULL THEN 'deleted' WHEN b.name IS DISTINCT FROM h.name THEN 'changed' END AS change FROM b FULL JOIN h ON b.qualified_name = h.qualified_name) SELECT * FROM d WHERE change IS NOT NULL")


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
