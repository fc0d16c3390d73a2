"""Registered queries of evaluation, built-in motifs, diffs, the store and entry predicates, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import changes, flows, motifs, primitives
from tessera.plans import evaluation
from tessera.plans.pass_queries import placeholder_graph
from tessera.runtime import read_table, scratch_path
from tessera.sources.adapters import COMMERCE_SQL, Graph, commerce_graph
from tessera.sources.store import Store

_Q: dict = {}
_SQL: dict[str, str] = {}
_N = f"WITH {COMMERCE_SQL}"


def _add(name, run, sql=None):
    _Q[name] = run
    if sql is not None:
        _SQL[name] = sql


# --- evaluation ---


def _flow_completeness(s: SparkSession, d: str) -> DataFrame:
    g = commerce_graph(s, d)
    entries = flows.entry_points(g).join(g.nodes.select("id", "qualified_name"), "id")
    known = g.nodes.filter("kind = 'method' AND id % 100 = 7").select(F.concat(F.lit("order::"), F.expr("id - 6000000000000000")).alias("name")).unionByName(s.createDataFrame([("nowhere",)], "name string"))
    return evaluation.flow_completeness(entries, known, flows.materialise_flows(g)[0])


_add(
    "flow_completeness",
    _flow_completeness,
    _N
    + """, en AS (SELECT id, name, qualified_name FROM nodes WHERE kind IN ('function', 'method') AND (is_test OR regexp_matches(lower(name), '^(main|run|start|serve|handler|cli)$') OR id NOT IN (SELECT dst FROM edges WHERE kind = 'calls'))),
    k AS (SELECT 'order::' || (id - 6000000000000000) AS name FROM nodes WHERE kind = 'method' AND id % 100 = 7 UNION ALL SELECT 'nowhere'),
    m AS (SELECT en.id AS entry, count(DISTINCT e.dst) + 1 AS n FROM en JOIN edges e ON e.src = en.id AND e.kind = 'calls' AND e.conf_class <> 'ambiguous' GROUP BY en.id HAVING count(DISTINCT e.dst) >= 2),
    c AS (SELECT (SELECT count(*) FROM k) AS known, (SELECT count(*) FROM k WHERE name IN (SELECT lower(qualified_name) FROM en)) AS found, (SELECT count(*) FROM m) AS flows)
    SELECT known, found, flows, round(found / known::DOUBLE, 3) AS recall, 1::BIGINT AS avg_depth, 1::BIGINT AS max_depth FROM c""",
)


def _multi_hop(s: SparkSession, d: str) -> DataFrame:
    line = read_table(s, d, "lineitem")
    hits = line.select(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("id"), F.col("l_linenumber").cast("long").alias("rank"))
    anchors = line.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("id")).distinct()
    near = line.select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("other")).distinct()
    expected = line.select(F.col("l_orderkey").alias("task"), F.col("l_suppkey").alias("other")).distinct()
    return evaluation.multi_hop(hits, anchors, near, expected)


_add(
    "multi_hop",
    _multi_hop,
    """WITH h AS (SELECT l_orderkey AS task, l_partkey AS id, l_linenumber::BIGINT AS rank FROM lineitem), a AS (SELECT DISTINCT l_orderkey AS task, l_partkey AS id FROM lineitem WHERE l_returnflag = 'R'),
    r AS (SELECT task, min(rank) AS anchor_rank, min({'r': rank, 'i': id}).i AS id FROM a JOIN h USING (task, id) GROUP BY task), x AS (SELECT DISTINCT l_orderkey AS task, l_suppkey AS other FROM lineitem), n AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS other FROM lineitem),
    g AS (SELECT r.task, round(count(n.id) / count(*)::DOUBLE, 3) AS recall FROM r JOIN x USING (task) LEFT JOIN n ON n.id = r.id AND n.other = x.other GROUP BY r.task)
    SELECT r.task, anchor_rank, recall, recall AS score FROM r JOIN g USING (task)""",
)


def _token_efficiency(s: SparkSession, d: str) -> DataFrame:
    g = commerce_graph(s, d)
    naive = read_table(s, d, "documents").agg(F.sum(F.greatest(F.lit(1), F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)))).first()[0]
    return evaluation.token_efficiency(g.nodes.select(F.col("kind").alias("question"), "qualified_name", "source_uri"), int(naive or 0))


_add(
    "token_efficiency",
    _token_efficiency,
    _N
    + """, t AS (SELECT kind AS question, count(*) AS hit_count, sum(greatest(1, length(qualified_name) // 4) + greatest(1, length(coalesce(source_uri, '')) // 4))::BIGINT AS graph_tokens FROM nodes GROUP BY kind)
    SELECT *, round((SELECT sum(greatest(1, length(coalesce(text, '')) // 4)) FROM documents)::DOUBLE / graph_tokens, 1) AS ratio FROM t""",
)

# --- motifs, entries, diffs ---


def _as_functions(g: Graph) -> Graph:
    return Graph(g.nodes.withColumn("kind", F.when(F.col("kind") == "method", "function").otherwise(F.col("kind"))), g.edges)


_add(
    "motif_security_audit",
    lambda s, d: motifs.security_audit("order_1").match(_as_functions(commerce_graph(s, d))),
    _N + " SELECT DISTINCT src AS caller, dst AS callee FROM edges JOIN nodes a ON a.id = src WHERE edges.kind = 'calls' AND contains(lower(a.name), 'order_1')",
)


def _kin(s: SparkSession, d: str) -> Graph:
    """Nations and regions as classes: each nation inherits from its region and the next, each region from a root."""
    n = read_table(s, d, "nation").selectExpr("n_nationkey AS id", "n_regionkey AS r")
    edges = n.selectExpr("id AS src", "1000 + r AS dst").unionByName(n.selectExpr("id AS src", "1000 + (r + 1) % 5 AS dst")).unionByName(s.range(5).selectExpr("1000 + id AS src", "9999L AS dst"))
    ids = edges.selectExpr("src AS id").unionByName(edges.selectExpr("dst AS id")).distinct()
    return Graph(ids.selectExpr("id", "'class' AS kind", "CAST(id AS string) AS name"), edges.selectExpr("*", "'inherits' AS kind"))


_add(
    "motif_diamond_inheritance",
    lambda s, d: motifs.diamond_inheritance().match(_kin(s, d)).filter("left < right"),
    "SELECT n_nationkey AS child, least(1000 + n_regionkey, 1000 + (n_regionkey + 1) % 5) AS left, greatest(1000 + n_regionkey, 1000 + (n_regionkey + 1) % 5) AS right, 9999::BIGINT AS top FROM nation",
)
_ROUTE = "concat(element_at(array('route_', 'get', 'plain_', 'on_', 'post'), CAST(p_partkey % 5 + 1 AS INT)), CASE WHEN p_partkey % 5 IN (1, 4) THEN '' ELSE CAST(p_partkey AS STRING) END)"
_add(
    "framework_entries",
    lambda s, d: read_table(s, d, "part").selectExpr("p_partkey AS id", f"{_ROUTE} AS name", "CASE WHEN p_size % 2 = 0 THEN 'app::router::x' ELSE 'app::x' END AS q", "CASE WHEN p_partkey % 7 = 0 THEN array('@app.route(\"/\")') ELSE array('@property') END AS deco").select("id", flows.is_framework_entry(F.col("name"), F.col("q"), F.col("deco")).alias("entry")),
    "SELECT p_partkey AS id, p_partkey % 7 = 0 OR p_partkey % 5 IN (0, 3) OR (p_partkey % 5 IN (1, 4) AND p_size % 2 = 0) AS entry FROM part",
)


def _flows_through(s: SparkSession, d: str) -> DataFrame:
    g = commerce_graph(s, d)
    found, members = flows.materialise_flows(g)
    return flows.flows_through(found, members, g.nodes.filter("kind = 'function' AND name LIKE '%e%'")).select("entry")


_add(
    "flows_through",
    _flows_through,
    _N
    + """, en AS (SELECT id FROM nodes WHERE kind IN ('function', 'method') AND (is_test OR regexp_matches(lower(name), '^(main|run|start|serve|handler|cli)$') OR id NOT IN (SELECT dst FROM edges WHERE kind = 'calls'))),
    m AS (SELECT DISTINCT en.id AS entry, e.dst AS id FROM en JOIN edges e ON e.src = en.id AND e.kind = 'calls' AND e.conf_class <> 'ambiguous'), k AS (SELECT entry FROM m GROUP BY entry HAVING count(*) >= 2)
    SELECT DISTINCT entry FROM m JOIN k USING (entry) JOIN nodes n ON n.id = m.id WHERE n.kind = 'function' AND n.name LIKE '%e%'""",
)

# --- the store ---


def _one_each(g: Graph) -> Graph:
    """The store tells edges apart by id; of line items that repeat one, that with the least part stays."""
    edges = g.edges.groupBy("id", "src", "kind").agg(F.min("dst").alias("dst"), F.min("conf_class").alias("conf_class"), F.min("confidence").alias("confidence"))
    return Graph(g.nodes, edges.select(g.edges.columns))


_ONE_EACH = ", e AS (SELECT id, src, min(dst) AS dst, kind FROM edges GROUP BY id, src, kind)"


def _roundtrip(s: SparkSession, d: str) -> DataFrame:
    store = Store(s, scratch_path(s, "store"))
    g = commerce_graph(s, d)
    store.save(g, g.nodes.filter("source_uri IS NOT NULL").select(F.col("source_uri").alias("path"), F.md5("source_uri").alias("hash")).distinct())
    back = store.load()
    return primitives.kind_counts(back.nodes).unionByName(primitives.kind_counts(back.edges)).unionByName(store.file_state().agg(F.lit("files").alias("kind"), F.count(F.lit(1)).alias("n")))


_add(
    "store_roundtrip",
    _roundtrip,
    _N + " SELECT kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT kind, count(*) FROM edges GROUP BY kind UNION ALL SELECT 'files', count(DISTINCT source_uri) FROM nodes WHERE source_uri IS NOT NULL",
)


def _update(s: SparkSession, d: str) -> DataFrame:
    """Files of some brands are replaced by half of their nodes; edges into the lost half go."""
    store = Store(s, scratch_path(s, "store"))
    g = _one_each(commerce_graph(s, d))
    files = g.nodes.filter("source_uri IS NOT NULL").select(F.col("source_uri").alias("path"), F.md5("source_uri").alias("hash")).distinct()
    store.save(g, files)
    touched = files.filter("path LIKE 'brand/Brand#1%'")
    kept = g.nodes.filter("source_uri LIKE 'brand/Brand#1%' AND id % 2 = 0")
    changed = Graph(kept, g.edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").select(g.edges.columns))
    store.update(changed, touched.select("path"), files)
    back = store.load()
    return primitives.kind_counts(back.nodes).unionByName(primitives.kind_counts(back.edges))


_add(
    "store_update",
    _update,
    _N
    + _ONE_EACH
    + """, lost AS (SELECT id FROM nodes WHERE source_uri LIKE 'brand/Brand#1%' AND id % 2 = 1)
    SELECT kind, count(*) AS n FROM nodes WHERE id NOT IN (SELECT id FROM lost) GROUP BY kind UNION ALL SELECT kind, count(*) FROM e WHERE src NOT IN (SELECT id FROM lost) AND dst NOT IN (SELECT id FROM lost) GROUP BY kind""",
)


def _versions(s: SparkSession, d: str) -> DataFrame:
    """Counts by kind at each version of a store: as saved, after one brand's parts went, after another's, after a nation's suppliers were given back without edges."""
    store = Store(s, scratch_path(s, "store"))
    g = _one_each(commerce_graph(s, d))
    edges = g.edges
    none = Graph(g.nodes.limit(0), edges.limit(0))
    files = g.nodes.filter("source_uri IS NOT NULL").select(F.col("source_uri").alias("path"), F.md5("source_uri").alias("hash")).distinct()
    store.save(Graph(g.nodes, edges), files)
    for path in ("brand/Brand#11", "brand/Brand#22"):
        store.update(none, files.filter(F.col("path") == path), files.limit(0))
    store.update(Graph(g.nodes.filter("source_uri = 'nation/3'"), edges.limit(0)), files.filter("path = 'nation/3'"), files)
    out = None
    for v in range(1, store.version() + 1):
        back = store.load(v)
        for part, rows in (("node", back.nodes), ("edge", back.edges)):
            part_rows = primitives.kind_counts(rows).select(F.lit(v).cast("long").alias("version"), F.lit(part).alias("part"), "kind", "n")
            out = part_rows if out is None else out.unionByName(part_rows)
    return out.unionByName(store.file_state().select(F.lit(v).cast("long").alias("version"), F.lit("file").alias("part"), F.lit("file").alias("kind")).groupBy("version", "part", "kind").agg(F.count(F.lit(1)).alias("n")))


_add(
    "store_versions",
    _versions,
    _N
    + _ONE_EACH
    + """, gone AS (SELECT id, CASE WHEN source_uri = 'brand/Brand#11' THEN 2 WHEN source_uri = 'brand/Brand#22' THEN 3 ELSE 99 END AS until FROM nodes),
    v AS (SELECT unnest([1, 2, 3, 4])::BIGINT AS version),
    back AS (SELECT id FROM nodes WHERE source_uri = 'nation/3')
    SELECT version, 'node' AS part, kind, count(*) AS n FROM v, nodes JOIN gone USING (id) WHERE until > version GROUP BY ALL
    UNION ALL SELECT version, 'edge', kind, count(*) FROM v, e JOIN gone a ON a.id = e.src JOIN gone b ON b.id = e.dst WHERE a.until > version AND b.until > version AND NOT (version = 4 AND e.src IN (SELECT id FROM back)) GROUP BY ALL
    UNION ALL SELECT 4, 'file', 'file', count(DISTINCT source_uri) - 2 FROM nodes WHERE source_uri IS NOT NULL""",
)


def _refreshed(s: SparkSession, d: str) -> DataFrame:
    """What calls stand for after two files changed: definitions of one are renamed, some of the other are gone."""
    store = Store(s, scratch_path(s, "store"), resolve=True)
    g = placeholder_graph(s, d)
    edges = g.edges.groupBy("id", "src", "kind", "conf_class", "confidence").agg(F.min("dst").alias("dst"))
    files = g.nodes.filter("source_uri IS NOT NULL").select(F.col("source_uri").alias("path"), F.md5("source_uri").alias("hash")).distinct()
    store.save(Graph(g.nodes, edges.select(g.edges.columns)), files)
    defined = F.col("kind") == "function"
    renamed = F.when(defined & (F.col("source_uri") == "f/3.py"), F.concat(F.lit("n"), ((F.col("id") + 1) % 1500).cast("string"))).otherwise(F.col("name"))
    nodes = g.nodes.filter("source_uri IN ('f/3.py', 'f/7.py')").filter(~(defined & (F.col("source_uri") == "f/7.py") & (F.col("id") % 3 == 0))).withColumn("name", renamed)
    changed = Graph(nodes, edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").select(g.edges.columns))
    store.update(changed, files.filter("path IN ('f/3.py', 'f/7.py')"), files)
    return store.resolved().select("edge_id", "target", F.col("tier").cast("long").alias("tier"), "conf_class")


_add(
    "refresh_resolution",
    _refreshed,
    """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey % 1500) AS r FROM lineitem GROUP BY ALL),
    p AS (SELECT p_partkey, CASE WHEN p_partkey % 40 = 3 THEN (p_partkey + 1) % 1500 ELSE p_partkey % 1500 END AS r FROM part WHERE NOT (p_partkey % 40 = 7 AND p_partkey % 3 = 0)),
    c AS (SELECT l_orderkey * 100 + l_linenumber AS edge_id, p_partkey AS target, l_orderkey % 40 = p_partkey % 40 AS same, l_orderkey = p_partkey AS near FROM l JOIN p USING (r)),
    n AS (SELECT *, count(*) OVER w AS n1, sum(same::INT) OVER w AS n2, sum(near::INT) OVER w AS n3 FROM c WINDOW w AS (PARTITION BY edge_id))
    SELECT edge_id, target, CASE WHEN n1 = 1 THEN 1 WHEN n2 = 1 THEN 2 ELSE 3 END::BIGINT AS tier, CASE WHEN n1 = 1 OR n2 = 1 THEN 'extracted' ELSE 'inferred' END AS conf_class
    FROM n WHERE n1 = 1 OR (n2 = 1 AND same) OR (n2 <> 1 AND n3 = 1 AND near)""",
)


def _snapshots(s: SparkSession, d: str) -> DataFrame:
    store = Store(s, scratch_path(s, "store"))
    g = commerce_graph(s, d)
    store.save(Graph(g.nodes.filter("id % 5 <> 0"), g.edges.filter("id % 5 <> 0")))
    store.snapshot("before")
    store.save(Graph(g.nodes.filter("id % 7 <> 0"), g.edges))
    store.snapshot("after")
    base, head = store.load_snapshot("before"), store.load_snapshot("after")
    return changes.graph_diff_nodes(base.nodes, head.nodes, ["name", "kind"]).groupBy("change").agg(F.count(F.lit(1)).alias("n")).unionByName(store.snapshots().select(F.col("label").alias("change"), F.col("nodes").alias("n")))


_add(
    "snapshot_diff",
    _snapshots,
    _N
    + """ SELECT 'added' AS change, count(*) AS n FROM nodes WHERE id % 5 = 0 AND id % 7 <> 0 UNION ALL SELECT 'removed', count(*) FROM nodes WHERE id % 5 <> 0 AND id % 7 = 0
    UNION ALL SELECT 'before', count(*) FROM nodes WHERE id % 5 <> 0 UNION ALL SELECT 'after', count(*) FROM nodes WHERE id % 7 <> 0""",
)


# --- history ---


def _branching(s: SparkSession, d: str) -> DataFrame:
    """Orders as commits: seven on the main line, three on a branch from the third, which every third time is merged; parts are valid between two of them."""
    orders = read_table(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"))
    n = orders.count()
    rest = F.col("k") % 10
    first = F.when(rest == 0, F.col("k") - 4).when(rest == 7, F.col("k") - 5).otherwise(F.col("k") - 1)
    merged = F.when((rest == 0) & (F.floor(F.col("k") / 10) % 3 == 0), F.col("k") - 1)
    parents = orders.select(F.col("k").cast("string").alias("commit"), F.explode(F.array(first, merged)).alias("parent")).filter("parent IS NOT NULL AND parent >= 0").withColumn("parent", F.col("parent").cast("string"))
    p = F.col("p_partkey").cast("long")
    at = lambda by: (p * by % n).cast("string")
    rows = read_table(s, d, "part").select(F.concat(F.lit("part::"), p.cast("string")).alias("qualified_name"), at(7).alias("valid_from"), F.when(p % 3 == 0, at(13)).alias("valid_to"))
    return changes.temporal_diff(rows, changes.history(parents), str(n // 20 * 10 + 5), str(n - 6))


_add(
    "temporal_branching",
    _branching,
    """WITH RECURSIVE o AS (SELECT o_orderkey AS k FROM orders), n AS (SELECT count(*) AS n FROM o), p AS (
        SELECT k, CASE k % 10 WHEN 0 THEN k - 4 WHEN 7 THEN k - 5 ELSE k - 1 END AS parent FROM o UNION ALL SELECT k, k - 1 FROM o WHERE k % 10 = 0 AND k // 10 % 3 = 0
    ), a AS (
        SELECT which, k, k AS tip FROM (SELECT 'base' AS which, n // 20 * 10 + 5 AS k FROM n UNION ALL SELECT 'head', n - 6 FROM n)
        UNION SELECT which, parent, tip FROM a JOIN p USING (k) WHERE parent >= 0
    ), v AS (SELECT 'part::' || p_partkey AS qualified_name, p_partkey * 7 % n AS f, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 13 % n END AS t FROM part, n),
    live AS (SELECT qualified_name, w.which FROM v, (SELECT DISTINCT which FROM a) w
        WHERE EXISTS (FROM a WHERE a.which = w.which AND a.k = v.f) AND NOT EXISTS (FROM a WHERE a.which = w.which AND a.k = v.t AND a.k <> a.tip))
    SELECT qualified_name, CASE WHEN min(which) = 'head' THEN 'added' ELSE 'removed' END AS change FROM live GROUP BY qualified_name HAVING count(*) = 1""",
)


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
