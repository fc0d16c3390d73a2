"""Registered queries of the resolution passes, control flow and evaluation, over projections of the tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import cfg
from tessera.operators import resolution
from tessera.plans import evaluation
from tessera.runtime import read_table
from tessera.sources import code, store
from tessera.sources.adapters import COMMERCE_SQL, Graph, commerce_graph
from tessera.operators.communities import by_source

_Q: dict = {}
_SQL: dict[str, str] = {}


def _add(name, run, sql=None):
    _Q[name] = run
    if sql is not None:
        _SQL[name] = sql


def placeholder_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders that call brands by name: parts are definitions named after their brand, lines are placeholder calls."""
    part, line, orders = (read_table(spark, sf_dir, t) for t in ("part", "lineitem", "orders"))
    definition = part.select(F.col("p_partkey").cast("long").alias("id"), F.lit("function").alias("kind"), F.concat(F.lit("n"), (F.col("p_partkey") % 1500).cast("string")).alias("name"), F.concat(F.lit("part::"), F.col("p_partkey").cast("string")).alias("qualified_name"), F.concat(F.lit("f/"), (F.col("p_partkey") % 40).cast("string"), F.lit(".py")).alias("source_uri"), F.lit(False).alias("is_test"))
    caller = orders.select((F.col("o_orderkey") + 10**12).alias("id"), F.lit("method").alias("kind"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("name"), F.concat(F.lit("order::"), F.col("o_orderkey").cast("string")).alias("qualified_name"), F.concat(F.lit("f/"), (F.col("o_orderkey") % 40).cast("string"), F.lit(".py")).alias("source_uri"), (F.col("o_orderstatus") == "P").alias("is_test"))
    holder = part.select((F.col("p_partkey") % 1500 + 2 * 10**12).alias("id"), F.lit("function").alias("kind"), F.concat(F.lit("n"), (F.col("p_partkey") % 1500).cast("string")).alias("name"), F.concat(F.lit("call::n"), (F.col("p_partkey") % 1500).cast("string")).alias("qualified_name"), F.lit(None).cast("string").alias("source_uri"), F.lit(False).alias("is_test")).distinct()
    edges = line.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), (F.col("l_orderkey") + 10**12).alias("src"), (F.col("l_partkey") % 1500 + 2 * 10**12).alias("dst"), F.lit("calls").alias("kind"), F.lit("ambiguous").alias("conf_class"), F.lit(0.0).alias("confidence"))
    return Graph(definition.unionByName(caller).unionByName(holder), edges)


_PLACE = """WITH l AS (SELECT row_number() OVER () AS line, * FROM lineitem), cand AS (
    SELECT line, l_orderkey * 100 + l_linenumber AS edge_id, p_partkey AS target, (l_orderkey % 40) = (p_partkey % 40) AS same, l_orderkey = p_partkey AS near
    FROM l JOIN part ON l_partkey % 1500 = p_partkey % 1500
), n AS (SELECT *, count(*) OVER (PARTITION BY line) AS n1, sum(same::INT) OVER (PARTITION BY line) AS n2, sum(near::INT) OVER (PARTITION BY line) AS n3 FROM cand)
"""
_add("call_resolve_unique", lambda s, d: resolution.resolve_calls(placeholder_graph(s, d)).select("edge_id", "target", F.col("tier").cast("long").alias("tier"), "conf_class"), _PLACE + "SELECT edge_id, target, CASE WHEN n1 = 1 THEN 1 WHEN n2 = 1 THEN 2 ELSE 3 END::BIGINT AS tier, CASE WHEN n1 = 1 OR n2 = 1 THEN 'extracted' ELSE 'inferred' END AS conf_class FROM n WHERE n1 = 1 OR (n2 = 1 AND same) OR (n2 <> 1 AND n3 = 1 AND near)")


def _types(spark, d) -> DataFrame:
    g = placeholder_graph(spark, d)
    n = g.nodes.withColumn("kind", F.when(F.col("kind") == "function", "class").otherwise(F.col("kind"))).withColumn("qualified_name", F.regexp_replace("qualified_name", "^call::", "type::"))
    return resolution.resolve_types(Graph(n, g.edges.withColumn("kind", F.lit("inherits"))))


_add("type_resolve", lambda s, d: _types(s, d).select("edge_id", "target"), _PLACE + "SELECT edge_id, target FROM n WHERE n1 = 1")
_add("tested_by_derive", lambda s, d: resolution.derive_tested_by(commerce_graph(s, d)), f"WITH {COMMERCE_SQL} SELECT DISTINCT e.dst AS src, e.src AS dst FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE e.kind = 'calls' AND a.is_test AND NOT b.is_test")


def _generic(spark, d) -> DataFrame:
    e = commerce_graph(spark, d).edges.select("id", "src", "dst", F.when((F.col("kind") == "calls") & (F.col("id") % 3 == 0), "mentions").otherwise(F.col("kind")).alias("kind"))
    return resolution.dedupe_generic(e).select("id", "kind")


_add("generic_edge_dedup", _generic, f"WITH {COMMERCE_SQL}, e AS (SELECT id, src, dst, CASE WHEN kind = 'calls' AND id % 3 = 0 THEN 'mentions' ELSE kind END AS kind FROM edges), m AS (SELECT *, max((kind <> 'mentions')::INT) OVER (PARTITION BY src, dst) AS s FROM e) SELECT id, kind FROM m WHERE NOT (kind = 'mentions' AND s = 1)")
_add("stub_nodes", lambda s, d: resolution.stub_nodes(Graph(commerce_graph(s, d).nodes.filter("kind <> 'function'"), commerce_graph(s, d).edges)), f"WITH {COMMERCE_SQL} SELECT DISTINCT dst AS id, 'stub::' || dst AS qualified_name FROM edges WHERE dst NOT IN (SELECT id FROM nodes WHERE kind <> 'function')")


def _phantoms(spark, d) -> DataFrame:
    g = commerce_graph(spark, d)
    n = g.nodes.withColumn("source_uri", F.concat(F.lit("x/"), F.col("id").cast("string"), F.element_at(F.array(*(F.lit(x) for x in (".py", ".rs", ".ts", ".txt"))), (F.col("id") % 4 + 1).cast("int"))))
    return resolution.drop_cross_language(Graph(n, g.edges)).edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_add("phantom_filter", _phantoms, f"WITH {COMMERCE_SQL} SELECT kind, count(*) AS n FROM edges WHERE kind NOT IN ('calls', 'imports') OR src % 4 = 3 OR dst % 4 = 3 OR src % 4 = dst % 4 GROUP BY kind")


def _mentions(spark, d) -> DataFrame:
    tokens = read_table(spark, d, "conversations").select(F.col("conv_id").alias("src"), F.concat(F.lit("PART::"), (F.col("conv_id") % 300).cast("string")).alias("token"))
    more = read_table(spark, d, "conversations").select(F.col("conv_id").alias("src"), F.concat(F.lit("part::"), (F.col("turn") + 1).cast("string")).alias("token"))
    return resolution.resolve_mentions(tokens.unionByName(more), commerce_graph(spark, d).nodes.filter("kind = 'function'").withColumn("name", F.col("qualified_name")))


_add("mention_resolve", _mentions, f"WITH {COMMERCE_SQL}, p AS (SELECT id, qualified_name FROM nodes WHERE kind = 'function'), m AS (SELECT DISTINCT conv_id AS src, 'PART::' || (conv_id % 300) AS token FROM conversations UNION SELECT DISTINCT conv_id, 'part::' || (turn + 1) FROM conversations) SELECT src, token, id AS target FROM m JOIN p ON lower(token) = qualified_name WHERE id <> src")


def _injections(spark, d) -> DataFrame:
    part, supplier = read_table(spark, d, "part"), read_table(spark, d, "supplier")
    fields = part.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") % 40).cast("string").alias("type_name"))
    return resolution.spring_injections(fields, supplier.select((F.col("s_suppkey") % 40).cast("string").alias("type_name"), F.col("s_suppkey").alias("impl")))


_add("spring_injections", _injections, "SELECT p_partkey AS src, impl AS target FROM part JOIN (SELECT s_suppkey % 40 AS t, min(s_suppkey) AS impl FROM supplier GROUP BY 1 HAVING count(*) = 1) ON t = p_partkey % 40")

# --- generated sources: one function a part ---


def _sources(spark, d) -> DataFrame:
    p = read_table(spark, d, "part")
    body = F.concat(F.lit("def part_"), F.col("p_partkey").cast("string"), F.lit("(a, b):\n    x = a\n    if b:\n        return part_"), (F.col("p_partkey") - 1).cast("string"), F.lit("(x, b)\n    for i in range("), F.col("p_size").cast("string"), F.lit("):\n        x = x + i\n    return x\n"))
    return p.select(F.concat(F.lit("gen/p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), body.alias("content"))


_add("code_symbols", lambda s, d: code.code_graph(_sources(s, d)).nodes.filter("kind IN ('function', 'file') AND source_uri IS NOT NULL").select("kind", "name", "source_uri", F.col("line_end").cast("long").alias("line_end")), "SELECT 'function' AS kind, 'part_' || p_partkey AS name, 'gen/p' || p_partkey || '.py' AS source_uri, 7::BIGINT AS line_end FROM part UNION ALL SELECT 'file', 'p' || p_partkey || '.py', 'gen/p' || p_partkey || '.py', 8 FROM part")
_add("data_flow_edges", lambda s, d: code.extract_rows(_sources(s, d)).filter("kind = 'data_flow'").select("src", "dst"), "SELECT unnest([q, 'param::' || q || '::a', q, 'param::' || q || '::b']) AS src, unnest(['var::' || q || '::x', 'var::' || q || '::x', 'return::' || q, 'return::' || q]) AS dst FROM (SELECT 'gen/p' || p_partkey || '.py::part_' || p_partkey AS q FROM part)")


def _cfg(spark, d) -> DataFrame:
    names = ["blocks", "branches", "loops", "returns", "unreachable"]

    @F.arrow_udf("struct<" + ",".join(f"{c}:int" for c in names) + ">")
    def run(text: pa.Array) -> pa.Array:
        rows = [cfg.summary(t, depth=False) for t in text.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[c] for r in rows], pa.int32()) for c in names], names)

    return _sources(spark, d).select("path", run("content").alias("s")).select("path", *(F.col(f"s.{c}").cast("long").alias(c) for c in ("blocks", "branches", "loops", "returns", "unreachable")))


_add("cfg_summary", _cfg, "SELECT 'gen/p' || p_partkey || '.py' AS path, 7::BIGINT AS blocks, 1::BIGINT AS branches, 1::BIGINT AS loops, 2::BIGINT AS returns, 0::BIGINT AS unreachable FROM part")

# --- sinks ---
_add("graphml_export", lambda s, d: store.graphml_rows(commerce_graph(s, d)), f"""WITH {COMMERCE_SQL} SELECT 0 AS part, 0::BIGINT AS id, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">' AS line UNION ALL SELECT 3, 0, '</graph></graphml>' UNION ALL SELECT 1, id, '<node id="n' || id || '"><data key="kind">' || kind || '</data><data key="qname">' || qualified_name || '</data></node>' FROM nodes UNION ALL SELECT 2, id, '<edge source="n' || src || '" target="n' || dst || '"><data key="kind">' || kind || '</data></edge>' FROM edges""")
_add("cypher_export", lambda s, d: store.cypher_rows(commerce_graph(s, d)), f"""WITH {COMMERCE_SQL} SELECT 1 AS part, id, 'MERGE (n:' || upper(kind[1]) || kind[2:] || ' {{id: ' || id || '}}) SET n.qname = ''' || qualified_name || ''';' AS line FROM nodes UNION ALL SELECT 2, id, 'MATCH (a {{id: ' || src || '}}), (b {{id: ' || dst || '}}) MERGE (a)-[:' || upper(kind) || ']->(b);' FROM edges""".replace("{{", "{").replace("}}", "}"))
_add(
    "wiki_export",
    lambda s, d: store.wiki_pages(commerce_graph(s, d), by_source(commerce_graph(s, d))).select("community", F.md5("page").alias("page_md5")),
    f"""WITH {COMMERCE_SQL}, com AS (SELECT id, min(id) OVER (PARTITION BY source_uri) AS community FROM nodes WHERE source_uri IS NOT NULL),
    m AS (SELECT community, n.id, '- `' || qualified_name || '` (' || kind || ')' AS l, row_number() OVER (PARTITION BY community ORDER BY n.id) AS r FROM com JOIN nodes n ON n.id = com.id)
    SELECT community, md5('# Community ' || community || chr(10) || chr(10) || count(*) || ' members' || chr(10) || chr(10) || string_agg(l, chr(10) ORDER BY r) FILTER (WHERE r <= 20)) AS page_md5 FROM m GROUP BY community""",
)

# --- evaluation ---


def _judged(spark, d) -> tuple[DataFrame, DataFrame]:
    line = read_table(spark, d, "lineitem")
    hits = line.select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("id"), F.col("l_linenumber").cast("long").alias("rank"))
    return hits, line.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("id")).distinct()


_add("search_mrr", lambda s, d: evaluation.mean_reciprocal_rank(*_judged(s, d)), "SELECT count(*) AS queries, round(avg(coalesce(rr, 0)), 6) AS mrr FROM (SELECT DISTINCT l_orderkey AS q FROM lineitem) LEFT JOIN (SELECT l_orderkey AS q, 1.0::DOUBLE / min(a.l_linenumber) AS rr FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_partkey = a.l_partkey AND b.l_returnflag = 'R') GROUP BY l_orderkey) USING (q)")


def _sets(spark, d) -> DataFrame:
    line = read_table(spark, d, "lineitem")
    found = line.filter("l_linenumber <= 3").select(F.col("l_orderkey").alias("case"), F.col("l_partkey").alias("item")).distinct()
    wanted = line.filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("case"), F.col("l_partkey").alias("item")).distinct()
    return evaluation.micro_scores(found, wanted)


_add("impact_accuracy", _sets, "WITH f AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber <= 3), w AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'N'), s AS (SELECT (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM w) AS wanted, (SELECT count(*) FROM (SELECT * FROM f INTERSECT SELECT * FROM w)) AS hit) SELECT found, wanted, hit, round(hit / found::DOUBLE, 6) AS precision, round(hit / wanted::DOUBLE, 6) AS recall, round(2.0 * hit / (found + wanted)::DOUBLE, 6) AS f1 FROM s")


def _learned(spark, d) -> DataFrame:
    g = commerce_graph(spark, d)
    e = g.edges.join(g.nodes.select(F.col("id").alias("src"), F.col("source_uri").alias("a")), "src").join(g.nodes.select(F.col("id").alias("dst"), F.col("source_uri").alias("b")), "dst").select("kind", "a", "b")
    commits = read_table(spark, d, "orders").select((F.col("o_orderkey") % 100).alias("commit"), F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("path"))
    parts = read_table(spark, d, "lineitem").join(read_table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_orderkey") % 100).alias("commit"), F.concat(F.lit("brand/"), F.col("p_brand")).alias("path"))
    return evaluation.learned_costs(e, commits.unionByName(parts))


_add("learned_edge_costs", _learned, f"WITH {COMMERCE_SQL}, c AS (SELECT DISTINCT o_orderkey % 100 AS c, 'customer/' || o_custkey AS p FROM orders UNION SELECT DISTINCT l_orderkey % 100, 'brand/' || p_brand FROM lineitem JOIN part ON l_partkey = p_partkey), x AS (SELECT e.kind, a.source_uri AS a, b.source_uri AS b FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.source_uri <> b.source_uri), q AS (SELECT DISTINCT a, b FROM x), t AS (SELECT DISTINCT q.a, q.b FROM q JOIN c l ON l.p = q.a JOIN c r ON r.p = q.b AND r.c = l.c) SELECT kind, count(*) AS edges, count(t.a) AS together, round(greatest(0.1, least(10.0, 1 - log2((count(t.a) + 2.0::DOUBLE) / (count(*) + 20)))), 6) AS cost FROM x LEFT JOIN t ON t.a = x.a AND t.b = x.b GROUP BY kind")
_add("latency_percentiles", lambda s, d: evaluation.nearest_rank(read_table(s, d, "events"), "event_type", "value"), "SELECT event_type AS key, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
