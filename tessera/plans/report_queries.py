"""Registered queries of hand edits and reports, over the commerce projection, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import editing, overview, primitives
from tessera.operators.communities import by_source
from tessera.runtime import read_table
from tessera.sources.adapters import COMMERCE_SQL, Graph, commerce_graph

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[Graph], DataFrame], sql: str | None = None, *, recursive: bool = False) -> None:
    _Q[name] = lambda spark, d: run(commerce_graph(spark, d))
    if sql is not None:
        _SQL[name] = f"WITH {'RECURSIVE ' * recursive}{COMMERCE_SQL}{sql}"


_DEG = ", deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)"
_COM = ", com AS (SELECT id, min(id) OVER (PARTITION BY source_uri) AS community FROM nodes WHERE source_uri IS NOT NULL)"
_FILES = ", files AS (SELECT DISTINCT source_uri FROM nodes WHERE source_uri LIKE 'brand/%' AND source_uri < 'brand/Brand#2')"


def _files(g: Graph) -> DataFrame:
    return g.nodes.filter("source_uri LIKE 'brand/%' AND source_uri < 'brand/Brand#2'").select("source_uri").distinct()


# --- hand edits ---

_add(
    "create_nodes",
    lambda g: editing.create_nodes(g.nodes.select("id", "kind", F.concat(F.lit("app::"), "qualified_name").alias("qualified_name"))).select("id", "kind", "name"),
    " SELECT id, kind, split_part(qualified_name, '::', -1) AS name FROM nodes",
)
_add(
    "construct_edges",
    lambda g: editing.construct_edges(g.edges.select("id", F.when(F.col("kind") == "calls", "inferred").otherwise("extracted").alias("c")), F.col("c")).select("id", "conf_class", "confidence"),
    " SELECT id, CASE kind WHEN 'calls' THEN 'inferred' ELSE 'extracted' END AS conf_class, CASE kind WHEN 'calls' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM edges",
)
_add(
    "add_edges",
    lambda g: primitives.kind_counts(editing.add_edges(g, g.edges.filter("kind = 'imports'").select("id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("used_by").alias("kind"), "conf_class", "confidence")).edges),
    " SELECT kind, count(*) AS n FROM edges GROUP BY kind UNION ALL SELECT 'used_by', count(*) FROM edges WHERE kind = 'imports'",
)
_add(
    "remove_edges_by_id",
    lambda g: editing.remove_edges_by_id(g, g.edges.filter("conf_class = 'ambiguous'").select("id")).edges.select("id"),
    " SELECT e.id FROM edges e WHERE NOT EXISTS (FROM edges x WHERE x.id = e.id AND x.conf_class = 'ambiguous')",
)


def _rename(g: Graph) -> Graph:
    """Suppliers lose their last digit; those that meet an existing or another renamed name are merged."""
    n = g.nodes.filter("kind = 'class' AND qualified_name LIKE 'supplier::%'")
    return editing.rename_nodes(g, n.filter("length(qualified_name) > length('supplier::') + 1").select("id", F.expr("substring(qualified_name, 1, length(qualified_name) - 1)").alias("new_qname")))


_REN = """, r AS (SELECT id, qualified_name, CASE WHEN kind = 'class' AND qualified_name LIKE 'supplier::%' AND length(qualified_name) > length('supplier::') + 1 THEN substr(qualified_name, 1, length(qualified_name) - 1) ELSE qualified_name END AS wanted FROM nodes),
    w AS (SELECT id, wanted, wanted <> qualified_name AS moves, first_value(id) OVER (PARTITION BY wanted ORDER BY (wanted <> qualified_name)::INT, id) AS winner FROM r),
    lose AS (SELECT id AS loser, winner FROM w WHERE moves AND winner <> id)"""
_add("rename_nodes", lambda g: _rename(g).nodes.select("id", "qualified_name", "name"), _REN + " SELECT w.id, wanted AS qualified_name, CASE WHEN moves THEN split_part(wanted, '::', -1) ELSE name END AS name FROM w JOIN nodes n ON n.id = w.id WHERE w.id NOT IN (SELECT loser FROM lose)")
_add(
    "rename_merges_edges",
    lambda g: _rename(g).edges.select("id", "src", "dst", "kind"),
    _REN
    + """, e AS (SELECT e.id, coalesce(a.winner, e.src) AS src, coalesce(b.winner, e.dst) AS dst, e.kind, (a.winner IS NOT NULL OR b.winner IS NOT NULL) AS moved FROM edges e LEFT JOIN lose a ON a.loser = e.src LEFT JOIN lose b ON b.loser = e.dst)
    SELECT id, src, dst, kind FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, kind ORDER BY moved::INT, id) AS nth FROM e) WHERE NOT moved OR (src <> dst AND nth = 1)""",
)
_add(
    "stamp_revision",
    lambda g: editing.stamp_revision(g.nodes.select("id", F.when(F.col("id") % 3 == 0, "r1").alias("valid_from")), "r9"),
    " SELECT id, CASE WHEN id % 3 = 0 THEN 'r1' ELSE 'r9' END AS valid_from FROM nodes",
)
_add(
    "put_metadata",
    lambda g: editing.put_metadata(g.nodes.filter("kind = 'module'").select(F.col("qualified_name").alias("key"), F.lit("old").alias("value")), g.nodes.filter("kind IN ('module', 'package') AND id % 2 = 0").select(F.col("qualified_name").alias("key"), F.lit("new").alias("value"))),
    " SELECT qualified_name AS key, CASE WHEN id % 2 = 0 THEN 'new' ELSE 'old' END AS value FROM nodes WHERE kind = 'module' OR (kind = 'package' AND id % 2 = 0)",
)
_add("nodes_for_sources", lambda g: editing.nodes_for_sources(g.nodes, _files(g)).select("id", "qualified_name"), _FILES + " SELECT id, qualified_name FROM nodes WHERE source_uri IN (SELECT source_uri FROM files)")
_TOUCH = _FILES + ", hit AS (SELECT id FROM nodes WHERE source_uri IN (SELECT source_uri FROM files))"
_add("edges_for_sources", lambda g: editing.edges_for_sources(g, _files(g)).select("id", "src", "dst", "kind"), _TOUCH + " SELECT min(id) AS id, src, dst, kind FROM edges WHERE src IN (SELECT id FROM hit) OR dst IN (SELECT id FROM hit) GROUP BY src, dst, kind")
_add("delete_sources", lambda g: primitives.kind_counts(editing.delete_sources(g, _files(g)).edges), _TOUCH + " SELECT kind, count(*) AS n FROM edges WHERE src NOT IN (SELECT id FROM hit) AND dst NOT IN (SELECT id FROM hit) GROUP BY kind")


def _archive(g: Graph) -> DataFrame:
    active = g.edges.filter("id % 3 <> 0").select("id", "src", "dst", "kind", F.lit(None).cast("string").alias("valid_to"))
    old = g.edges.filter("id % 2 = 0").select("id", "src", "dst", "kind", (F.col("id") % 10).cast("string").alias("valid_to"))
    return editing.temporal_versions(active, old, ["src", "dst", "kind"]).select("id", "src", "dst", "kind", "valid_to")


_add(
    "temporal_edges",
    _archive,
    """, v AS (SELECT id, src, dst, kind, NULL::VARCHAR AS valid_to, 0 AS archived FROM edges WHERE id % 3 <> 0 UNION ALL SELECT id, src, dst, kind, (id % 10)::VARCHAR, 1 FROM edges WHERE id % 2 = 0)
    SELECT id, src, dst, kind, valid_to FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, kind ORDER BY archived, valid_to DESC NULLS FIRST, id) AS nth FROM v) WHERE nth = 1""",
)

# --- reports ---

_add(
    "graph_summary",
    overview.graph_summary,
    " SELECT 'kind' AS what, kind AS key, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT * FROM (SELECT 'source', source_uri, count(*) AS n FROM nodes WHERE source_uri IS NOT NULL GROUP BY source_uri ORDER BY n DESC, source_uri LIMIT 5)",
)
_TOUCHED = _COM + ", ends AS (SELECT src AS id, dst AS other FROM edges UNION SELECT dst, src FROM edges), touch AS (SELECT ends.id, count(DISTINCT community) AS touched FROM ends JOIN com ON com.id = other GROUP BY ends.id)"
_add("bridge_nodes", lambda g: overview.bridge_nodes(g, by_source(g)), _TOUCHED + " SELECT id, touched FROM touch WHERE touched > 1")
_add("bridge_scores", lambda g: overview.bridge_scores(g, by_source(g)))
_add(
    "simple_cycles",
    lambda g: overview.simple_cycles(g.edges.filter("kind = 'imports'").select(F.col("dst").alias("src"), (F.col("src") % 50 + 3 * 10**15).alias("dst"))).select(F.array_join("path", ">").alias("path")),
    """, p AS (SELECT DISTINCT dst AS src, src % 50 + 3000000000000000 AS dst FROM edges WHERE kind = 'imports'),
    c AS (SELECT [src] AS path FROM p WHERE src = dst UNION ALL SELECT [a.src, a.dst] FROM p a JOIN p b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
        UNION ALL SELECT [a.src, a.dst, b.dst] FROM p a JOIN p b ON a.dst = b.src JOIN p c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst
        UNION ALL SELECT [a.src, a.dst, b.dst, c.dst] FROM p a JOIN p b ON a.dst = b.src JOIN p c ON b.dst = c.src JOIN p d ON c.dst = d.src AND d.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.src < c.dst AND a.dst <> b.dst AND a.dst <> c.dst AND b.dst <> c.dst)
    SELECT array_to_string(path, '>') AS path FROM (SELECT path FROM c ORDER BY len(path), path LIMIT 100)""",
)
C7 = 4 * 10**15 + 7
_add(
    "counterfactual_edges",
    lambda g: overview.counterfactual_edges(g, C7).select("id"),
    f", w AS (SELECT {C7} AS id UNION SELECT dst FROM w JOIN edges ON src = w.id) SELECT id FROM w WHERE id <> {C7}",
    recursive=True,
)
_add(
    "blast_radius",
    lambda g: overview.blast_radius(g, _files(g)),
    _TOUCH
    + """, one AS (SELECT DISTINCT src AS id FROM edges WHERE dst IN (SELECT id FROM hit)), two AS (SELECT id FROM one UNION SELECT src FROM edges WHERE dst IN (SELECT id FROM one)),
    sym AS (SELECT id FROM nodes WHERE id IN (SELECT id FROM hit) AND kind IN ('function', 'method', 'class'))
    SELECT (SELECT count(*) FROM files) AS changed_files, (SELECT count(*) FROM sym) AS changed_symbols, (SELECT count(*) FROM two WHERE id NOT IN (SELECT id FROM hit)) AS impacted,
           (SELECT count(*) FROM sym WHERE id NOT IN (SELECT e.dst FROM edges e JOIN nodes t ON t.id = e.src WHERE t.is_test AND e.kind = 'calls')) AS untested""",
)
_add(
    "flows_affected",
    lambda g: overview.flows_affected(g.edges.filter("kind = 'calls'").select(F.col("src").alias("entry"), F.col("dst").alias("id")).distinct(), g.nodes.join(_files(g), "source_uri", "left_semi")),
    _TOUCH + " SELECT src AS entry, count(DISTINCT dst) AS hits FROM edges WHERE kind = 'calls' AND dst IN (SELECT id FROM hit) GROUP BY src ORDER BY hits DESC, entry LIMIT 20",
)
_add(
    "suggested_questions",
    lambda g: overview.suggested_questions(_files(g).orderBy("source_uri").limit(4), g.nodes.filter("kind = 'package'")).withColumn("place", F.col("place").cast("long")),
    _FILES
    + """, q AS (SELECT * FROM (SELECT 0 AS turn, source_uri AS key, 'What behavior changed in ' || source_uri || ' and is it covered by tests?' AS question FROM files ORDER BY source_uri LIMIT 4)
        UNION ALL SELECT 1, qualified_name, 'Does the change alter assumptions relied on by ' || qualified_name || '?' FROM nodes WHERE kind = 'package' UNION ALL SELECT 2, '', 'Are any unresolved calls or large functions involved in this change?')
    SELECT row_number() OVER (ORDER BY turn, key) AS place, question FROM q QUALIFY place <= 10""",
)
_add(
    "token_savings",
    lambda g: overview.token_savings(g.nodes, g.nodes.filter("source_uri IS NOT NULL").groupBy("source_uri").agg((F.count(F.lit(1)) * 100).alias("raw_tokens"))),
    """, t AS (SELECT source_uri, count(*) * 100 AS raw, sum(greatest(1, length(qualified_name) // 4) + greatest(1, length(kind) // 4) + greatest(1, CASE WHEN line_end IS NULL THEN 0 ELSE length('1-' || line_end) END // 4)) AS graph FROM nodes WHERE source_uri IS NOT NULL GROUP BY source_uri),
    s AS (SELECT count(*) AS files_measured, sum(raw)::BIGINT AS raw_tokens, sum(graph)::BIGINT AS graph_tokens FROM t)
    SELECT *, round((raw_tokens - least(graph_tokens, raw_tokens)) / raw_tokens::DOUBLE * 100, 1) AS savings_percent, round(raw_tokens / graph_tokens::DOUBLE, 1) AS multiplier FROM s""",
)


def _freshness(g: Graph) -> DataFrame:
    side = lambda keep, name: g.nodes.filter(keep).select(F.col("qualified_name").alias("path"), F.md5(name).alias("hash"))
    return overview.freshness(side("id % 5 <> 0", F.col("name")), side("id % 7 <> 0", F.when(F.col("id") % 11 == 0, F.upper("name")).otherwise(F.col("name"))))


_add(
    "freshness",
    _freshness,
    """, s AS (SELECT count(*) FILTER (WHERE id % 5 = 0 AND id % 7 <> 0) AS added, count(*) FILTER (WHERE id % 5 <> 0 AND id % 7 <> 0 AND id % 11 = 0 AND upper(name) <> name) AS modified, count(*) FILTER (WHERE id % 5 <> 0 AND id % 7 = 0) AS deleted FROM nodes)
    SELECT CASE WHEN added + modified + deleted = 0 THEN 'fresh' ELSE 'dirty' END AS state, * FROM s""",
)
_add(
    "architecture_overview",
    lambda g: overview.architecture_overview(g, by_source(g)),
    _COM + ", l AS (SELECT a.community <> b.community AS x FROM edges JOIN com a ON a.id = src JOIN com b ON b.id = dst) SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT community) FROM com) AS communities, sum(x::INT)::BIGINT AS across, round(avg(x::INT), 6) AS coupling FROM l",
)
_add(
    "graph_json",
    lambda g: overview.graph_json(g, by_source(g), offset=30, limit=200),
    _COM
    + """ SELECT n.id, '{"id":' || n.id || ',"qualified_name":"' || qualified_name || '","name":"' || name || '","kind":"' || kind || '"' || coalesce(',"community":' || community, '') || '}' AS json
    FROM (SELECT * FROM nodes ORDER BY id LIMIT 200 OFFSET 30) n LEFT JOIN com ON com.id = n.id""",
)
_add(
    "graph_json_edges",
    lambda g: overview.graph_json_edges(g, offset=0, limit=400),
    """, page AS (SELECT id FROM nodes ORDER BY id LIMIT 400)
    SELECT e.id, '{"id":' || e.id || ',"source":' || src || ',"target":' || dst || ',"kind":"' || kind || '","confidence":' || CASE WHEN conf_class = 'extracted' THEN '1.0' ELSE '0.0' END || '}' AS json
    FROM edges e WHERE src IN (SELECT id FROM page) AND dst IN (SELECT id FROM page)""",
)
_add(
    "report_lines",
    lambda g: overview.report_lines(g).withColumn("place", F.col("place").cast("long")),
    _DEG
    + """, l AS (SELECT 0 AS t, 0 AS o, '' AS k, '# Graph report' AS line UNION ALL SELECT 1, 0, '', '## Nodes' UNION ALL SELECT 3, 0, '', '## Edges' UNION ALL SELECT 5, 0, '', '## Hubs'
        UNION ALL SELECT 2, -count(*), kind, '- ' || kind || ': ' || count(*) FROM nodes GROUP BY kind UNION ALL SELECT 4, -count(*), kind, '- ' || kind || ': ' || count(*) FROM edges GROUP BY kind
        UNION ALL SELECT 6, -degree, id::VARCHAR, '- ' || qualified_name || ': ' || degree FROM (SELECT deg.id, degree, qualified_name FROM deg JOIN nodes USING (id) ORDER BY degree DESC, deg.id LIMIT 25))
    SELECT row_number() OVER (ORDER BY t, o, k) AS place, line FROM l""",
)


def _review(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    texts = docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return overview.review_context(texts, docs.filter("source = 'web'").select(F.col("doc_id").cast("string").alias("path")), texts.select("path"), max_lines=20)


_Q["review_context"] = _review
_SQL["review_context"] = """WITH RECURSIVE f AS (SELECT row_number() OVER (ORDER BY (source IS DISTINCT FROM 'web')::INT, doc_id::VARCHAR) AS k, doc_id::VARCHAR AS path, greatest(1, length(array_to_string(string_split(text, chr(10))[1:20], chr(10))) // 4) AS tokens FROM documents WHERE text IS NOT NULL),
    r AS (SELECT 0::BIGINT AS k, NULL::VARCHAR AS path, 0::BIGINT AS tokens, 0::BIGINT AS used, 0 AS taken, false AS hit
        UNION ALL SELECT f.k, f.path, f.tokens, used + CASE WHEN ok THEN f.tokens ELSE 0 END, taken + ok::INT, ok FROM (SELECT f.*, r.used, r.taken, (r.used < 1600 AND (r.used + f.tokens <= 1600 OR r.taken = 0)) AS ok FROM r JOIN f ON f.k = r.k + 1) f)
    SELECT path, tokens FROM r WHERE hit"""



def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
