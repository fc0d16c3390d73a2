"""Registered queries of node search and context packs, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import retrieval, search
from tessera.runtime import read_table
from tessera.sources.adapters import COMMERCE_SQL, Graph, commerce_graph

_Q: dict = {}
_SQL: dict[str, str] = {}


def _add(name, run, sql=None):
    _Q[name] = run
    if sql is not None:
        _SQL[name] = sql


def _nodes(s, d):
    return commerce_graph(s, d).nodes


_N = f"WITH {COMMERCE_SQL}"
#: Tiered score of one term over node names.
_TIER = """, w AS (SELECT ln(1 + count(*) / greatest(count(*) FILTER (WHERE contains(lower(name), '{0}')), 1)::DOUBLE) AS w FROM nodes),
t AS (SELECT * FROM (SELECT id, name, kind, source_uri, round(CASE WHEN lower(name) = '{0}' THEN 1000.0::DOUBLE WHEN starts_with(lower(name), '{0}') THEN 100.0 WHEN contains(lower(name), '{0}') THEN 1.0 ELSE 0.0 END * w, 6) AS score FROM nodes, w) WHERE score > 0 ORDER BY score DESC, id LIMIT {1})"""

_add("name_search", lambda s, d: retrieval.by_name(_nodes(s, d), "Supplier"), _N + _TIER.format("supplier", 50) + " SELECT id, round(0.5 + least(score / 1000, 0.5), 6) AS score FROM t")
_add("name_search_exact", lambda s, d: retrieval.by_name(_nodes(s, d), "EUROPE", exact=True), _N + _TIER.format("europe", 50) + " SELECT id, 1.0::DOUBLE AS score FROM t WHERE lower(name) = 'europe'")
_TASK = """, s AS (SELECT id, round(score * CASE WHEN source_uri IS NULL THEN 0.35 ELSE 1.0 END * {1}, 6) AS score FROM t) SELECT {0} FROM s WHERE score > 0.3 ORDER BY score DESC, id LIMIT 20"""
_add("task_aware_search", lambda s, d: retrieval.task_aware(_nodes(s, d), "supplier", intent="impact"), _N + _TIER.format("supplier", 20) + _TASK.format("id, score", "CASE WHEN kind IN ('function', 'class') THEN 1.3 ELSE 1.0 END::DOUBLE"))
_add(
    "hybrid_search",
    lambda s, d: retrieval.hybrid(_nodes(s, d), "asia").withColumn("place", F.col("place").cast("long")),
    _N + _TIER.format("asia", 20) + ", s AS (SELECT id, round(score * CASE WHEN source_uri IS NULL THEN 0.35 ELSE 1.0 END, 6) AS score FROM t) SELECT row_number() OVER (ORDER BY score DESC, s.id) AS place, s.id, qualified_name, kind, score FROM s JOIN nodes n ON n.id = s.id WHERE score > 0.3",
)
_add(
    "tool_search",
    lambda s, d: retrieval.tool_search(_nodes(s, d), "nation::1", limit=200),
    _N
    + r""", s AS (SELECT id, CASE WHEN lower(name) = 'nation::1' OR lower(qualified_name) = 'nation::1' THEN 1.0 WHEN starts_with(lower(name), 'nation::1') OR starts_with(lower(qualified_name), 'nation::1') THEN 0.9
        WHEN contains(lower(name), 'nation::1') OR contains(lower(qualified_name), 'nation::1') THEN 0.7 WHEN regexp_matches(lower(name), 'n.*a.*t.*i.*o.*n.*:.*:.*1') OR regexp_matches(lower(qualified_name), 'n.*a.*t.*i.*o.*n.*:.*:.*1') THEN 0.4
        WHEN regexp_matches(lower(name), '\b(nation|1)\b') OR regexp_matches(lower(qualified_name), '\b(nation|1)\b') THEN 0.3 ELSE 0.0 END::DOUBLE AS score FROM nodes)
    SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 200""",
)
_add(
    "kind_boosts",
    lambda s, d: _nodes(s, d).select("id", retrieval.kind_boost("which function is it", F.col("kind")).alias("boost")),
    _N + " SELECT id, CASE kind WHEN 'function' THEN 1.3 WHEN 'method' THEN 1.2 ELSE 1.0 END::DOUBLE AS boost FROM nodes",
)
_add(
    "definition_nodes",
    lambda s, d: _nodes(s, d).filter(retrieval.is_definition(F.col("qualified_name"), F.col("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
    _N + " SELECT kind, count(*) AS n FROM nodes WHERE NOT starts_with(qualified_name, 'call::') AND kind IN ('function', 'method', 'class', 'type', 'trait', 'impl', 'module') GROUP BY kind",
)
_add("source_stems", lambda s, d: read_table(s, d, "pages").select("page_id", retrieval.source_stem(F.col("url")).alias("stem")), r"SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem FROM pages")
_add(
    "strip_diacritics",
    lambda s, d: read_table(s, d, "documents").select("doc_id", F.md5(retrieval.strip_diacritics(F.coalesce("text", F.lit("")))).alias("md5")),
    "SELECT doc_id, md5(strip_accents(coalesce(text, ''))) AS md5 FROM documents",
)
_add(
    "search_text",
    lambda s, d: retrieval.search_text(_nodes(s, d)).select("id", F.md5(F.regexp_replace("text", "\0", "|")).alias("md5")),
    _N
    + r""", f AS (SELECT *, array_to_string(regexp_extract_all(lower(name), '([\p{L}\p{N}]+)', 1), ' ') AS a, array_to_string(regexp_extract_all(lower(coalesce(source_uri, '')), '([\p{L}\p{N}]+)', 1), ' ') AS b, array_to_string(regexp_extract_all(lower(qualified_name), '([\p{L}\p{N}]+)', 1), ' ') AS c FROM nodes)
    SELECT id, md5(concat_ws('|', lower(name), a, id::VARCHAR, lower(coalesce(source_uri, '')), b, lower(qualified_name), c)) AS md5 FROM f""",
)
_R = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 1.0::DOUBLE ELSE 1.0 - levenshtein({0}, {1}) / greatest(length({0}), length({1}))::DOUBLE END"


def _fuzzy_sql(query: str) -> str:
    compact = "".join(c for c in query if c.isalnum())
    q, c, words = f"'{query}'", f"'{compact}'", "', '".join(query.split())
    return f"""WITH p AS (SELECT p_partkey AS id, p_name AS t, regexp_replace(p_name, '[^0-9A-Za-z]', '', 'g') AS ct, list_filter(string_split(p_name, ' '), lambda w: w <> '') AS ws FROM part),
    x AS (SELECT *, array_to_string(list_sort(ws), ' ') AS st, array_to_string(list_transform(ws, lambda w: w[1]), '') AS ac, array_to_string(list_sort(list_intersect(['{words}'], ws)), ' ') AS cm,
                 CASE WHEN length({c}) <= length(ct) THEN {c} ELSE ct END AS sh, CASE WHEN length({c}) <= length(ct) THEN ct ELSE {c} END AS lo FROM p)
    SELECT id, round(greatest({_R.format(q, 't')}, {_R.format(c, 'ct')}, list_max(list_transform(range(1, length(lo) - length(sh) + 2), lambda i: {_R.format('sh', 'substr(lo, i, length(sh))')})),
        {_R.format("'" + " ".join(sorted(query.split())) + "'", 'st')}, CASE WHEN cm = '' THEN 0.0 ELSE greatest({_R.format('cm', q)}, {_R.format('cm', 't')}) END, {_R.format(c, 'ac')},
        CASE WHEN regexp_matches(ct, '{".*".join(compact)}') THEN {len(compact)} / length(ct)::DOUBLE ELSE 0.0 END), 6) AS score FROM x"""


_add("fuzzy_score", lambda s, d: read_table(s, d, "part").select(F.col("p_partkey").alias("id"), retrieval.fuzzy_score("Part green 12", F.col("p_name")).alias("score")), _fuzzy_sql("Part green 12"))
_add("embedding_text", lambda s, d: retrieval.embedding_text(_nodes(s, d)).select("id", F.md5("text").alias("md5")), _N + " SELECT id, md5(concat_ws(chr(10), kind, name, qualified_name, source_uri)) AS md5 FROM nodes")
_add(
    "context_pack",
    lambda s, d: retrieval.context_pack(commerce_graph(s, d), "supplier", seeds=_nodes(s, d).filter("kind = 'class'").select("id", F.lit(1.0).alias("score"))).select("id", "role", F.col("score").cast("long").alias("score"), "tokens"),
    _N
    + """, seeds AS (SELECT id FROM nodes WHERE kind = 'class' ORDER BY id LIMIT 5),
    around AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY role, id) AS nth FROM (SELECT DISTINCT dst AS seed, src AS id, 'caller' AS role FROM edges WHERE dst IN (SELECT id FROM seeds) UNION SELECT DISTINCT src, dst, 'callee' FROM edges WHERE src IN (SELECT id FROM seeds))),
    best AS (SELECT id, min(r) AS r FROM (SELECT id, 0 AS r FROM seeds UNION ALL SELECT id, CASE role WHEN 'callee' THEN 1 ELSE 2 END FROM around WHERE nth <= 20) GROUP BY id),
    c AS (SELECT n.id, ['seed', 'callee', 'caller'][r + 1] AS role, (3 * contains(lower(name), 'supplier')::INT + 2 * contains(lower(qualified_name), 'supplier')::INT + contains(lower('# ' || kind || ': ' || qualified_name), 'supplier')::INT)::BIGINT AS score,
                 greatest(1, length('# ' || kind || ': ' || qualified_name) // 4) AS tokens, coalesce(source_uri, qualified_name) AS file FROM nodes n JOIN best ON best.id = n.id),
    f AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, id) AS k FROM c QUALIFY k <= 2),
    o AS (SELECT *, sum(tokens) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS running, row_number() OVER (ORDER BY score DESC, id) AS place FROM f)
    SELECT id, role, score, tokens FROM o WHERE running <= 2400 AND place <= 20""",
)


def _text_index(s, d):
    """A postings table with one document replaced and one removed, and a snippet of what it then finds."""
    docs = read_table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    posted = search.postings(docs, "id", "text")
    changed = docs.filter("id % 10 = 3").select("id", F.lit("zebra crossing zebra").alias("text"))
    return search.update_postings(posted, search.postings(changed, "id", "text"), docs.filter("id % 10 IN (3, 4)").select("id")).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))


_add(
    "text_index_update",
    _text_index,
    r"""WITH t AS (SELECT conv_id * 1000 + turn AS id, coalesce(text, '') AS text FROM conversations), d AS (SELECT id, CASE WHEN id % 10 = 3 THEN 'zebra crossing zebra' ELSE text END AS text FROM t WHERE id % 10 <> 4),
    p AS (SELECT id, unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}]+)', 1)) AS token FROM d) SELECT token, count(DISTINCT id) AS df, count(*) AS n FROM p GROUP BY token""",
)


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
