"""Registered queries over text columns of the tables, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import changes, dedup, embeddings, motifs, search
from tessera.runtime import materialise, read_table
from tessera.sources import html as html_source
from tessera.sources.adapters import COMMERCE_SQL, commerce_graph, event_graph

_Q: dict = {}
_SQL: dict[str, str] = {}


def _add(name, run, sql=None):
    _Q[name] = run
    if sql is not None:
        _SQL[name] = sql


def _t(name):
    return lambda spark, d: read_table(spark, d, name)


part, docs, customer, supplier = _t("part"), _t("documents"), _t("customer"), _t("supplier")
R = F.round

_add("normalize_identifier", lambda s, d: customer(s, d).select(F.col("c_custkey").alias("id"), T.normalize_identifier(F.concat("c_name", F.lit("HTTPServer2x"))).alias("norm")), r"SELECT c_custkey AS id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c_name || 'HTTPServer2x', '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))) AS norm FROM customer")
_add("search_tokens", lambda s, d: part(s, d).select(F.col("p_partkey").alias("id"), F.explode(T.search_tokens(F.col("p_name"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")), r"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(p_name), '([\p{L}\p{N}]+)', 1)) AS token FROM part) GROUP BY token")
_add("document_tokens", lambda s, d: search.postings(docs(s, d), "doc_id", "text").groupBy("id").agg(F.count(F.lit(1)).alias("distinct_tokens"), F.sum("tf").alias("tokens")), r"SELECT id, count(DISTINCT token) AS distinct_tokens, count(*) AS tokens FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}]+)', 1)) AS token FROM documents) GROUP BY id")
_add("trigram_postings", lambda s, d: search.trigram_postings(part(s, d), "p_partkey", "p_name").groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "SELECT gram, count(*) AS n FROM (SELECT DISTINCT p_partkey, substr(lower(p_name), i::INT, 3) AS gram FROM part, range(1, 200) t(i) WHERE i <= greatest(1, length(p_name) - 2)) GROUP BY gram")
_add("trigram_candidates", lambda s, d: search.trigram_candidates(part(s, d), "p_partkey", "p_name", ["part", "green"]), "SELECT p_partkey AS id FROM part WHERE (contains(lower(p_name), 'par') AND contains(lower(p_name), 'art')) OR (contains(lower(p_name), 'gre') AND contains(lower(p_name), 'ree') AND contains(lower(p_name), 'een'))")
_add("idf_terms", lambda s, d: search.idf(docs(s, d), "text", ["license", "the", "idiot", "zzz"]), "SELECT term, df, round(ln(1 + n / greatest(df, 1)::DOUBLE), 6) AS idf FROM (SELECT term, (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM documents WHERE contains(lower(text), term)) AS df FROM (VALUES ('license'), ('the'), ('idiot'), ('zzz')) v(term))")
_add(
    "tiered_search",
    lambda s, d: search.tiered(part(s, d), "p_partkey", F.col("p_name"), "find part 7", limit=50),
    """WITH t AS (SELECT term, ln(1 + (SELECT count(*) FROM part) / greatest((SELECT count(*) FROM part WHERE contains(lower(p_name), term)), 1)::DOUBLE) AS w FROM (VALUES ('part')) v(term)),
    s AS (SELECT p_partkey AS id, sum(CASE WHEN lower(p_name) = term THEN 1000.0 WHEN starts_with(lower(p_name), term) THEN 100.0 WHEN contains(lower(p_name), term) THEN 1.0 ELSE 0.0 END * w) AS score FROM part, t GROUP BY p_partkey)
    SELECT id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 50""",
)
_add("token_overlap_search", lambda s, d: search.token_overlap(docs(s, d), "doc_id", F.col("text"), "idiot stupid moron clown the of and", least=0.0, limit=50), r"WITH q AS (SELECT ['idiot', 'stupid', 'moron', 'clown'] AS q), t AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '([\p{L}\p{N}]+)', 1)) AS w FROM documents) SELECT id, round(len(list_intersect(w, q)) / (len(w) + len(q) - len(list_intersect(w, q)))::DOUBLE, 6) AS score FROM t, q WHERE round(len(list_intersect(w, q)) / (len(w) + len(q) - len(list_intersect(w, q)))::DOUBLE, 6) > 0 ORDER BY score DESC, id LIMIT 50")
_PAIR = "SELECT p_partkey AS id, p_name AS a, lead(p_name) OVER (ORDER BY p_partkey) AS b FROM part"


def _pairs(s, d):
    p = part(s, d)
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a")).join(p.select((F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("b")), "id")


_ratio = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 1.0::DOUBLE ELSE 1.0 - levenshtein({0}, {1}) / greatest(length({0}), length({1}))::DOUBLE END"
_add("fuzzy_ratio", lambda s, d: _pairs(s, d).select("id", R(T.ratio(F.col("a"), F.col("b")), 6).alias("ratio")), f"WITH p AS ({_PAIR}) SELECT id, round({_ratio.format('a', 'b')}, 6) AS ratio FROM p WHERE b IS NOT NULL")
_add("fuzzy_partial_ratio", lambda s, d: _pairs(s, d).select("id", R(T.partial_ratio(F.col("a"), F.col("b")), 6).alias("ratio")), f"WITH p AS ({_PAIR}), q AS (SELECT id, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS x, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS y FROM p WHERE b IS NOT NULL) SELECT id, max(round({_ratio.format('x', 'substr(y, i::INT, length(x))')}, 6)) AS ratio FROM q, range(1, 100) t(i) WHERE i <= length(y) - length(x) + 1 GROUP BY id")
_add("fuzzy_token_sort", lambda s, d: _pairs(s, d).select("id", R(T.token_sort_ratio(F.col("a"), F.col("b")), 6).alias("ratio")), f"WITH p AS ({_PAIR}), q AS (SELECT id, array_to_string(list_sort(string_split(a, ' ')), ' ') AS x, array_to_string(list_sort(string_split(b, ' ')), ' ') AS y FROM p WHERE b IS NOT NULL) SELECT id, round({_ratio.format('x', 'y')}, 6) AS ratio FROM q")
_add("fuzzy_token_set", lambda s, d: _pairs(s, d).select("id", R(T.token_set_ratio(F.col("a"), F.col("b")), 6).alias("ratio")), f"WITH p AS ({_PAIR}) SELECT id, round(len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' ')))) / greatest(len(list_distinct(string_split(a, ' '))), len(list_distinct(string_split(b, ' '))))::DOUBLE, 6) AS ratio FROM p WHERE b IS NOT NULL")
_add("acronyms", lambda s, d: part(s, d).select(F.col("p_partkey").alias("id"), T.acronym(F.col("p_name")).alias("acronym")), "SELECT p_partkey AS id, array_to_string(list_transform(string_split(trim(p_name), ' '), lambda x: substr(x, 1, 1)), '') AS acronym FROM part")
_add("label_normalize", lambda s, d: supplier(s, d).select(F.col("s_suppkey").alias("id"), T.normalize_label(F.concat("s_name", F.lit(" v1.2"))).alias("label")), r"SELECT s_suppkey AS id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(s_name || ' v1.2')), '[\s_.\-/]+', '_', 'g'), '_?v?[0-9]+(_[0-9]+)*$', ''), '_+', '_', 'g'), '^_|_$', '', 'g') AS label FROM supplier")
_add("label_entropy", lambda s, d: part(s, d).select(F.col("p_partkey").alias("id"), R(T.entropy(F.col("p_name")), 6).alias("entropy"), T.passes_entropy(F.col("p_name")).alias("passes")), "WITH c AS (SELECT p_partkey AS id, substr(p_name, i::INT, 1) AS ch, length(p_name) AS n, count(*) AS k FROM part, range(1, 200) t(i) WHERE i <= length(p_name) GROUP BY ALL) SELECT id, round(-sum(k / n::DOUBLE * log2(k / n::DOUBLE)), 6) AS entropy, CASE WHEN max(n) < 3 THEN true WHEN max(n) <= 5 AND count(*) <= 3 THEN false ELSE -sum(k / n::DOUBLE * log2(k / n::DOUBLE)) >= 0.5 END AS passes FROM c GROUP BY id")
_add("token_counts", lambda s, d: docs(s, d).select("doc_id", T.token_count(F.col("text")).alias("tokens")), "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
_add("intent_classify", lambda s, d: _t("conversations")(s, d).select("conv_id", "turn", T.intent(F.col("text")).alias("intent")).groupBy("intent").agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN regexp_matches(lower(text), 'error|bug|fail|crash|exception') THEN 'debug' WHEN regexp_matches(lower(text), 'test|coverage|assert') THEN 'test' WHEN regexp_matches(lower(text), 'refactor|rename|cleanup|extract') THEN 'refactor' WHEN regexp_matches(lower(text), 'review|change|diff|impact') THEN 'review' WHEN regexp_matches(lower(text), 'architecture|module|design|structure') THEN 'architecture' ELSE 'implementation' END AS intent, count(*) AS n FROM conversations GROUP BY 1")
_add("token_budget_prefix", lambda s, d: search.budget_prefix(docs(s, d).select("doc_id", "text"), budget=5000, order=["doc_id"]).select("doc_id", "running"), "SELECT doc_id, running FROM (SELECT doc_id, sum(greatest(1, length(text) // 4)) OVER (ORDER BY doc_id)::BIGINT AS running FROM documents) WHERE running <= 5000")
_add("pagination", lambda s, d: search.page(part(s, d).select("p_partkey", "p_name"), ["p_partkey"], offset=20, limit=10), "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 10 OFFSET 20")


def _ranked(s, d):
    def first(rows, *order):
        # The limit is taken in each task before the ranks are numbered.
        top = rows.select(F.col("doc_id").alias("id"), "n_chars").orderBy(*order).limit(40)
        return top.select("id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"))

    return search.rrf([(first(docs(s, d).filter("n_chars > 3000"), F.desc("n_chars"), "id"), 3600.0), (first(docs(s, d).filter("lang = 'en'"), "id"), 2700.0)])


_add("rrf_fusion", _ranked, "WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents WHERE n_chars > 3000 QUALIFY rank < 40), b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM documents WHERE lang = 'en' QUALIFY rank < 40) SELECT id, round(sum(p), 6) AS score FROM (SELECT id, 3600.0::DOUBLE / (61 + rank) AS p FROM a UNION ALL SELECT id, 2700.0::DOUBLE / (61 + rank) FROM b) GROUP BY id")
_hits = lambda s, d: docs(s, d).select(F.col("doc_id").alias("id"), "source", F.col("n_chars").cast("double").alias("score"), F.col("doc_id").alias("place"))
_add("source_saturation", lambda s, d: search.source_saturation(_hits(s, d)).select("id", "source", "score"), "SELECT doc_id AS id, source, round(n_chars::DOUBLE * pow(0.72::DOUBLE, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1), 6) AS score FROM documents")
_add("multi_hit_boost", lambda s, d: search.multi_hit_boost(_hits(s, d)), "WITH h AS (SELECT doc_id AS id, source, n_chars::DOUBLE AS score, count(*) OVER (PARTITION BY source) AS n, sum(n_chars::DOUBLE) OVER (PARTITION BY source) AS sm, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS nth FROM documents) SELECT id, source, round(score + CASE WHEN n > 1 AND nth = 1 THEN 0.12::DOUBLE * (SELECT max(score) FROM h) * sm / (SELECT sum(score) FROM h) ELSE 0.0 END, 6) AS score FROM h")
_add("noise_penalty", lambda s, d: _t("pages")(s, d).select("page_id", search.noise_penalty(F.col("url")).alias("factor")), r"SELECT page_id, least(1.0, CASE WHEN regexp_matches(url, '(^|/)tests?/|_test\.|test_') THEN 0.72 ELSE 1.0 END, CASE WHEN regexp_matches(url, '\.d\.ts$') THEN 0.70 ELSE 1.0 END, CASE WHEN regexp_matches(url, '(^|/)(examples?|samples?|demo)/') THEN 0.82 ELSE 1.0 END, CASE WHEN regexp_matches(url, '(^|/)(legacy|deprecated|old)/') THEN 0.78 ELSE 1.0 END)::DOUBLE AS factor FROM pages")
_vec = [(-1.0 if i % 3 else 1.0) for i in range(64)]
_VQ = "[" + ", ".join(f"{x}" for x in _vec) + "]::DOUBLE[]"
_add("vector_topk", lambda s, d: search.vector_topk(_t("embeddings")(s, d), _vec, limit=20), f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {_VQ}), 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 20")
_add("vector_threshold", lambda s, d: search.vector_topk(_t("embeddings")(s, d), _vec, least=0.20, limit=None), f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {_VQ}), 6) AS score FROM embeddings WHERE round(list_cosine_similarity(embedding::DOUBLE[], {_VQ}), 6) >= 0.20")
_add("embedding_stats", lambda s, d: _t("embeddings")(s, d).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("labels"), F.max(F.size("embedding")).cast("long").alias("dimensions")), "SELECT count(*) AS n, count(DISTINCT label) AS labels, max(len(embedding)) AS dimensions FROM embeddings")
_add("html_headings", lambda s, d: html_source.heading_counts(_t("pages")(s, d)), r"SELECT page_id, level::INT AS level, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<h([1-6])[\s>]', 1)) AS level FROM pages) GROUP BY ALL")
_add("html_sections", lambda s, d: html_source.sections(_t("pages")(s, d)))
_add("html_links", lambda s, d: html_source.links(_t("pages")(s, d)), """SELECT page_id, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a[^>]*href="([^"]*)"', 1)) AS target FROM pages) GROUP BY ALL""")
_add("json_props", lambda s, d: _t("events")(s, d).select("event_id", F.size(F.json_object_keys("props")).cast("long").alias("n")), "SELECT event_id, len(json_keys(props))::BIGINT AS n FROM events")
_add(
    "text_lines",
    lambda s, d: changes.snippet(docs(s, d).select("doc_id", "text"), "text", max_lines=None).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("content").cast("long")).alias("chars")),
    "SELECT doc_id, count(*) AS lines, sum(length(l))::BIGINT AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id",
)
_add(
    "file_snippet",
    lambda s, d: changes.snippet(_t("pages")(s, d).select("page_id", "html"), "html", max_lines=5).select("page_id", F.col("line").cast("long").alias("line"), F.md5("content").alias("content_md5")),
    "SELECT page_id, line, md5(content) AS content_md5 FROM (SELECT page_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS content FROM (SELECT page_id, string_split(html, chr(10))[1:5] AS l FROM pages))",
)
_add("event_graph", lambda s, d: event_graph(s, d).edges, "SELECT event_type AS src, nxt AS dst, 'data_flow' AS kind, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL GROUP BY ALL")
_add("minhash_pairs", lambda s, d: dedup.candidate_pairs(dedup.signatures(part(s, d), "p_partkey", "p_name")))
_add("jaro_winkler_dedup", lambda s, d: dedup.deduplicate(supplier(s, d).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))))
#: The reference's rule, character by character: each character of a takes the first free equal one of b within
#: reach; half the differing positions are transpositions; the prefix counts at any score.
_WINKLER = f"""WITH RECURSIVE p AS (
    SELECT id, a, b, length(a) AS la, length(b) AS lb, greatest(0, greatest(length(a), length(b)) // 2 - 1) AS reach FROM ({_PAIR}) WHERE b IS NOT NULL
), m AS (
    SELECT *, 0 AS i, []::BIGINT[] AS xs, []::BIGINT[] AS ys FROM p
    UNION ALL
    SELECT id, a, b, la, lb, reach, i + 1, CASE WHEN j IS NULL THEN xs ELSE list_append(xs, i + 1) END, CASE WHEN j IS NULL THEN ys ELSE list_append(ys, j) END
    FROM (SELECT *, list_filter(range(greatest(1, i + 1 - reach), least(lb, i + 1 + reach) + 1), lambda k: substr(b, k, 1) = substr(a, i + 1, 1) AND NOT list_contains(ys, k))[1] AS j FROM m WHERE i < la)
), f AS (
    SELECT *, len(xs)::DOUBLE AS n, len(list_filter(list_zip(xs, list_sort(ys)), lambda z: substr(a, z[1], 1) <> substr(b, z[2], 1))) / 2.0::DOUBLE AS swaps,
           coalesce(list_min(list_filter(range(1, 5), lambda k: k > least(la, lb) OR substr(a, k, 1) <> substr(b, k, 1))), 5) - 1 AS same
    FROM m WHERE i = la
), j AS (SELECT id, a, b, same, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE (n / la + n / lb + (n - swaps) / n) / 3 END AS jaro FROM f)
SELECT id, score FROM (SELECT id, round(CASE WHEN a = b THEN 1.0::DOUBLE ELSE jaro + same * 0.1::DOUBLE * (1 - jaro) END, 6) AS score FROM j) WHERE score > 0.8"""
_add(
    "jaro_winkler",
    lambda s, d: _pairs(s, d).select("id", R(dedup.jaro_winkler(F.col("a"), F.col("b")), 6).alias("score")).filter("score > 0.8"),
    _WINKLER,
)
_EMBED = """WITH t AS (
        SELECT p_partkey AS id, regexp_extract_all(lower(p_name), '([\\p{L}\\p{N}]+)', 1) AS w, regexp_extract_all(lower(NORM), '([a-z0-9]+)', 1) AS p FROM part
    ), f AS (
        SELECT id, 'tok:' || unnest(w) AS feature, 1.25::DOUBLE AS weight FROM t
        UNION ALL SELECT id, 'stem:' || regexp_replace(x, '(ing|ers|ies|ed|es|er|s)$', ''), 0.7 FROM (SELECT id, unnest(w) AS x FROM t) WHERE length(x) > 4
        UNION ALL SELECT id, 'piece:' || unnest(p), 0.4 FROM t
        UNION ALL SELECT id, 'char:' || substr(x, i, 3), 0.25 FROM (SELECT id, x, unnest(range(1, length(x) - 1)) AS i FROM (SELECT id, unnest(w) AS x FROM t) WHERE length(x) >= 3)
        UNION ALL SELECT id, 'bi:' || w[i] || ':' || w[i + 1], 0.8 FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM t)
        UNION ALL SELECT id, 'skip:' || w[i] || ':' || w[i + 2], 0.5 FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM t)
        UNION ALL SELECT id, 'acr:' || array_to_string(list_transform(w, lambda x: x[1]), ''), 0.6 FROM t WHERE len(w) >= 2
        GROUPS
    ), h AS (SELECT id, md5(feature) AS d, weight FROM f),
    v AS (SELECT id, (('0x' || substr(d, 1, 8))::BIGINT % 384)::INT AS dimension, round(sum(CASE WHEN ('0x' || substr(d, 9, 1))::BIGINT % 2 = 0 THEN weight ELSE -weight END), 6) AS v FROM h GROUP BY ALL)
    SELECT id, dimension, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS value FROM v WHERE v <> 0"""
_NORM = "p_name"
for _a, _b in ((r"([a-z0-9])([A-Z])", r"\1 \2"), (r"([A-Z]+)([A-Z][a-z])", r"\1 \2"), (r"([A-Za-z])([0-9])", r"\1 \2"), (r"([0-9])([A-Za-z])", r"\1 \2"), (r"[^A-Za-z0-9]+", " ")):
    _NORM = f"regexp_replace({_NORM}, '{_a}', '{_b}', 'g')"
_GROUPED = " ".join(f"UNION ALL SELECT id, 'group:{name}', 1.2 FROM t WHERE list_has_any(w, {words})" for name, words in embeddings.GROUPS.items())
_add("hash_embedding", lambda s, d: embeddings.hashed(part(s, d), "p_partkey", F.col("p_name")).select("id", "dimension", R("value", 6).alias("value")), _EMBED.replace("NORM", _NORM).replace("GROUPS", _GROUPED))


def _near_names(s, d):
    vectors = materialise(embeddings.embed(part(s, d), "p_partkey", F.col("p_name")), "name-vectors")
    return embeddings.nearest(embeddings.build_index(vectors), vectors.filter("id % 50 = 0"), k=10)


_add("embedding_neighbors", _near_names)
_add(
    "motif_match",
    lambda s, d: motifs.untested_callee().match(commerce_graph(s, d)),
    f"WITH {COMMERCE_SQL} SELECT DISTINCT b.src AS caller, b.dst AS callee, a.src AS owner FROM edges a JOIN edges b ON a.dst = b.src WHERE a.kind = 'defines' AND b.kind = 'calls'",
)
_add("motif_chain", lambda s, d: motifs.chain("depends_on", 1).match(commerce_graph(s, d), limit=50), f"WITH {COMMERCE_SQL} SELECT DISTINCT src AS v0, dst AS v1 FROM edges WHERE kind = 'depends_on' ORDER BY v0, v1 LIMIT 50")
_add("name_patterns", lambda s, d: supplier(s, d).select(F.col("s_suppkey").alias("id"), motifs.NamePattern("glob", "Supplier*1").matches(F.col("s_name")).alias("glob"), motifs.NamePattern("contains", "SUPP").matches(F.col("s_name")).alias("has"), motifs.NamePattern("regex", "0+[12]$").matches(F.col("s_name")).alias("regex")), "SELECT s_suppkey AS id, regexp_matches(s_name, '^Supplier[^:]*1$') AS glob, contains(lower(s_name), 'supp') AS has, regexp_matches(s_name, '0+[12]$') AS regex FROM supplier")


def _patterns(s, d):
    rows = [("customer_orders", "^(customer|order)", ["class", "method"], "defines", 2), ("supply", "^supplier", ["class"], "imports", 1), ("order_parts", ".*", ["method", "function"], "calls", 2)]
    return motifs.framework_patterns(commerce_graph(s, d), s.createDataFrame(rows, "pattern string, name_regex string, kinds array<string>, edge_kind string, min_nodes int"))


_add(
    "framework_patterns",
    _patterns,
    f"""WITH {COMMERCE_SQL}, c AS (SELECT * FROM (VALUES ('customer_orders', '^(customer|order)', ['class', 'method'], 'defines', 2), ('supply', '^supplier', ['class'], 'imports', 1), ('order_parts', '.*', ['method', 'function'], 'calls', 2)) v(pattern, rx, kinds, ek, least_n)),
    h AS (SELECT pattern, id, ek, least_n FROM nodes, c WHERE list_contains(kinds, kind) AND regexp_matches(lower(name), rx)),
    e AS (SELECT a.pattern, count(*) AS edges FROM edges JOIN h a ON a.id = src AND a.ek = kind JOIN h b ON b.id = dst AND b.pattern = a.pattern GROUP BY a.pattern)
    SELECT n.pattern, n, edges, round(least(0.5 + 0.05::DOUBLE * n + 0.03::DOUBLE * edges, 1.0), 6) AS confidence FROM (SELECT pattern, min(least_n) AS m, count(*) AS n FROM h GROUP BY pattern HAVING count(*) >= min(least_n)) n JOIN e ON e.pattern = n.pattern""",
)


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
