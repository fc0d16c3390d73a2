"""Registered queries over the stored text index, each with its SQL over the whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import read_table, scratch_path
from tessera.sources.text_index import TextIndex, phrase, prefixes, words

_built: dict[tuple[str, str, str], TextIndex] = {}


def index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The index of all documents of a folder; built once a session, in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, "plain")
    if key not in _built:
        fresh = TextIndex(spark, scratch_path(spark, "text-index"))
        fresh.add(read_table(spark, sf_dir, "documents"))
        _built[key] = fresh
    return _built[key]


def _news(docs: DataFrame) -> DataFrame:
    return docs.filter("lang = 'de'").select("doc_id", F.concat(F.col("text"), F.lit(" Idiot stupid idiotic")).alias("text"))


def changed_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The same after documents of one source went, those of one language were replaced and as many segments came as make a merge."""
    key = (spark.sparkContext.applicationId, sf_dir, "changed")
    if key not in _built:
        docs = read_table(spark, sf_dir, "documents")
        fresh = TextIndex(spark, scratch_path(spark, "text-index"))
        for lang in ("en", "fr", "es"):
            fresh.add(docs.filter(F.col("lang") == lang))
        fresh.add(docs.filter("lang NOT IN ('en', 'fr', 'es') OR lang IS NULL"))
        fresh.remove(docs.filter("source = 'src1'"))
        fresh.replace(_news(docs))
        _built[key] = fresh
    return _built[key]


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = {"the": words("thing there"), "stup": prefixes("stup"), "of the": phrase("of the"), "la idi": prefixes("pa idi"), "none": words("zzzz")}
    at = index(spark, sf_dir)
    return spark.createDataFrame([(name, at.count(terms)) for name, terms in asked.items()], "query string, n long")


_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '([\p{L}\p{N}]+)', 1)"
_CHANGED = "(SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' Idiot stupid idiotic' ELSE text END AS text FROM documents WHERE source IS DISTINCT FROM 'src1' OR lang = 'de')"


def _bm25(table: str, *tests: str, page: str) -> str:
    """BM25 where each test is true of the tokens ``x`` that a term counts."""
    k = range(len(tests))
    hits = ", ".join(f"len(list_filter(w, lambda x: {t}))::DOUBLE AS f{i}" for i, t in enumerate(tests))
    score = " + ".join(f"ln(1 + (c - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / m))" for i in k)
    return f"""WITH t AS (SELECT doc_id AS id, {_TOKENS} AS w FROM {table}), f AS (SELECT id, len(w) AS n, {hits} FROM t),
    s AS (SELECT count(*) AS c, avg(n) AS m, {", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in k)} FROM f)
    SELECT id, round({score}, 6) AS score FROM f, s WHERE {" AND ".join(f"f{i} > 0" for i in k)} ORDER BY score DESC, id {page}"""


_PHRASE = rf"""WITH t AS (SELECT doc_id AS id, {_TOKENS} AS w FROM documents), f AS (SELECT id, len(w) AS n, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the'))::DOUBLE AS f FROM t),
    s AS (SELECT count(*) AS c, avg(n) AS m, count(*) FILTER (WHERE f > 0) AS d FROM f)
    SELECT id, round(ln(1 + (c - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / m)), 6) AS score FROM f, s WHERE f > 0"""
_SNIPPET = rf"""WITH t AS (SELECT doc_id AS id, regexp_extract_all(coalesce(text, ''), '([\p{{L}}\p{{N}}]+)', 1) AS o, {_TOKENS} AS w FROM documents),
    f AS (SELECT id, o, list_position(list_transform(w, lambda x: starts_with(x, 'stup')), true) - 1 AS first, len(list_filter(w, lambda x: starts_with(x, 'stup'))) AS f FROM t)
    SELECT id, CASE WHEN first > 2 THEN '...' ELSE '' END || array_to_string(list_transform(o[greatest(first - 2, 0) + 1 : greatest(first - 2, 0) + 8], lambda x: CASE WHEN starts_with(lower(x), 'stup') THEN '[' || x || ']' ELSE x END), ' ')
        || CASE WHEN greatest(first - 2, 0) + 8 < len(o) THEN '...' ELSE '' END AS snippet FROM f WHERE f > 0"""
_COUNTS = rf"""WITH t AS (SELECT {_TOKENS} AS w FROM documents)
    SELECT query, n FROM (SELECT 'the' AS query, count(*) FILTER (list_contains(w, 'thing') AND list_contains(w, 'there')) AS n FROM t
    UNION ALL SELECT 'stup', count(*) FILTER (len(list_filter(w, lambda x: starts_with(x, 'stup'))) > 0) FROM t
    UNION ALL SELECT 'of the', count(*) FILTER (len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0) FROM t
    UNION ALL SELECT 'la idi', count(*) FILTER (len(list_filter(w, lambda x: starts_with(x, 'pa'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'idi'))) > 0) FROM t
    UNION ALL SELECT 'none', 0)"""

_Q = {
    "bm25_search": lambda s, d: index(s, d).search(prefixes("stupid idiot"), limit=30),
    "fts_words": lambda s, d: index(s, d).search(words("le les une"), limit=25),
    "fts_page": lambda s, d: index(s, d).search(prefixes("en er"), limit=10, offset=20),
    "fts_phrase": lambda s, d: index(s, d).search(phrase("of the"), limit=None),
    "fts_snippets": lambda s, d: index(s, d).search(prefixes("stup"), limit=None, snippets=True).select("id", "snippet"),
    "fts_counts": _counts,
    "fts_after_changes": lambda s, d: changed_index(s, d).search(prefixes("stupid idiot"), limit=50),
    "fts_words_after_changes": lambda s, d: changed_index(s, d).search(words("stupid"), limit=None),
}
_starts = lambda t: f"starts_with(x, '{t}')"
_SQL = {
    "bm25_search": _bm25("documents", _starts("stupid"), _starts("idiot"), page="LIMIT 30"),
    "fts_words": _bm25("documents", "x = 'le'", "x = 'les'", "x = 'une'", page="LIMIT 25"),
    "fts_page": _bm25("documents", _starts("en"), _starts("er"), page="LIMIT 10 OFFSET 20"),
    "fts_phrase": _PHRASE,
    "fts_snippets": _SNIPPET,
    "fts_counts": _COUNTS,
    "fts_after_changes": _bm25(_CHANGED, _starts("stupid"), _starts("idiot"), page="LIMIT 50"),
    "fts_words_after_changes": _bm25(_CHANGED, "x = 'stupid'", page=""),
}


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
