"""Search: trigram candidates, IDF, tiered scores, vectors, fusion, token budgets. BM25 is in ``sources.text_index``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.lists import place_within


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """token, id, tf."""
    return docs.select(F.col(id_col).alias("id"), F.explode(T.search_tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("token")).groupBy("token", "id").agg(F.count(F.lit(1)).alias("tf"))


def update_postings(posted: DataFrame, new: DataFrame, replaced: DataFrame) -> DataFrame:
    """Postings without those of the ``replaced`` ids, and with ``new`` ones."""
    return posted.join(replaced.select("id"), "id", "left_anti").select("token", "id", "tf").unionByName(new.select("token", "id", "tf"))


def trigram_postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(T.grams(F.lower(text_col)))).alias("gram"))


def trigram_candidates(docs: DataFrame, id_col: str, text_col: str, needles: list[str]) -> DataFrame:
    """Ids that hold every trigram of some needle; one scan of the postings for all needles."""
    wanted = [(n, g) for n in needles for g in {n[i : i + 3] for i in range(max(1, len(n) - 2))}]
    small = docs.sparkSession.createDataFrame(wanted, "needle string, gram string")
    size = small.groupBy("needle").agg(F.count(F.lit(1)).alias("size"))
    hit = trigram_postings(docs, id_col, text_col).join(F.broadcast(small), "gram").groupBy("needle", "id").agg(F.count(F.lit(1)).alias("n"))
    return hit.join(F.broadcast(size), "needle").filter("n = size").select("id").distinct()


def idf(docs: DataFrame, text_col: str, terms: list[str]) -> DataFrame:
    """term, df (substring), idf = ln(1 + N / max(df, 1)); all terms in one pass."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    sums = docs.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.contains(low, F.lit(t)).cast("long")).alias(f"t{i}") for i, t in enumerate(terms)))
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.coalesce(f"t{i}", F.lit(0)).alias("df")) for i, t in enumerate(terms)))).alias("x")
    return sums.select("n", rows).select("x.term", "x.df", F.round(F.log(1 + F.col("n") / F.greatest("x.df", F.lit(1))), 6).alias("idf"))


def tiered(docs: DataFrame, id_col: str, name: Column, query: str, *, limit: int = 20) -> DataFrame:
    """Exact 1000, prefix 100, substring 1, each times the term's IDF; coverage squared."""
    terms = T.query_terms(query)
    low = F.lower(name)
    n = docs.count()
    d = docs.select(F.col(id_col).alias("id"), low.alias("low"))
    counts = d.agg(*(F.sum(F.contains("low", F.lit(t)).cast("long")) for t in terms)).first()
    import math

    score, hits = F.lit(0.0), F.lit(0)
    for t, df in zip(terms, counts):
        w = math.log(1 + n / max(df or 0, 1))
        tier = F.when(F.col("low") == t, 1000.0).when(F.startswith("low", F.lit(t)), 100.0).when(F.contains("low", F.lit(t)), 1.0).otherwise(0.0)
        score, hits = score + tier * w, hits + (tier > 0).cast("int")
    share = hits / F.lit(float(max(1, len(terms))))
    return d.select("id", F.round(score * share * share, 6).alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def token_overlap(docs: DataFrame, id_col: str, text: Column, query: str, *, least: float = 0.2, limit: int = 20) -> DataFrame:
    q = F.array(*(F.lit(t) for t in T.query_terms(query)))
    return docs.select(F.col(id_col).alias("id"), F.round(T.jaccard(F.array_distinct(T.search_tokens(text)), q), 6).alias("score")).filter(F.col("score") > least).orderBy(F.desc("score"), "id").limit(limit)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or zero norm."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)


def vector_topk(vectors: DataFrame, query: list[float], *, id_col: str = "vec_id", vector_col: str = "embedding", least: float | None = None, limit: int | None = 20) -> DataFrame:
    """id, score, best first; with no ``limit``, every vector at or above ``least``."""
    q = F.array(*(F.lit(float(x)) for x in query))
    d = vectors.select(F.col(id_col).alias("id"), F.round(cosine(F.col(vector_col), q), 6).alias("score"))
    d = d if least is None else d.filter(F.col("score") >= least)
    d = d.orderBy(F.desc("score"), "id")
    return d if limit is None else d.limit(limit)


def rrf(lists: list[tuple[DataFrame, float]], *, k: int = 61) -> DataFrame:
    """id, score: reciprocal ranks (rank from 0 over k) of several ranked lists (id, rank), weighted and summed."""
    all_ranks = None
    for d, w in lists:
        part = d.select("id", (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("part"))
        all_ranks = part if all_ranks is None else all_ranks.unionByName(part)
    return all_ranks.groupBy("id").agg(F.round(F.sum("part"), 6).alias("score"))


def source_saturation(hits: DataFrame, *, factor: float = 0.72) -> DataFrame:
    """The k-th further hit of a source, in given order, keeps factor ** k of its score."""
    placed = place_within(hits, "source", F.col("place").asc(), name="nth")
    return placed.withColumn("score", F.round(F.col("score") * F.pow(F.lit(factor), F.col("nth")), 6)).drop("nth")


def multi_hit_boost(hits: DataFrame, *, share: float = 0.12) -> DataFrame:
    """The best hit of each source with two or more gains share * best score * the source's part of all scores."""
    best = F.max(F.struct("score", (-F.col("id")).alias("id"))).alias("best")
    by = hits.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("sum"), best)
    most, every = hits.agg(F.max("score"), F.sum("score")).first()
    gain = share * F.lit(float(most or 0.0)) * F.col("sum") / F.lit(float(every or 1.0))
    first = by.filter("n > 1").select("of", (-F.col("best.id")).alias("first"), gain.alias("gain"))
    d = hits.join(first, F.col("source").eqNullSafe(F.col("of")) & (F.col("id") == F.col("first")), "left")
    return d.select("id", "source", F.round(F.col("score") + F.coalesce("gain", F.lit(0.0)), 6).alias("score"))


def noise_penalty(path: Column) -> Column:
    """Multiplier by path: tests .72, declaration files .70, samples .82, legacy .78; the least that applies."""
    rules = [(r"(^|/)tests?/|_test\.|test_", 0.72), (r"\.d\.ts$", 0.70), (r"(^|/)(examples?|samples?|demo)/", 0.82), (r"(^|/)(legacy|deprecated|old)/", 0.78)]
    return F.least(F.lit(1.0), *(F.when(path.rlike(p), v).otherwise(1.0) for p, v in rules))


def budget_prefix(items: DataFrame, *, budget: int, text_col: str = "text", order: list[str]) -> DataFrame:
    """Items in order while the running token count stays within the budget."""
    running = F.sum("tokens").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("tokens", T.token_count(F.col(text_col))).orderBy(*order).limit(budget + 1).withColumn("running", running).filter(F.col("running") <= budget)


def page(df: DataFrame, order: list[str], *, offset: int = 0, limit: int = 50, hard: int = 500) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(min(limit, hard))
