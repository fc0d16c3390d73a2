"""Evaluation metrics as DataFrames: ranks, set scores, learned costs, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_reciprocal_rank(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """queries, mrr: hits (query, id, rank from 1) against relevant (query, id); a query without a hit counts 0."""
    first = hits.join(relevant, ["query", "id"], "left_semi").groupBy("query").agg((1 / F.min("rank")).alias("rr"))
    return hits.select("query").distinct().join(first, "query", "left").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.coalesce("rr", F.lit(0.0))), 6).alias("mrr"))


def micro_scores(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """found, wanted, hit and micro precision, recall, F1 over (case, item) sets; one join."""
    both = found.withColumn("f", F.lit(1)).join(wanted.withColumn("w", F.lit(1)), ["case", "item"], "full")
    s = both.agg(F.count("f").alias("found"), F.count("w").alias("wanted"), F.sum((F.col("f").isNotNull() & F.col("w").isNotNull()).cast("long")).alias("hit"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(F.round(a / b, 6))
    return s.select("found", "wanted", "hit", ratio(F.col("hit"), F.col("found")).alias("precision"), ratio(F.col("hit"), F.col("wanted")).alias("recall"), ratio(2 * F.col("hit"), F.col("found") + F.col("wanted")).alias("f1"))


def learned_costs(edges: DataFrame, commits: DataFrame, *, prior: float = 20.0, rate: float = 0.1) -> DataFrame:
    """kind, edges, together, cost of cross-file edges (kind, a, b): 1 - log2 of the shrunk rate of co-change, in .1 .. 10.

    Only pairs of files that an edge joins are looked up among the commits; no pairs within a commit are listed.
    """
    x = edges.filter("a <> b")
    pairs = x.select("a", "b").distinct()
    c = commits.select("commit", "path").distinct()
    together = pairs.join(c.withColumnRenamed("path", "a"), "a").join(c.withColumnRenamed("path", "b"), ["commit", "b"]).select("a", "b").distinct().withColumn("t", F.lit(1))
    s = x.join(together, ["a", "b"], "left").groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.count("t").alias("together"))
    return s.withColumn("cost", F.round(F.greatest(F.lit(0.1), F.least(F.lit(10.0), 1 - F.log2((F.col("together") + prior * rate) / (F.col("edges") + prior)))), 6))


def nearest_rank(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, p50, p95 by nearest rank."""
    return df.groupBy(F.col(key).alias("key")).agg(*(F.round(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})"), 6).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"))))


def flow_completeness(entries: DataFrame, known: DataFrame, flows: DataFrame) -> DataFrame:
    """One row: how many known entry names (name) some detected entry (qualified_name) holds, recall, and depths of the flows."""
    k, e = known.select(F.lower("name").alias("k")).distinct(), entries.select(F.lower("qualified_name").alias("q"))
    found = k.join(e.select(F.explode(F.array_union(F.split("q", "::"), F.array("q"))).alias("k")).distinct(), "k", "left_semi")
    sizes = k.agg(F.count(F.lit(1)).alias("known")).crossJoin(found.agg(F.count(F.lit(1)).alias("found")))
    depth = flows.agg(F.count(F.lit(1)).alias("flows"), F.coalesce(F.floor(F.avg("depth")), F.lit(0)).cast("long").alias("avg_depth"), F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_depth"))
    return sizes.crossJoin(depth).select("known", "found", "flows", F.when(F.col("known") == 0, 1.0).otherwise(F.round(F.col("found") / F.col("known"), 3)).alias("recall"), "avg_depth", "max_depth")


def multi_hop(hits: DataFrame, anchors: DataFrame, neighbours: DataFrame, expected: DataFrame) -> DataFrame:
    """task, anchor_rank, recall, score: the anchor's rank among the hits, and how many expected neighbours it has.

    ``hits`` (task, id, rank), ``anchors`` (task, id), ``neighbours`` (id, other), ``expected`` (task, other).
    """
    rank = anchors.join(hits, ["task", "id"], "left").groupBy("task").agg(F.min("rank").alias("anchor_rank"), F.min_by("id", F.struct("rank", "id")).alias("id"))
    near = expected.join(rank.select("task", "id"), "task", "left").join(neighbours.select("id", "other", F.lit(1).alias("hit")).distinct(), ["id", "other"], "left")
    got = near.groupBy("task").agg(F.round(F.count("hit") / F.count(F.lit(1)), 3).alias("recall"))
    d = rank.join(got, "task", "left").withColumn("recall", F.coalesce("recall", F.lit(0.0)))
    return d.select("task", F.coalesce("anchor_rank", F.lit(0)).alias("anchor_rank"), "recall", F.when(F.col("anchor_rank").isNull(), 0.0).otherwise(F.col("recall")).alias("score"))


def token_efficiency(answers: DataFrame, naive_tokens: int) -> DataFrame:
    """question, hit_count, graph_tokens, ratio: tokens of the hits (question, qualified_name, source_uri) against reading everything."""
    size = lambda c: F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4))
    d = answers.groupBy("question").agg(F.count(F.lit(1)).alias("hit_count"), F.sum(size(F.col("qualified_name")) + size(F.col("source_uri"))).alias("graph_tokens"))
    return d.withColumn("ratio", F.round(F.lit(naive_tokens) / F.col("graph_tokens"), 1))
