"""Mixing sources to target weights by Poisson replication.

A source with ``n`` of ``N`` rows and target weight ``w`` (weights sum to 1) gets the mean
repetition rate ``w * total / n``. Each document inverts the Poisson distribution of that
mean at a uniform number drawn from a hash of its id and the seed, and is emitted as many
times as the count says; a hash of (seed, id, replica) then deals all copies over the
partitions and orders them there, which is a global shuffle without a sort of the whole.

The only thing gathered is one row per source. A hot source is no hot key: rows are dealt
by the hash of the copy, never by source. Reruns give the same rows.

Defined cases: a null source is a source of its own; a weight for a source without rows is
ignored and the rest is renormalised; without given weights, a source weighs
``n ** temper``; with them, a source that is not named weighs 0 and is dropped; means above 256 are drawn as sums of smaller Poisson variables; null and empty texts are
documents like others; rows that repeat an id get the same count; an empty table stays
empty; extra columns pass through, and one named like a column that the operator adds becomes
``<name>_in`` (with ``own_columns_only`` nothing is added and nothing renamed); the sum of weights is taken in
decimals, so that it doesn't depend on the order of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._frames import aside

ADDED = ["n_copies", "replica", "rate", "shuffle_key"]
_STEP = 256.0
_TERMS = 700


def rates(docs: DataFrame, *, source_col: str = "source", weights: dict[str, float] | None = None, temper: float = 0.5, total: int | None = None) -> DataFrame:
    """source_key, n_source, rate: the mean repetition rate of each source."""
    counts = docs.groupBy(F.col(source_col).alias("source_key")).agg(F.count(F.lit(1)).alias("n_source"))
    if weights is None:
        raw = F.pow(F.col("n_source").cast("double"), F.lit(float(temper)))
    else:
        raw = F.lit(0.0)
        for name, w in weights.items():
            raw = F.when(F.col("source_key").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(raw)
    weighed = counts.withColumn("raw", raw)
    raw_sum, n_total = weighed.agg(F.sum(F.col("raw").cast("decimal(38,12)")), F.sum("n_source")).first()
    wanted = float(total) if total is not None else float(n_total or 0)
    return weighed.select("source_key", "n_source", (F.col("raw") / F.lit(float(raw_sum or 1)) * F.lit(wanted) / F.col("n_source")).alias("rate"))


def uniform(*keys: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the keys, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *keys)), 1, 13), 16, 10).cast("double") / float(2**52)


def poisson_inverse(u: Column, mean: Column) -> Column:
    """Smallest k with u < P(X <= k), X Poisson of ``mean`` (at most 256), by the recurrence of its terms."""
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("below"), F.lit(0).alias("k"))

    def step(state: Column, i: Column) -> Column:
        term = state["term"] * mean / i
        return F.when(u < state["below"], state).otherwise(F.struct(term.alias("term"), (state["below"] + term).alias("below"), i.cast("int").alias("k")))

    last = F.least(F.lit(_TERMS), F.ceil(mean + 12 * F.sqrt(mean) + 24)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["k"])


def replicate(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, temper: float = 0.5, total: int | None = None, seed: int = 3, own_columns_only: bool = False) -> DataFrame:
    """``docs`` with copies, n_copies, replica (from 0), rate and shuffle_key, in shuffled order."""
    table = rates(docs, source_col=source_col, weights=weights, temper=temper, total=total).select("source_key", "rate")
    bound = 100_000  # sources that a broadcast may hold, about 5 MB
    rows = table.limit(bound + 1).collect()
    # The document travels as one struct, so none of its columns can be taken for one of ours.
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"), F.col(source_col).alias("source_of"), ident.alias("ident"))
    if len(rows) <= bound:
        table = F.broadcast(docs.sparkSession.createDataFrame(rows, table.schema))
    keyed = keyed.join(table, F.col("source_of").eqNullSafe(F.col("source_key")))
    pieces = F.greatest(F.ceil(F.col("rate") / _STEP), F.lit(1)).cast("int")
    part = F.col("rate") / pieces
    draws = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: poisson_inverse(uniform(F.lit(seed).cast("string"), F.col("ident"), i.cast("string")), part))
    keyed = keyed.withColumn("n_copies", F.when(F.col("rate") > 0, F.aggregate(draws, F.lit(0), lambda a, b: a + b)).otherwise(F.lit(0)))
    copies = keyed.filter("n_copies > 0").withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    copies = copies.withColumn("shuffle_key", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}s"), "ident", F.col("replica").cast("string"))), 1, 15), 16, 10).cast("long"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = copies.select("document", *([] if own_columns_only else ADDED), *(["shuffle_key"] if own_columns_only else [])).repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key")
    names = docs.columns if own_columns_only else aside(docs, ADDED).columns
    own = [F.col("document").getField(c).alias(name) for c, name in zip(docs.columns, names)]
    return copies.select(*own, *([] if own_columns_only else ADDED))
