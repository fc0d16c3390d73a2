"""Sharding along a Hilbert curve over document metadata.

Each metadata dimension is quantised to ``2 ** bits`` levels at its quantiles (order is
kept, so shards have tight minima and maxima), the levels become one index on a Hilbert
curve, rows are ranked by that index, and the ranking is cut into runs: shard ``s`` of
``k`` holds the ranks from ``ceil(s * n / k)`` on, so row counts differ by one at most
(the law ``rows``).

The ranking needs no global sort. Rows are counted by (curve index, sub-bucket of the
id's hash); the offsets are a running sum over that small table, and only within one
sub-bucket, about ``rows_per_bucket`` rows at most, are rows numbered by id. A hot cell of the
curve is split over its sub-buckets. Texts are not shuffled.

Quantiles of numbers are approximate, those of strings exact over a count of each value: the counts
are range-partitioned by value, each partition's sum goes to the driver (one row a partition), and only
the values at which a quantile is crossed are collected, at most ``2 ** bits`` a dimension.

Defined cases: null metadata is level 0; null ids are rows like any other; null text has no bytes (size 8, CRC-32 0); with
fewer rows than shards the later shards may be empty; rows that repeat an id are numbered by
CRC-32 and size of the text; equal texts are not kept together, since the law is on counts; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._frames import aside
from tessera.runtime import discard, materialise


def hilbert_index(levels: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of ``levels`` (n rows, d columns below ``2 ** bits``).

    Transposition from axes to curve: undo the excess rotations from the top bit down,
    then Gray-encode, then interleave the bits.
    """
    x = levels.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def string_bounds(docs: DataFrame, column: Column, steps: int) -> list[str]:
    """Values at which ``1 / steps``, ``2 / steps`` ... of the rows are reached, in order."""
    counts = docs.select(column.alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "values")
    sums = {r["part"]: r["n"] for r in counts.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before, total = [], 0
    for part in sorted(sums):
        before.append((part, total))
        total += sums[part]
    if not total:
        return []
    given = docs.sparkSession.createDataFrame(before, "part int, below long")
    up_to = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    reached = counts.withColumn("up_to", up_to).join(F.broadcast(given), "part").withColumn("up_to", F.col("up_to") + F.col("below"))
    crossing = reached.filter(F.floor(F.col("up_to") * steps / total) > F.floor((F.col("up_to") - F.col("n")) * steps / total))
    return sorted(r["value"] for r in crossing.filter(F.col("up_to") < total).select("value").collect())


def levels(docs: DataFrame, dimensions: list[str], bits: int) -> list[Column]:
    """A level expression for each dimension, from quantiles of all rows."""
    kinds = dict(docs.dtypes)
    steps = [i / 2**bits for i in range(1, 2**bits)]
    numbers = [c for c in dimensions if kinds[c] != "string"]
    found = docs.agg(F.count(F.lit(1)), *(F.percentile_approx(F.col(c).cast("double"), steps, 10_000) for c in numbers)).first()
    bounds = dict(zip(numbers, found[1:]))

    def level(c: str) -> Column:
        value = F.col(c) if kinds[c] == "string" else F.col(c).cast("double")
        edges = string_bounds(docs, F.col(c), 2**bits) if kinds[c] == "string" else sorted({float(b) for b in bounds[c] or []})
        if not edges:
            return F.lit(0)
        return F.when(value.isNull(), 0).otherwise(F.size(F.filter(F.array(*map(F.lit, edges)), lambda b: b < value)))

    return [level(c) for c in dimensions]


def hilbert_shards(docs: DataFrame, *, n_shards: int = 24, dimensions: tuple[str, ...] = ("source", "lang", "n_chars"), bits: int = 5, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 100_000, row_col: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, hilbert, position, law, shard, slot, grown_shard.

    ``row_col`` names a column that tells rows apart; it comes along in front and settles ties.
    """
    carried = [row_col] if row_col else []

    @F.pandas_udf("long")
    def curve(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cells.to_numpy(), bits))

    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    cells = F.struct(*(c.cast("int").alias(f"d{i}") for i, c in enumerate(levels(docs, list(dimensions), bits))))
    thin = docs.select(*carried, F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), cells.alias("cells"))
    thin = materialise(thin.withColumn("hilbert", curve("cells")).drop("cells"), "shards")
    n = thin.count()
    sub = F.pmod(F.xxhash64("doc_id", "text_crc32", *carried), F.lit(max(1, n // rows_per_bucket)))
    thin = thin.withColumn("sub", sub)
    counts = thin.groupBy("hilbert", "sub").agg(F.count(F.lit(1)).alias("n"))
    cell_sizes = counts.groupBy("hilbert").agg(F.sum("n").alias("n"))
    # At most 2 ** (bits * dimensions) rows, whatever the table holds.
    cell_start = cell_sizes.select("hilbert", (F.sum("n").over(Window.orderBy("hilbert")) - F.col("n")).alias("cell_start"))
    inner = F.sum("n").over(Window.partitionBy("hilbert").orderBy("sub")) - F.col("n")
    starts = counts.withColumn("inner_start", inner).join(cell_start, "hilbert").select("hilbert", "sub", (F.col("cell_start") + F.col("inner_start")).alias("start"))
    local = F.row_number().over(Window.partitionBy("hilbert", "sub").orderBy("doc_id", "text_crc32", "size", *carried)) - 1
    ranked = thin.withColumn("local", local).join(starts, ["hilbert", "sub"]).withColumn("position", F.col("start") + F.col("local"))
    shard = F.expr(f"(position * {n_shards}) div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {n_shards - 1}) div {n_shards}")
    return (
        ranked.withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("position") - first)
        .select(*carried, "doc_id", "size", "text_crc32", "hilbert", "position", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    )


def write_shards(docs: DataFrame, path: str, *, rows_per_file: int = 1_000_000, **options) -> None:
    """Write every document once as Parquet, one directory a shard, each file a run of the curve.

    Columns are those of ``docs`` and ``slot``; the directories give ``shard``. A column of ``docs`` with one of these names is written as
    ``<name>_in``. Documents are told apart by a number that each gets first, so ids may be null or repeated, and ``id_col`` may be any column.
    """
    row = "_row"
    moved = aside(docs, ["shard", "slot", "position", row])
    names = dict(zip(docs.columns, moved.columns))
    options = {**options, **{k: names.get(options[k], options[k]) for k in ("id_col", "text_col") if k in options}}
    if "dimensions" in options:
        options["dimensions"] = tuple(names[c] for c in options["dimensions"])
    numbered = materialise(moved.withColumn(row, F.monotonically_increasing_id()), "shard-rows")
    placed = hilbert_shards(numbered, row_col=row, **options).select(row, "shard", "slot", "position")
    out = numbered.join(placed, row).drop(row)
    out = out.repartition("shard", F.expr(f"position div {rows_per_file}")).sortWithinPartitions("shard", "position").drop("position")
    out.write.partitionBy("shard").parquet(path)
    discard(numbered)
