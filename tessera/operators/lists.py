"""Orders over whole tables without a sort in one task: dense places, and ranks of linked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import discard, materialise

_ROWS = 33


def numbered(rows: DataFrame, *order: Column, name: str) -> DataFrame:
    """``rows`` with their place (from 0) in an order over all of them; what is counted on the driver is one row a partition."""
    placed = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", _ROWS)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("part")).count().collect())
    before, given = 0, []
    for p, n in counts:
        given.append((p, before))
        before += n
    offsets = F.broadcast(placed.sparkSession.createDataFrame(given, "_part long, _before long"))
    out = placed.withColumn("_part", part).join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << _ROWS) - 1))
    return out.drop("_at", "_part", "_before")


def list_ranks(links: DataFrame) -> DataFrame:
    """item, end, steps: the last item of each item's list and how far it is, from (item, after) with a null after the last one.

    Pointers are doubled twice a round, so a list of n items takes log n / 2 rounds.
    """
    now = materialise(links.select("item", "after", F.coalesce("after", "item").alias("end"), F.when(F.col("after").isNull(), 0).otherwise(1).cast("long").alias("steps")), "ranks")

    def double(x: DataFrame) -> DataFrame:
        there = x.select(F.col("item").alias("after"), F.col("after").alias("then"), F.col("end").alias("last"), F.col("steps").alias("more"))
        return x.join(there, "after", "left").select("item", F.col("then").alias("after"), F.coalesce("last", "end").alias("end"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))

    while not now.filter("after IS NOT NULL").isEmpty():
        new = materialise(double(double(now)), "ranks")
        discard(now)
        now = new
    return now.select("item", "end", "steps")


def place_within(rows: DataFrame, group: str, *order: Column, name: str) -> DataFrame:
    """``rows`` with their place (from 0) in the order of their group; a large group lies in many tasks."""
    placed = materialise(numbered(rows, F.col(group).asc_nulls_first(), *order, name=name), "placed")
    first = placed.groupBy(F.col(group).alias("_group")).agg(F.min(name).alias("_first"))
    return placed.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col(name) - F.col("_first")).drop("_group", "_first")


def filled_down(rows: DataFrame, group: str, order: Column, value: Column, *, name: str) -> DataFrame:
    """``rows`` with the last value that is not null at or before them in the order of their group.

    Runs of 1,024 rows are filled by themselves; what comes in from before is looked up in a table of one row a run.
    """
    placed = numbered(rows.withColumn(name, value), F.col(group).asc_nulls_first(), order, name="_place")
    run = placed.withColumn("_run", F.shiftright("_place", 10))
    within = Window.partitionBy(group, "_run").orderBy("_place")
    run = materialise(run.withColumn("_here", F.last(name, ignorenulls=True).over(within)), "filled")
    ends = run.groupBy(group, "_run").agg(F.max_by("_here", "_place").alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(F.col(group).alias("_group"), F.col("_run").alias("_at"), before.alias("_before"))
    out = run.join(ends, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_run") == F.col("_at")))
    return out.withColumn(name, F.coalesce("_here", "_before")).drop("_place", "_run", "_here", "_group", "_at", "_before")
