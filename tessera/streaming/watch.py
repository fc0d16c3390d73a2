"""Incremental refresh as a stream: new file versions arrive as rows, each micro-batch updates the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.changes import file_diff
from tessera.runtime import materialise
from tessera.sources.code import code_graph
from tessera.sources.store import Store

CHANGES = "path string, content string, deleted boolean, at long"


def apply_batch(store: Store, batch: DataFrame) -> int:
    """Update the store with the latest version of each path in the batch; unchanged contents do nothing.

    Of versions with one time, one that is not deleted wins, then the greater hash, so a batch that runs again gives the same store.
    """
    hashed = batch.withColumn("hash", F.sha2(F.coalesce("content", F.lit("")), 256))
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("at"), "deleted", F.desc("hash")))
    now = materialise(hashed.withColumn("nth", last).filter("nth = 1").drop("nth"), "batch")
    state = store.file_state().join(now.select("path"), "path", "left_semi")
    current = now.filter("NOT deleted").select("path", "hash")
    touched = materialise(file_diff(state, current), "batch-touched")
    if touched.isEmpty():
        return store.version()
    changed = now.filter("NOT deleted").join(touched.select("path"), "path", "left_semi")
    return store.update(code_graph(changed), touched, current)


def watch(spark: SparkSession, store: Store, landing: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Read change rows that land as Parquet and refresh the store; the checkpoint makes a batch run again whole or not at all."""
    stream = spark.readStream.schema(CHANGES).parquet(landing)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: apply_batch(store, batch) and None)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def event_windows(spark: SparkSession, path: str, schema: str, *, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and sums of an event stream by window and type; rows later than ``late`` are dropped by the watermark."""
    e = spark.readStream.schema(schema).parquet(path)
    return e.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
