"""Pending changes that settle: one update a path after it has been quiet, however often it changed.

Rows of (path, content, deleted, at) come as a stream. State per path holds the newest pending version and the hash of what was passed on last; each
change puts the path's timer off, and when it runs out the pending version is passed on, unless it is what was passed on
before. State and timers are in the stream's checkpoint, so a restart goes on where it stopped; a batch that runs again passes the same rows
on, which the store takes as no change.

Of versions with one time, one that is not deleted wins, then the greater hash. A null path is left out. State needs the RocksDB provider, which :func:`watch_settled` names for its query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessera.sources.store import Store
from tessera.streaming.watch import CHANGES, apply_batch

_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _order(at: int, deleted: bool, content: str | None) -> tuple:
    return at, not deleted, hashlib.sha256((content or "").encode()).hexdigest()


def _mark(deleted: bool, content: str | None) -> str:
    return "deleted" if deleted else _order(0, False, content)[2]


class Settle(StatefulProcessor):
    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "content string, deleted boolean, at long")
        self.passed = handle.getValueState("passed", "mark string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.pending.get()
        best = None if held is None else (held[2], held[1], held[0])
        for batch in rows:
            for content, deleted, at in zip(batch["content"], batch["deleted"], batch["at"]):
                new = (int(at), bool(deleted), None if pd.isna(content) else content)
                if best is None or _order(*new) > _order(*best):
                    best = new
        if best is not None:
            self.pending.update((best[2], best[1], best[0]))
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, passed = self.pending.get(), self.passed.get()
        self.pending.clear()
        if held is not None:
            content, deleted, at = held
            mark = _mark(deleted, content)
            if passed is None or passed[0] != mark:
                self.passed.update((mark,))
                yield pd.DataFrame({"path": [key[0]], "content": [content], "deleted": [deleted], "at": [at]})

    def close(self) -> None:
        return


def settled(changes: DataFrame, *, quiet_ms: int = 2000) -> DataFrame:
    """The stream of (path, content, deleted, at) with one row a path each time that it has been quiet."""
    grouped = changes.filter("path IS NOT NULL AND at IS NOT NULL").selectExpr("path", "content", "coalesce(deleted, false) AS deleted", "at").groupBy("path")
    return grouped.transformWithStateInPandas(statefulProcessor=Settle(quiet_ms), outputStructType=CHANGES, outputMode="Append", timeMode="ProcessingTime")


def watch_settled(spark: SparkSession, store: Store, landing: str, checkpoint: str, *, quiet_ms: int = 2000, every: str = "1 second") -> StreamingQuery:
    """Refresh the store with changes that land as Parquet, each path once it has been quiet; runs until it is stopped."""
    stream = settled(spark.readStream.schema(CHANGES).parquet(landing), quiet_ms=quiet_ms)
    before = spark.conf.get(_PROVIDER[0], None)
    spark.conf.set(*_PROVIDER)
    try:  # a query keeps the provider that it started with
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: batch.isEmpty() or apply_batch(store, batch) and None).trigger(processingTime=every).start()
    finally:
        spark.conf.unset(_PROVIDER[0]) if before is None else spark.conf.set(_PROVIDER[0], before)
