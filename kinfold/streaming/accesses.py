"""Accesses as a stream: for each key how often, when last, and the last hundred, kept as state and in a keyed table.

Batches of rows are cut to each key's last ``KEEP`` before they are shuffled, with the number of rows they stand for, so that a
key that many rows share sends few. What a key keeps is the merge of such parts, in any order.

A key that has been idle for ``idle`` behind the watermark is forgotten; the table then drops its row, and it starts anew when
it comes back. The watermark is ``late`` behind the newest access of the batches before; Spark drops a part whose newest row is
behind it, so ``late`` must be as long as rows may take to arrive. Without ``idle`` there is no watermark: every row counts, and
every key stays.

Defined cases: rows without key or time are left out; of equal times the larger id is the later; values that are null are no
part of the mean, and a key without values has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from kinfold.session import ship
from kinfold.streaming.deltas import DeltaTable

#: Accesses kept of each key, and those of them that the mean is taken of.
KEEP, RECENT = 100, 10
FIGURES = "uses long, last long, mean_value double, kept long, first long, gone boolean"
#: transformWithState asks for this store.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each batch the last rows of each key; the last of all carries the number of rows."""
    for frame in frames:
        frame = frame.sort_values(["at", "id"], kind="stable")
        groups = frame.groupby("key", sort=False)
        frame["n"] = np.where(groups.cumcount(ascending=False) == 0, groups["key"].transform("size"), 0)
        frame["newest"] = groups["at"].transform("max")
        yield groups.tail(KEEP).assign(n=frame["n"], newest=frame["newest"])


class Accesses(StatefulProcessor):
    def __init__(self, idle: timedelta | None):
        self.idle_ms = None if idle is None else int(idle.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "uses long, at array<long>, id array<long>, value array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        uses, ring = 0, pd.DataFrame({"at": [], "id": [], "value": []})
        if self.state.exists():
            uses, at, ids, value = self.state.get()
            ring = pd.DataFrame({"at": at, "id": ids, "value": value})
        for frame in rows:
            uses += int(frame["n"].sum())
            parts = [x for x in (ring, frame[["at", "id", "value"]]) if len(x)]
            ring = pd.concat(parts).sort_values(["at", "id"], kind="stable").tail(KEEP)
        at = [int(x) for x in ring["at"]]
        values = [None if pd.isna(x) else float(x) for x in ring["value"]]
        self.state.update((uses, at, [int(x) for x in ring["id"]], values))
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at[-1] // 1000 + self.idle_ms)
        recent = [x for x in values[-RECENT:] if x is not None]
        yield self._row(key, uses, at[-1], sum(recent) / len(recent) if recent else None, len(at), at[0], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield self._row(key, 0, None, None, 0, None, True)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, uses, last, mean, kept, oldest, gone) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "uses": [uses], "last": pd.array([last], "Int64"), "mean_value": [mean], "kept": [kept], "first": pd.array([oldest], "Int64"), "gone": [gone]})


def tracked(accesses: DataFrame, idle: timedelta | None = None, late: str = "1 day") -> DataFrame:
    """A streaming table of changes (key, uses, last_used, mean_value, kept, oldest, gone) to the state of each key.

    ``accesses`` is a streaming table of key, at, id and value.
    """
    ship(accesses.sparkSession)
    kind = accesses.schema["key"].dataType.simpleString()
    rows = accesses.filter("key is not null and at is not null").select("key", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), F.col("id").cast("long").alias("id"), F.col("value").cast("double").alias("value"))
    rows = rows.withColumn("id", F.coalesce("id", F.lit(-(2**63)))).mapInPandas(_cut, f"key {kind}, at long, id long, value double, n long, newest long")
    if idle is not None:
        rows = rows.withColumn("seen", F.timestamp_micros("newest")).withWatermark("seen", late)
    out = StructType([StructField("key", accesses.schema["key"].dataType), *StructType.fromDDL(FIGURES).fields])
    changes = rows.groupBy("key").transformWithStateInPandas(Accesses(idle), out, "Update", "None" if idle is None else "EventTime")
    return changes.select("key", "uses", F.timestamp_micros("last").alias("last_used"), "mean_value", "kept", F.timestamp_micros("first").alias("oldest"), "gone")


def start(changes: DataFrame, state: DeltaTable, checkpoint: str, once: bool = False):
    """A running query that keeps ``state`` (a table with the columns of ``changes`` but gone, keyed by key) up to date.

    ``once``: it ends when all that is there has been read. A batch and its tombstones are one version of the table, so a
    restart from ``checkpoint`` applies each batch once.
    """
    spark: SparkSession = changes.sparkSession

    def apply(rows: DataFrame, i: int) -> None:
        # A key may be seen and forgotten in one batch: the tombstone comes last.
        state.upsert(rows, ["gone"], i, gone="gone")
        state.compact()

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        writer = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(apply)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.set(PROVIDER, before)


def table_of(spark: SparkSession, path: str, kind: str = "long", buckets: int = 16) -> DeltaTable:
    """The keyed table that ``start`` keeps."""
    return DeltaTable(spark, path, ["key"], f"key {kind}, uses long, last_used timestamp, mean_value double, kept long, oldest timestamp", buckets=buckets)
