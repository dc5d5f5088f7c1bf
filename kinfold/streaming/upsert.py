"""Incremental tables: upserts, deletions and expiry of keyed rows, in batches or from a stream.

Plain Parquet has no MERGE. A table is a folder of versions; an upsert writes the next version whole and then points to
it, so that readers see the old one or the new one. Each micro-batch of a stream is applied once: its id is part of the
version, and a batch that is replayed finds its version there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the last in ``order``."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and ``change``: added, updated, same or kept (only in the old)."""
    body = lambda df, name: df.select(*keys, F.xxhash64(*[c for c in sorted(df.columns) if c not in keys]).alias(name))
    both = body(old, "_old").join(body(new, "_new"), keys, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "kept").when(F.col("_old") == F.col("_new"), "same").otherwise("updated")
    return both.select(*keys, change.alias("change"))


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


class KeyedTable:
    """A table of rows with unique keys in a folder of versions."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), keys, schema

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        jvm, fs = self.spark._jvm, self._fs()
        home = jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.exists(home):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(home)]
        whole = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in whole)

    def read(self) -> DataFrame:
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={found[-1]}")

    def write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/v={version}")

    def upsert(self, rows: DataFrame, order: list[str], version: int | None = None) -> None:
        """Apply ``rows``, the last of each key; with a version that is there already, nothing."""
        found = self.versions()
        version = (found[-1] + 1 if found else 0) if version is None else version
        if version not in found:
            self.write(merged(self.read(), last_of_each(rows, self.keys, order), self.keys), version)

    def delete(self, keys: DataFrame) -> None:
        self.write(self.read().join(keys.select(*self.keys).distinct(), self.keys, "left_anti"), (self.versions() or [-1])[-1] + 1)

    def stream(self, rows: DataFrame, order: list[str], checkpoint: str):
        """A running query that upserts every micro-batch of the streaming table ``rows``."""
        base = (self.versions() or [-1])[-1] + 1
        return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: self.upsert(df, order, base + i)).start()


def maintenance_due(items: int, size: int, hours: float, most_items: int = 5000, most_bytes: int = 100 << 20, share: float = 0.8) -> bool:
    """Whether a cache wants a clean-up: once a day at most, from ``share`` of either bound on."""
    return hours >= 24 and (items >= share * most_items or size >= share * most_bytes)


def rebuild_due(added: int, every: int = 50, rebuild: int = 5) -> str:
    """none, update or rebuild after ``added`` items."""
    if added == 0 or added % every:
        return "none"
    return "rebuild" if added // every % rebuild == 0 else "update"
