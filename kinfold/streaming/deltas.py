"""A keyed table as a base, deltas and tombstones.

Rows lie in hash buckets of their keys. An upsert writes a delta with the buckets of its own rows and no others; a deletion
writes tombstones there, by key or for all rows of given parents. Readers merge: of a key the newest delta counts, and the base
gives the keys that no delta names. Deltas are merged with each other after ``UPDATE_ROWS`` rows, and with the base after
``REBUILD_TIMES`` as many, so that what a reader has to merge stays bounded; the work of an upsert follows its rows, that of a
rebuild comes once in so many rows.

A version is a folder; it counts once Spark's writer has marked it whole, so that a writer that is lost leaves nothing that is
read. There is one writer at a time. Batches of a stream have numbers, a version says up to which it goes, and a batch that is
replayed is not applied again.

Defined cases: of rows of one key in a batch the last in the given order counts, ties are broken by a hash of the row; null
keys are keys, and equal to each other; deleting what is not there changes nothing; an empty batch makes an empty version.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.operators.ordering import running
from kinfold.session import materialize, remove, scratch
from kinfold.streaming.upsert import maintenance_due

BUCKETS = 64
#: Rows of deltas from which they are merged, and how many times that from which the base is rebuilt.
UPDATE_ROWS, REBUILD_TIMES = 50, 5
#: Of the most rows or bytes, the share from which a clean-up is due, and the share that it leaves.
CLEAN_FROM, CLEAN_TO = 0.8, 0.7
BUCKET, GONE, VERSION = "_bucket", "_gone", "_version"
#: Columns of the table's own; rows do not have these.
OWN = (BUCKET, GONE, VERSION)


@dataclass(frozen=True)
class Version:
    """A whole version: its number, base or delta, the last batch that it holds, the first version that it stands for."""

    number: int
    kind: str
    batch: int
    first: int

    @property
    def name(self) -> str:
        return f"v={self.number}.{self.kind}.{self.batch}.{self.first}"


class DeltaTable:
    """A table of rows with unique keys under ``path``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.empty = spark.createDataFrame([], schema)
        self.columns = self.empty.columns
        if set(self.columns) & set(OWN):
            raise ValueError(f"{OWN} are names of the table's own columns")

    # --- versions

    def _all(self) -> list[Version]:
        jvm = self.spark._jvm
        home = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = home.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(home):
            return []
        out = []
        for status in fs.listStatus(home):
            name = status.getPath().getName()
            if (m := re.fullmatch(r"v=(\d+)\.(base|delta)\.(-?\d+)\.(\d+)", name)) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")):
                out.append(Version(int(m[1]), m[2], int(m[3]), int(m[4])))
        return sorted(out, key=lambda v: v.number)

    def versions(self) -> list[Version]:
        """What a reader reads: the last base, and the deltas after it, merged ones in place of their parts."""
        out: list[Version] = []
        for v in self._all():
            out = [w for w in out if w.number < v.first]
            out.append(v)
        return out

    def _write(self, rows: DataFrame, kind: str, batch: int, first: int | None = None) -> Version:
        number = max((v.number for v in self._all()), default=-1) + 1
        v = Version(number, kind, batch, number if first is None else first)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        # Rows of one bucket meet in one task and make one file.
        dealt = rows.withColumn(BUCKET, bucket).repartition(BUCKET)
        dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{v.name}")
        return v

    def _stored(self, v: Version, buckets: list[int] | None = None) -> DataFrame:
        whole = self.empty.select("*", F.lit(False).alias(GONE), F.lit(0).alias(BUCKET)).schema
        rows = self.spark.read.schema(whole).parquet(f"{self.path}/{v.name}")
        return rows if buckets is None else rows.filter(F.col(BUCKET).isin(buckets))

    # --- reading

    def _merged_deltas(self, deltas: list[Version], buckets: list[int] | None = None) -> DataFrame:
        """The newest row of each key, tombstones too."""
        rows = self.empty.select("*", F.lit(False).alias(GONE), F.lit(0).alias(VERSION)).limit(0)
        for v in deltas:
            rows = rows.unionByName(self._stored(v, buckets).drop(BUCKET).withColumn(VERSION, F.lit(v.number)))
        newest = W.partitionBy(*self.keys).orderBy(F.desc(VERSION))
        return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", VERSION)

    def _merge(self, versions: list[Version], buckets: list[int] | None = None) -> DataFrame:
        base = [v for v in versions if v.kind == "base"]
        deltas = [v for v in versions if v.kind == "delta"]
        old = self._stored(base[0], buckets).select(*self.columns) if base else self.empty
        if not deltas:
            return old
        new = self._merged_deltas(deltas, buckets)
        named = new.select(*[F.col(k).alias(f"_new_{k}") for k in self.keys])
        same = [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in self.keys]
        kept = old.join(named, on=_all_of(same), how="left_anti")
        return kept.unionByName(new.filter(~F.col(GONE)).select(*self.columns))

    def read(self) -> DataFrame:
        """All rows."""
        return self._merge(self.versions())

    def get(self, keys: list[tuple]) -> DataFrame:
        """Rows of a few keys; only their buckets are read."""
        wanted = self.spark.createDataFrame(keys, self.empty.select(*self.keys).schema)
        buckets = [r[0] for r in wanted.select(F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")).distinct().collect()]
        asked = wanted.distinct().select(*[F.col(k).alias(f"_asked_{k}") for k in self.keys])
        return self._merge(self.versions(), buckets).join(F.broadcast(asked), on=_all_of([F.col(k).eqNullSafe(F.col(f"_asked_{k}")) for k in self.keys]), how="left_semi")

    # --- writing

    def _last_batch(self) -> int:
        return max((v.batch for v in self._all()), default=-1)

    def upsert(self, rows: DataFrame, order: list[str], batch: int | None = None, gone: str | None = None) -> Version | None:
        """Apply ``rows``, the last of each key in ``order``; nothing if the stream's batch has been applied.

        Rows whose column ``gone`` is true are tombstones of their keys.
        """
        last = self._last_batch()
        if batch is not None and batch <= last:
            return None
        latest = W.partitionBy(*self.keys).orderBy(*[F.desc(c) for c in order], F.xxhash64(*self.columns))
        marked = rows.withColumn(GONE, F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False))
        once = marked.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").select(*self.columns, GONE)
        return self._write(once, "delta", last if batch is None else batch)

    def delete(self, keys: DataFrame) -> Version:
        """Tombstones for ``keys``, whether they are there or not."""
        gone = keys.select(*self.keys).distinct()
        others = [F.lit(None).cast(t).alias(c) for c, t in self.empty.dtypes if c not in self.keys]
        return self._write(gone.select("*", *others, F.lit(True).alias(GONE)).select(*self.columns, GONE), "delta", self._last_batch())

    def delete_children(self, parents: DataFrame, column: str) -> Version:
        """Tombstones for all rows whose ``column`` is one of ``parents`` (a table with that column)."""
        return self.delete(self.read().join(parents.select(column).distinct(), column, "left_semi"))

    def update(self) -> Version | None:
        """Put the deltas together; tombstones stay, for the base may hold their keys."""
        deltas = [v for v in self.versions() if v.kind == "delta"]
        if len(deltas) < 2:
            return None
        return self._write(self._merged_deltas(deltas), "delta", self._last_batch(), deltas[0].number)

    def rebuild(self) -> Version | None:
        """A new base without deltas and tombstones."""
        versions = self.versions()
        if not any(v.kind == "delta" for v in versions):
            return None
        return self._write(self._merge(versions).withColumn(GONE, F.lit(False)), "base", self._last_batch(), versions[0].number)

    def compact(self, every: int = UPDATE_ROWS, times: int = REBUILD_TIMES) -> str:
        """none, update or rebuild: what the rows of the deltas ask for, done."""
        deltas = [v for v in self.versions() if v.kind == "delta"]
        rows = {v.number: self._stored(v).count() for v in deltas}  # footers alone are read
        if sum(rows.values()) >= every * times:
            return "rebuild" if self.rebuild() else "none"
        if sum(n for k, n in rows.items() if k > deltas[0].number) >= every:
            return "update" if self.update() else "none"
        return "none"

    def clean_up(self, oldest_first: list[Column], hours: float, size: Column, most_rows: int, most_bytes: int) -> int:
        """Delete the first rows in order until ``CLEAN_TO`` of both bounds is kept, if a day has gone and ``CLEAN_FROM`` of one is reached; how many went."""
        with scratch(self.spark):
            rows = materialize(self.read().select(*self.columns, size.cast("long").alias("_size")), "rows")
            n, total = rows.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
            if not maintenance_due(n, total, hours, most_rows, most_bytes, CLEAN_FROM):
                return 0
            ranked = running(rows, oldest_first, {"_bytes": "_size"})
            # A row goes while, with it, more is left than may be kept.
            gone = materialize(ranked.filter((n - F.col("row_no") + 1 > CLEAN_TO * most_rows) | (total - F.col("_bytes") + F.col("_size") > CLEAN_TO * most_bytes)).select(*self.keys), "gone")
            self.delete(gone)
            return gone.count()

    def vacuum(self) -> int:
        """Remove versions that no reader needs any more; how many."""
        live = {v.number for v in self.versions()}
        old = [v for v in self._all() if v.number not in live]
        for v in old:
            remove(self.spark, f"{self.path}/{v.name}")
        return len(old)

    def stream(self, rows: DataFrame, order: list[str], checkpoint: str, every: int = UPDATE_ROWS, times: int = REBUILD_TIMES):
        """A running query that upserts every micro-batch of the streaming table ``rows`` and compacts as it goes."""

        def apply(df: DataFrame, i: int) -> None:
            self.upsert(df, order, i)
            self.compact(every, times)

        return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply).start()


def _all_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
