"""Sessions, table loading and intermediate tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benchmarks. On a cluster use the session that is there."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("kinfold")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may leave it unset; it gets a new folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _own_dirs.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="kinfold-"))
    return path.rstrip("/")


#: Folders of the open ``scratch`` blocks, the innermost last, and what executors keep for them.
_folders: list[str] = []
_kept: list[list[DataFrame]] = []


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder of the innermost ``scratch`` block, or in the shared folder."""
    return f"{_folders[-1] if _folders else shared_dir(spark)}/kinfold-{tag}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside go when the block ends, but those materialised with ``outlive``."""
    _folders.append(shared_path(spark, "scratch"))
    _kept.append([])
    try:
        yield
    finally:
        for df in reversed(_kept.pop()):
            df.unpersist()
        remove(spark, _folders.pop())


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Joins that Spark turns to broadcasts by itself, and up to which size on disk it may do so while a table is written. Compressed
#: files say little of the rows, and nothing of those that an explode makes of them: all of them go through the driver's memory.
AUTO_BROADCAST, MOST_AUTO = "spark.sql.autoBroadcastJoinThreshold", 256 << 10


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for what is planned inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _bytes(size: str) -> int:
    """A size of bytes as Spark writes it: -1, 262144, 10MB, 256k."""
    number = size.strip().lower().removesuffix("b")
    unit = "kmgtp".find(number[-1]) + 1
    return int(number[:-1] if unit else number) << 10 * unit


def materialize(df: DataFrame, tag: str, outlive: bool = False, files: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that survives lost executors.

    Its shuffle files are given back as soon as it is written. ``outlive``: it belongs to the block around this one.
    Without ``files`` executors keep its parts on disk, from its first use to the end of the block. That is for tables made
    without a shuffle, of which a lost executor costs no more than its tasks either. No task writes a file then; for each
    file in a local folder Hadoop starts three processes (chmod) where it has no native library.
    """
    spark = df.sparkSession
    if not files:
        df = df.persist(StorageLevel.DISK_ONLY)
        if _kept:
            _kept[-1].append(df)
        return df
    inner = _folders.pop() if outlive and _folders else None
    try:
        path = shared_path(spark, tag)
    finally:
        if inner:
            _folders.append(inner)
    with _set(spark, {SHUFFLE_CLEANUP: "true", AUTO_BROADCAST: str(min(MOST_AUTO, _bytes(spark.conf.get(AUTO_BROADCAST))))}):
        df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, as --py-files would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    home = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="kinfold-"), "kinfold.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(home.rglob("*.py")):
            out.write(source, source.relative_to(home.parent))
    context.addPyFile(path)
