"""Files in and out: binary and JSON sources, archives of a plan, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import rules

GLOB = "*.{jpg,jpeg,png,gif,webp,heic,JPG,JPEG,PNG,GIF,WEBP,HEIC}"


def read_files(spark: SparkSession, path: str, glob: str = GLOB) -> DataFrame:
    """id, name, path, mime, size, modified, content of the files below ``path``; unreadable ones are left out."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    files = reader.load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.xxhash64("path").alias("id"), name.alias("name"), "path", rules.mime_of(name).alias("mime"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def as_base64(content: Column) -> Column:
    return F.base64(content)


def decoded(files: DataFrame, decode: Callable, schema: str) -> DataFrame:
    """The files run through ``decode`` (an iterator of pandas frames to one of frames): the hook for picture codecs."""
    return files.mapInPandas(decode, schema)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_cache(rows: DataFrame, path: str, most_bytes: int | None = None, size: str = "size", order: str = "last_used") -> None:
    """JSON rows; within ``most_bytes`` the rows used last."""
    if most_bytes is not None:
        from kinfold.operators.ordering import running

        rows = running(rows, [F.desc(order), F.col("id")], {"_sum": size}).filter(F.col("_sum") <= most_bytes).drop("_sum", "total__sum", "row_no", "total_rows")
    rows.write.mode("overwrite").json(path)


def write_organized(acted: DataFrame, items: DataFrame, reports: DataFrame, path: str, part_rows: int = 200) -> None:
    """Kept and deleted items by action and part, and the report, below ``path``. ``items``: id and what goes with it."""
    from kinfold.operators.ordering import running

    placed = running(acted.join(items, "id"), [F.col("action"), F.col("id")])
    placed.withColumn("part", F.floor((F.col("row_no") - 1) / part_rows).cast("int")).drop("row_no", "total_rows").write.mode("overwrite").partitionBy("action", "part").parquet(f"{path}/items")
    reports.select("report").write.mode("overwrite").text(f"{path}/report")


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    """name and a map of figures, one column for each name of a figure; those names become the schema."""
    names = sorted(r.k for r in metrics.select(F.explode(F.map_keys("figures")).alias("k")).distinct().collect())
    metrics.select("name", *[F.col("figures")[n].alias(n) for n in names]).write.mode("overwrite").option("header", "true").csv(path)
