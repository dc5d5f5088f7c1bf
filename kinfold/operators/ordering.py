"""Row numbers and running sums over a whole table without putting it into one task.

Rows are dealt by ranges of the order; numbers and sums run within a range, and the totals of the ranges before it, one
row for each range, are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.session import materialize


def running(df: DataFrame, order: list[Column], sums: dict[str, str] | None = None) -> DataFrame:
    """Adds ``row_no`` from 1 and, for each name in ``sums``, the sum of its column up to and with the row.

    ``order`` has to be total. ``total_rows`` and ``total_<name>`` hold the sums over all rows.
    """
    sums = sums or {}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    placed = materialize(placed, "ordered")
    per = placed.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    bases = per.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.sum("_n").over(every).alias("total_rows"), *[x for n in sums for x in (F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}"), F.sum(f"_s_{n}").over(every).alias(f"total_{n}"))])
    own = W.partitionBy("_part").orderBy(*order)
    upto = own.rowsBetween(W.unboundedPreceding, W.currentRow)
    # One row for each range: as few as there are shuffle partitions.
    joined = placed.join(F.broadcast(bases), "_part")
    out = joined.withColumn("row_no", F.row_number().over(own) + F.col("_n0"))
    for n, c in sums.items():
        out = out.withColumn(n, F.sum(c).over(upto) + F.col(f"_b_{n}"))
    return out.drop("_part", "_n0", *[f"_b_{n}" for n in sums])


def chunked(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Adds ``chunk``: rows in order, ``size`` at a time, from 0."""
    return running(df, order).withColumn("chunk", F.floor((F.col("row_no") - 1) / size)).drop("row_no", "total_rows")
