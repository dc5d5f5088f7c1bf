"""What a cache lets go: by size budget, priority, recency, age and share. All orders end with the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.ordering import running

MEGABYTE = 1048576.0


def _micros(c: Column) -> Column:
    """Microseconds of a timestamp, with or without a zone."""
    return F.unix_micros(c.cast("timestamp"))


def oldest_until(cache: DataFrame, needed: float, most: float) -> DataFrame:
    """The oldest items until max(needed, size - most + needed) bytes are free. ``cache``: id, updated, size."""
    placed = running(cache, [F.col("updated"), F.col("id")], {"sum_size": "size"})
    free = F.greatest(F.lit(float(needed)), F.col("total_sum_size") - most + needed)
    return placed.filter((F.col("sum_size") - F.col("size") < free) & (free > 0)).drop("row_no", "total_rows", "total_sum_size", "sum_size")


def priority_score(last: Column, frequency: Column, size: Column, now: Column) -> Column:
    months = F.greatest(F.lit(0.0), (_micros(now) - _micros(last)) / 1e6 / (60 * 60 * 24 * 30))
    return 0.5 * (1 / (months + 1)) + 0.3 * F.log(frequency + 1.0) - 0.2 * (size / MEGABYTE)


def least_wanted(cache: DataFrame, count_ratio: float, size_ratio: float) -> DataFrame:
    """The items of least priority, until the shares of count and size that may stay are met. ``cache``: id, priority, size."""
    placed = running(cache, [F.col("priority"), F.col("id")], {"sum_size": "size"})
    left = F.col("total_rows") - (F.col("row_no") - 1)
    size = F.col("total_sum_size") - (F.col("sum_size") - F.col("size"))
    enough = (left <= F.floor(F.col("total_rows") * count_ratio)) & (size <= F.col("total_sum_size") * size_ratio)
    return placed.filter(~enough).drop("row_no", "total_rows", "total_sum_size", "sum_size")


def most_recent(cache: DataFrame, k: int) -> DataFrame:
    """The ``k`` items used last: a top-k."""
    return cache.orderBy(F.desc("last_used"), "id").limit(k)


def unused_first(cache: DataFrame, ratio: float | None = None, least: int = 10) -> DataFrame:
    """Never used items, then the oldest, a share of all; none below ``least`` items. ``cache``: id, uses, updated."""
    placed = running(cache, [(F.col("uses") > 0), F.col("updated"), F.col("id")])
    n = F.col("total_rows")
    share = F.lit(ratio) if ratio is not None else F.when(n > 10000, 0.2).when(n < 1000, 0.05).otherwise(0.1)
    remove = F.floor(n * F.greatest(F.lit(0.05), F.least(F.lit(0.5), share)))
    return placed.filter((F.col("row_no") <= remove) & (remove >= least)).drop("row_no", "total_rows")


def least_used(cache: DataFrame, share: float) -> DataFrame:
    """The share of the items that are used least, then longest ago. ``cache``: id, uses, last_used."""
    placed = running(cache, [F.col("uses"), F.col("last_used"), F.col("id")])
    return placed.filter(F.col("row_no") <= F.floor(F.col("total_rows") * share)).drop("row_no", "total_rows")


def expired(cache: DataFrame, now: Column, days: float) -> DataFrame:
    """Items not updated within the last ``days`` days."""
    return cache.filter(_micros(F.col("updated")) <= _micros(now) - int(days * 86_400_000_000))


def surplus(items: DataFrame, most: int) -> DataFrame:
    """The oldest items beyond ``most``, visible ones left out. ``items``: id, loaded, visible."""
    placed = running(items, [F.col("loaded"), F.col("id")])
    return placed.filter((F.col("row_no") <= F.col("total_rows") - most) & ~F.col("visible")).drop("row_no", "total_rows")
