"""Starts and ends of one key paired as brackets, over ranges of the order side by side.

Along the rows of a key a start opens a level and an end closes the last one open; an end without one is stray. Rows are dealt
by ranges of (key, time, id). A range takes the level c that is open before its first key to c + sum - min(0, c + low), where low
is the least running sum in it, so that few numbers of each range tell where all others begin. Within a range an end follows
its start among the rows of its key and level; what the ranges leave over, open starts and ends of starts before the range,
meets in a second round of the same kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.session import materialize


def _carries(ranges: list) -> list[tuple[int, int]]:
    """The open level of its first key before each range. Ranges: part, first, last, one (whether there is one key only), last_sum, last_low."""
    out, level, before = [], 0, None
    for r in sorted(ranges, key=lambda r: r.part):
        level = level if before is not None and r.first == before.last else 0
        out.append((r.part, level))
        opened = level if r.one else 0
        level = opened + r.last_sum - min(0, opened + r.last_low)
        before = r
    return out


def paired(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """key, start_id, end_id, start_at, end_at: a row for each pair, for each start without end and each end without start.

    ``events`` has key, at and id. Rows that are neither a start nor an end, or have no key or time, take no part; one that is both
    is a start. Of equal times the smaller id comes first; ids tell rows of a key apart. A key's rows may lie in any number of tasks.
    """
    spark = events.sparkSession
    order = [F.col("key"), F.col("at"), F.col("id")]
    step = F.when(start, 1).when(end, -1)
    rows = events.select("key", "at", "id", step.cast("int").alias("step")).filter("step is not null and key is not null and at is not null")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "brackets")

    own = W.partitionBy("part", "key").orderBy("at", "id")
    summed = rows.withColumn("sum", F.sum("step").over(own.rowsBetween(W.unboundedPreceding, W.currentRow)))
    by_key = summed.groupBy("part", "key").agg(F.sum("step").alias("s"), F.min("sum").alias("low"))
    state = F.struct("key", "s", "low")
    # One row for each range, as many as there are shuffle partitions.
    ranges = by_key.groupBy("part").agg(F.min(state).alias("a"), F.max(state).alias("b")).select("part", F.col("a.key").alias("first"), F.col("b.key").alias("last"), (F.col("a.key") == F.col("b.key")).alias("one"), F.col("b.s").alias("last_sum"), F.col("b.low").alias("last_low"), F.col("a.key").alias("key"))
    found = ranges.collect()
    first = spark.createDataFrame([(r.part, r.key, c) for r, (_, c) in zip(sorted(found, key=lambda r: r.part), _carries(found), strict=True)], f"part int, key {events.schema['key'].dataType.simpleString()}, carry long")

    total = F.col("sum") + F.coalesce("carry", F.lit(0))
    low = F.min("total").over(own.rowsBetween(W.unboundedPreceding, W.currentRow))
    before = F.coalesce(F.min("total").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = summed.join(F.broadcast(first), ["part", "key"], "left").withColumn("total", total)
    placed = placed.withColumn("low", F.least(F.lit(0), low)).withColumn("stray", (F.col("step") < 0) & (F.col("total") < F.least(F.lit(0), before)))
    # The level that a start opens, and an end closes.
    placed = placed.withColumn("level", F.col("total") - F.col("low") + F.when(F.col("step") < 0, 1).otherwise(0)).drop("sum", "carry", "total", "low")

    def meet(df: DataFrame, *by: str) -> DataFrame:
        """Adds ``other``, for an end the start right before it, and ``closed``, for a start whether an end comes right after it."""
        near = W.partitionBy(*by, "stray", "key", "level").orderBy("at", "id")
        prior = F.lag(F.struct("step", "id", "at")).over(near)
        mate = F.when((F.col("step") < 0) & ~F.col("stray") & (prior["step"] > 0), F.struct(prior["id"].alias("id"), prior["at"].alias("at")))
        return df.withColumn("other", mate).withColumn("closed", F.coalesce((F.col("step") > 0) & (F.lead("step").over(near) < 0), F.lit(False)))

    near = materialize(meet(placed, "part"), "brackets")
    pair = [F.col("key"), F.col("other.id").alias("start_id"), F.col("id").alias("end_id"), F.col("other.at").alias("start_at"), F.col("at").alias("end_at")]
    inside = near.filter("other is not null").select(*pair)
    stray = near.filter("stray").select("key", F.lit(None).cast(rows.schema["id"].dataType).alias("start_id"), F.col("id").alias("end_id"), F.lit(None).cast(rows.schema["at"].dataType).alias("start_at"), F.col("at").alias("end_at"))
    # Of each range and key at most one row for each level that is open at its ends.
    left = meet(near.filter("other is null and not closed and not stray").drop("other", "closed"))
    across = left.filter("other is not null").select(*pair)
    open_ = left.filter("step > 0 and not closed").select("key", F.col("id").alias("start_id"), F.lit(None).cast(rows.schema["id"].dataType).alias("end_id"), F.col("at").alias("start_at"), F.lit(None).cast(rows.schema["at"].dataType).alias("end_at"))
    return inside.unionByName(across).unionByName(stray).unionByName(open_)
