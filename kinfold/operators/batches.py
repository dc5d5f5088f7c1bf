"""Batches of items, evened out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def evened(tasks: DataFrame, moves: int = 3, ratio: float = 1.3) -> DataFrame:
    """id, batch, cost after moving the costliest item of the heaviest batch to the lightest, a few times.

    Only batch sums and each batch's costliest items, ``moves`` at most, are looked at for the moves.
    """
    order = W.partitionBy("batch").orderBy(F.desc("cost"), "id")
    heads = tasks.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= moves)
    sums = tasks.groupBy("batch").agg(F.sum("cost").alias("total"))
    lightest = sums.orderBy("total", "batch").limit(moves + 1)
    heaviest = sums.orderBy(F.desc("total"), "batch").limit(moves + 1)
    total = {r.batch: r.total for r in lightest.union(heaviest).collect()}
    items: dict[int, list] = {}
    for r in heads.join(F.broadcast(heaviest.select("batch")), "batch").collect():
        items.setdefault(r.batch, []).append((-r.cost, r.id))
    moved = []
    for _ in range(moves if len(total) > 1 else 0):
        top = max(total, key=lambda b: (total[b], -b))
        low = min(total, key=lambda b: (total[b], b))
        if total[top] < total[low] * ratio or not items.get(top):
            break
        cost, item = min(items[top])
        items[top].remove((cost, item))
        items.setdefault(low, []).append((cost, item))
        total[top] += cost
        total[low] -= cost
        moved.append((item, low))
    # A later move of an item replaces the earlier one; a few rows at most.
    target = tasks.sparkSession.createDataFrame(list(dict(moved).items()), "id long, to int")
    return tasks.join(F.broadcast(target), "id", "left").select("id", F.coalesce("to", "batch").alias("batch"), "cost")
