"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.session import materialize, scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: larger neighbours of u go to u's least neighbour. Small: u and its smaller neighbours do."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("w"))
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return moved.filter("a > b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of ``edges`` (a, b long); the root is the least node of its component and not listed itself.

    Each round is two aggregates and two joins on narrow rows, written to the shared folder; a few rounds do for stars,
    the logarithm of the longest path at most. It ends when a round changes no edge. Loops and repeated edges do no harm;
    no edges, no rows.
    """
    spark = edges.sparkSession
    with scratch(spark):
        now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        now = materialize(now, "edges")
        for _ in range(rounds):
            before, now = now, materialize(_star(_star(now, True), False), "edges")
            # Edges are distinct, so sets of one size without a new edge are equal.
            if before.count() == now.count() and not now.join(before, ["a", "b"], "left_anti").limit(1).count():
                return materialize(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "components", outlive=True)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
