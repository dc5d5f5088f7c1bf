"""Greedy leader clustering, in rounds.

Visited in order, an item leads unless an earlier leader is its neighbour. That makes the leaders the
lexicographically first maximal independent set, found in parallel: an undecided item without undecided neighbours
before it leads, items behind a new leader are covered, and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.session import materialize


def leaders(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """id of the leaders among the nodes of ``edges`` (a, b; a stands before b)."""
    left = materialize(edges.select("a", "b").distinct(), "undecided")
    found = None
    lone = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    for _ in range(rounds):
        # Items with no undecided neighbour before them; those without one after them were found already.
        new = materialize(lone.withColumnRenamed("a", "id"), "leaders")
        found = new if found is None else found.unionByName(new)
        covered = left.join(new.withColumnRenamed("id", "a"), "a", "left_semi").select("b").distinct()
        gone = materialize(new.select("id").unionByName(covered.withColumnRenamed("b", "id")), "decided")
        every = left.select(F.col("a").alias("id")).union(left.select(F.col("b").alias("id"))).distinct()
        undecided = every.join(gone, "id", "left_anti")
        rest = left.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b")
        undecided = materialize(undecided, "open")
        if not undecided.limit(1).count():
            return found.distinct()
        left = materialize(rest, "undecided")
        lone = undecided.withColumnRenamed("id", "a").join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    raise RuntimeError(f"leaders did not settle in {rounds} rounds")


def disjoint_groups(edges: DataFrame) -> DataFrame:
    """leader, member: each covered item with its first leader. ``edges``: a, b, a before b."""
    first = leaders(edges).withColumnRenamed("id", "a")
    inside = edges.join(first, "a", "left_semi").join(first.withColumnRenamed("a", "b"), "b", "left_anti")
    return inside.groupBy(F.col("b").alias("member")).agg(F.min("a").alias("leader")).select("leader", "member")


def overlapping_groups(edges: DataFrame) -> DataFrame:
    """leader, member: each leader with all its neighbours, those of other groups too."""
    first = leaders(edges).withColumnRenamed("id", "leader")
    both = edges.select(F.col("a").alias("leader"), F.col("b").alias("member")).unionByName(edges.select(F.col("b").alias("leader"), F.col("a").alias("member")))
    return both.join(first, "leader", "left_semi").distinct()
