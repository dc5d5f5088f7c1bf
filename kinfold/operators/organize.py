"""What stays, what goes and how it is called: plans and reports from groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions import rules
from kinfold.operators.ordering import running


def best_members(groups: DataFrame, items: DataFrame) -> DataFrame:
    """leader, best, size: the member of the highest quality, then the longest, then the first. ``groups``: leader, member
    (leaders among the members); ``items``: id, quality, n_chars."""
    scored = groups.join(items, F.col("member") == F.col("id"))
    rank = F.struct(F.coalesce("quality", F.lit(0)).alias("q"), F.coalesce("n_chars", F.lit(0)).alias("n"), (-F.col("id")).alias("i"))
    return scored.groupBy("leader").agg(F.max_by("id", rank).alias("best"), F.count("*").alias("size"))


def whole_groups(groups: DataFrame) -> DataFrame:
    """``groups`` with each leader as a member of its own group."""
    return groups.select("leader", "member").unionByName(groups.select("leader", F.col("leader").alias("member")).distinct())


def actions(items: DataFrame, groups: DataFrame, best: DataFrame) -> DataFrame:
    """id, action (keep, delete), leader: the best of every group and items without one stay."""
    placed = whole_groups(groups).join(best.select("leader", "best"), "leader").select(F.col("member").alias("id"), "leader", "best")
    return items.select("id").join(placed, "id", "left").select("id", F.when(F.col("leader").isNull() | (F.col("id") == F.col("best")), "keep").otherwise("delete").alias("action"), "leader")


def renames(items: DataFrame, acted: DataFrame) -> DataFrame:
    """id, number, new_name: kept items, those of groups first in the order of their leaders. ``items``: id, name, taken."""
    kept = acted.filter("action = 'keep'").join(items, "id").withColumn("lone", F.col("leader").isNull()).withColumn("place", F.coalesce("leader", "id"))
    numbered = running(kept, [F.col("lone"), F.col("place"), F.col("id")])
    return numbered.select("id", F.col("row_no").cast("long").alias("number"), rules.new_name(F.col("taken"), F.col("row_no"), F.col("name")).alias("new_name"))


def report(acted: DataFrame, best: DataFrame, names: DataFrame) -> DataFrame:
    """leader, report: a JSON object for each group, with its size and the name of its best item."""
    named = best.join(names.select(F.col("id").alias("best"), "name"), "best", "left")
    body = F.to_json(F.struct(F.col("leader").alias("group"), F.col("size").alias("count"), F.coalesce("name", F.lit("Unknown")).alias("best")))
    return named.select("leader", body.alias("report"))


def summary(items: DataFrame, best: DataFrame) -> DataFrame:
    """total, duplicates, kept and percent of duplicates, rounded."""
    total = items.agg(F.count("*").alias("total"))
    extra = best.agg(F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("duplicates"), F.count("*").alias("groups"))
    # Two rows of one.
    both = total.withColumn("k", F.lit(1)).join(extra.withColumn("k", F.lit(1)), "k").drop("k")
    return both.select("total", "duplicates", (F.col("total") - F.col("duplicates")).alias("kept"), "groups", F.floor(F.col("duplicates") * 100.0 / F.nullif("total", F.lit(0)) + 0.5).cast("int").alias("percent"))


def chunks_of_groups(best: DataFrame, size: int) -> DataFrame:
    """leader, chunk: groups stay whole."""
    return running(best.select("leader"), [F.col("leader")]).select("leader", F.floor((F.col("row_no") - 1) / size).alias("chunk"))


def numbered_in_group(groups: DataFrame) -> DataFrame:
    return groups.withColumn("place", F.row_number().over(W.partitionBy("leader").orderBy("member")))


def features_of(wanted: DataFrame, mapping: DataFrame, features: DataFrame) -> DataFrame:
    """id, feature_id and the other columns of ``features`` for each wanted item: one row for each of its features that exist.

    ``wanted``: id; ``mapping``: id, feature_id; ``features``: feature_id and more. Wanted items and links count once however often
    they are listed, items without links and null ids have no rows. The mapping is cut to wanted items before features are met.
    """
    links = mapping.select("id", "feature_id").join(wanted.select("id").distinct(), "id", "left_semi").distinct()
    return links.join(features, "feature_id")
