"""Overlapping boxes merged to a fixpoint, as rounds of a spatial join over grids of all sizes.

Merging is confluent: boxes that overlap still do when either has grown, so any order of merges ends at the same boxes. A
round merges what stands together in a batch of the order by item and place; an item that lies within one batch is done.
Boxes of the others, two items a batch at most, grow around all that overlap them. Boxes meet in the cells of a grid as wide as the larger of two, where neither covers more than four.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from kinfold.session import materialize, scratch, ship

SIDES = ["left", "top", "right", "bottom"]


def _closed(sides: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The boxes of one item merged until none overlap: each enters a set of disjoint ones and takes in what it meets."""
    kept, weight, n = np.empty_like(sides), np.empty_like(weights), 0
    for box, w in zip(sides, weights, strict=True):
        box = box.copy()
        while n:
            meets = (kept[:n, 0] < box[2]) & (box[0] < kept[:n, 2]) & (kept[:n, 1] < box[3]) & (box[1] < kept[:n, 3])
            if not meets.any():
                break
            box[:2] = np.minimum(box[:2], kept[:n][meets, :2].min(axis=0))
            box[2:] = np.maximum(box[2:], kept[:n][meets, 2:].max(axis=0))
            w = np.fmax(w, np.fmax.reduce(weight[:n][meets]))
            m = n - int(meets.sum())
            kept[:m], weight[:m], n = kept[:n][~meets], weight[:n][~meets], m
        kept[n], weight[n], n = box, w, n + 1
    return kept[:n], weight[:n]


def _close_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("id")
        sides = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in SIDES], axis=1)
        weights = batch.column("weight").to_numpy(zero_copy_only=False).astype(np.float64)
        # Rows are sorted by id, so an item's rows are a run.
        codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        parts, takes, opens = [], [], []
        for start, end in zip(starts, np.r_[starts[1:], len(codes)], strict=True):
            parts.append(_closed(sides[start:end], weights[start:end]))
            takes.append(np.full(len(parts[-1][0]), start))
            # The first and the last item may have rows elsewhere.
            opens.append(np.full(len(parts[-1][0]), start == 0 or end == len(codes)))
        out = np.concatenate([p[0] for p in parts])
        weight = pa.array(np.concatenate([p[1] for p in parts]), from_pandas=True)
        columns = [ids.take(pa.array(np.concatenate(takes))), *[pa.array(out[:, i]) for i in range(4)], weight, pa.array(np.concatenate(opens))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", *SIDES, "weight", "open"])


def _near_ones_closed(boxes: DataFrame) -> DataFrame:
    """Equal boxes as one; then batches of the order by item and place merged, an item of many boxes over many tasks.

    A column ``open`` tells whether the item may have boxes in other batches.
    """
    single = boxes.groupBy("id", *SIDES).agg(F.max("weight").alias("weight"))
    return single.repartitionByRange("id", "top", "left").sortWithinPartitions("id", "top", "left", "right", "bottom").mapInArrow(_close_batches, StructType([*single.schema.fields, StructField("open", BooleanType())]))


def _cells(level: Column) -> Column:
    """Array of (x, y): the cells of side 2^level that the row's box touches."""
    size = F.pow(F.lit(2.0), level)
    across = F.sequence(F.floor(F.col("left") / size), F.floor(F.col("right") / size))
    down = F.sequence(F.floor(F.col("top") / size), F.floor(F.col("bottom") / size))
    return F.flatten(F.transform(across, lambda x: F.transform(down, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def overlapping(boxes: DataFrame) -> DataFrame:
    """a, b (structs of id, sides and weight): the pairs of different boxes of one item that overlap, a not larger than b.

    A pair is listed once for each cell that both touch, four times at most. ``boxes``: id, left, top, right, bottom, weight.
    """
    box = F.struct("id", *SIDES, "weight")
    leveled = boxes.withColumn("level", F.ceil(F.log2(F.greatest(F.col("right") - F.col("left"), F.col("bottom") - F.col("top")))).cast("int"))
    # One number for each size of boxes, doubled from one to the next.
    levels = sorted(r.level for r in leveled.select("level").distinct().collect())
    at = leveled.select("id", box.alias("b"), "level", F.explode(_cells(F.col("level"))).alias("cell")).select(F.col("id").alias("item"), "b", "level", "cell.*")
    up = F.filter(F.array(*[F.lit(n) for n in levels]).cast("array<int>"), lambda n: n >= F.col("level"))
    looks = leveled.select("id", *SIDES, "weight", box.alias("a"), F.explode(up).alias("level")).select("id", "a", "level", F.explode(_cells(F.col("level"))).alias("cell")).select("id", "a", "level", "cell.*")
    met = looks.join(at, F.col("id").eqNullSafe(F.col("item")) & (looks.level == at.level) & (looks.x == at.x) & (looks.y == at.y))
    same = F.lit(True)
    for side in SIDES:
        same = same & (F.col(f"a.{side}") == F.col(f"b.{side}"))
    crosses = (F.col("a.left") < F.col("b.right")) & (F.col("b.left") < F.col("a.right")) & (F.col("a.top") < F.col("b.bottom")) & (F.col("b.top") < F.col("a.bottom"))
    return met.filter(crosses & ~same).select("a", "b")


def merge_boxes(boxes: DataFrame, rounds: int = 200) -> DataFrame:
    """id, x, y, width, height, weight of the boxes that are left when overlapping ones of an item are one around both, with the
    larger weight, until none overlap.

    ``boxes``: these columns; further ones are dropped. Edges that only touch do not overlap. Rows whose place is null or not
    finite or whose sides are not above zero are no boxes and are left out; a weight that is null or no number is below all others; null ids are an item
    of their own. No boxes, no rows. Equal rows are combined before they travel; an item that holds most boxes is spread by place.
    """
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    wide, high = F.col("width").cast("double"), F.col("height").cast("double")
    sides = boxes.filter((wide > 0) & (high > 0)).select("id", x.alias("left"), y.alias("top"), (x + wide).alias("right"), (y + high).alias("bottom"), F.nanvl(F.col("weight").cast("double"), F.lit(None).cast("double")).alias("weight"))
    for side in SIDES:
        sides = sides.filter(F.abs(F.col(side)) < float("inf"))
    ship(boxes.sparkSession)
    with scratch(boxes.sparkSession):
        closed = materialize(_near_ones_closed(sides), "boxes")
        done = closed.filter("not open").drop("open")
        for _ in range(rounds):
            single = closed.filter("open").groupBy("id", *SIDES).agg(F.max("weight").alias("weight"))
            own = F.struct(*[F.col(c) for c in ["id", *SIDES, "weight"]])
            pairs = overlapping(single)
            both = pairs.select("a", "b").union(pairs.select("b", "a")).union(single.select(own.alias("a"), own.alias("b")))
            grown = both.groupBy(F.col("a.id").alias("id"), *[F.col(f"a.{c}").alias(f"old_{c}") for c in SIDES]).agg(
                *[(F.min if c in ("left", "top") else F.max)(f"b.{c}").alias(c) for c in SIDES], F.max("b.weight").alias("weight")
            )
            grown = materialize(grown, "grown")
            moved = F.lit(False)
            for side in SIDES:
                moved = moved | (F.col(side) != F.col(f"old_{side}"))
            if not grown.filter(moved).limit(1).count():
                out = done.unionByName(single)
                out = out.select("id", F.col("left").alias("x"), F.col("top").alias("y"), (F.col("right") - F.col("left")).alias("width"), (F.col("bottom") - F.col("top")).alias("height"), "weight")
                return materialize(out, "merged", outlive=True)
            closed = materialize(_near_ones_closed(grown.select("id", *SIDES, "weight")), "boxes")
            done = done.unionByName(closed.filter("not open").drop("open"))
    raise RuntimeError(f"boxes did not settle in {rounds} rounds")
