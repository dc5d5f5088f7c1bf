"""Pyramids and tiles of pixels, and a search from the coarsest level on that reads the next one for open pairs only.

Pictures are rows of id, width, height and pixels (row by row, whole numbers). All of it is expressions of arrays inside the
JVM; a picture is a row, so one that does not fit a task is to be cut in tiles before it becomes one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.distances import bit_distance
from kinfold.session import materialize, scratch


def _halved(pixels: Column, width: Column, height: Column, to_width: Column, to_height: Column) -> Column:
    """Means of 2 x 2 pixels, halves rounded up; at an odd rim the last pixel counts twice."""

    def mean(i: Column) -> Column:
        x, y = (i % to_width) * 2, F.floor(i / to_width) * 2
        x0, y0 = F.least(x, width - 1), F.least(y, height - 1)
        x1, y1 = F.least(x + 1, width - 1), F.least(y + 1, height - 1)
        at = lambda u, v: F.get(pixels, (v * width + u).cast("int"))
        return F.floor((at(x0, y0) + at(x1, y0) + at(x0, y1) + at(x1, y1) + 2) / 4).cast("int")

    return F.transform(F.sequence(F.lit(0), to_width * to_height - 1), mean)


def levels(pictures: DataFrame, most: int = 5, least_side: int = 32) -> DataFrame:
    """id, level, width, height, pixels: the picture (level ``most`` - 1) and its halvings down to level 0.

    A side never goes below ``least_side`` (sides that are smaller stay), and a level in which both would be so small is not
    built; the picture itself always is. Pictures that are null, without pixels, or with fewer or more than width * height, have no levels.
    """
    whole = (F.col("width") > 0) & (F.col("height") > 0) & (F.size("pixels") == F.col("width") * F.col("height"))
    now = pictures.filter(whole).select("id", F.lit(most - 1).alias("level"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.col("pixels").cast("array<int>").alias("pixels"))
    out = now
    half = lambda c: F.least(F.col(c), F.greatest(F.lit(least_side), F.floor((F.col(c) + 1) / 2).cast("int")))
    for level in range(most - 2, -1, -1):
        sized = now.withColumn("w", half("width")).withColumn("h", half("height")).filter((F.col("w") > least_side) | (F.col("h") > least_side))
        # New names first: inside a lambda an alias of the same select would hide the column.
        sized = sized.withColumn("p", _halved(F.col("pixels"), F.col("width"), F.col("height"), F.col("w"), F.col("h")))
        now = sized.select("id", F.lit(level).alias("level"), F.col("w").alias("width"), F.col("h").alias("height"), F.col("p").alias("pixels"))
        out = out.unionByName(now)
    return out


def tiles(pictures: DataFrame, side: int = 256, overlap: int = 16) -> DataFrame:
    """id, x, y, width, height, pixels of the tiles of each picture; neighbours share ``overlap`` pixels, those at the rim are smaller."""
    step = side - overlap
    places = pictures.filter("width > 0 and height > 0 and size(pixels) = width * height")
    for c, n in (("x", "width"), ("y", "height")):
        places = places.withColumn(c, F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1, F.lit(step))))
    wide, high = (F.least(F.lit(side), F.col(n).cast("int") - F.col(c)) for n, c in (("width", "x"), ("height", "y")))
    rows = F.transform(F.sequence(F.col("y"), F.col("y") + high - 1), lambda r: F.slice("pixels", (r * F.col("width") + F.col("x") + 1).cast("int"), wide))
    return places.withColumn("p", F.flatten(rows)).select("id", "x", "y", wide.alias("width"), high.alias("height"), F.col("p").alias("pixels"))


def digest(pixels: Column) -> Column:
    return F.sha2(F.array_join(pixels, ","), 256)


def segmented(cut: DataFrame) -> DataFrame:
    """id, tiles, digest: the hash of the hashes of a picture's tiles, row by row. A picture's hashes are 64 characters a tile."""
    hashed = cut.select("id", "x", "y", digest(F.col("pixels")).alias("digest"))
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "digest")))
    return hashed.groupBy("id").agg(ordered.alias("t")).select("id", F.size("t").alias("tiles"), F.sha2(F.array_join(F.transform("t", lambda t: t["digest"]), ""), 256).alias("digest"))


def search(pairs: DataFrame, hashed: DataFrame, threshold: float, margin: float = 5.0) -> DataFrame:
    """a, b, level, similarity, passes: each pair at the level that decides it.

    ``pairs``: a, b. ``hashed``: id, level (0 is the coarsest), bits (how many), hash (long); once for each id and level. A level rejects
    below threshold * (0.7 + 0.3 * level / last), accepts above threshold + margin, and the last one accepts what it does not
    reject; with one level its threshold is the threshold. Both must have a level for it to say something: a pair without
    any is not similar (level and similarity null), one whose finer levels are missing passes by the last it has. Only open
    pairs go on, written between levels. Repeated pairs are one.
    """
    with scratch(pairs.sparkSession):
        # One number for each level.
        known = sorted(r.level for r in hashed.select("level").distinct().collect())
        last = known[-1] if known else 0
        nothing = [F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("similarity")]
        left, decided = materialize(pairs.select("a", "b").distinct().select("a", "b", *nothing), "open"), None
        for level in known:
            here = hashed.filter(F.col("level") == level)
            one = here.select(F.col("id").alias("a"), F.col("hash").alias("x"), F.col("bits").alias("n"))
            other = here.select(F.col("id").alias("b"), F.col("hash").alias("y"))
            met = left.join(one, "a", "left").join(other, "b", "left")
            value = 100 * (1 - bit_distance(F.col("x"), F.col("y")) / F.col("n"))
            least = threshold * (0.7 + 0.3 * level / last) if len(known) > 1 else threshold
            there = F.col("x").isNotNull() & F.col("y").isNotNull()
            verdict = F.when(there & (value < least), F.lit(False)).when(there & ((value > threshold + margin) | F.lit(level == last)), F.lit(True))
            seen = met.select("a", "b", F.when(there, F.lit(level)).otherwise(F.col("level")).alias("level"), F.when(there, value).otherwise(F.col("similarity")).alias("similarity"), verdict.alias("passes"))
            seen = materialize(seen, "seen")
            done = seen.filter("passes is not null")
            decided = done if decided is None else decided.unionByName(done)
            left = seen.filter("passes is null").drop("passes")
        rest = left.withColumn("passes", F.col("level").isNotNull())
        return materialize(rest if decided is None else decided.unionByName(rest), "verdicts", outlive=True)
