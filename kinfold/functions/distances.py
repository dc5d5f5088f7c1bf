"""Distances and similarities of hashes and vectors, as Columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_distance(a: Column, b: Column) -> Column:
    """Hamming distance of two longs."""
    return F.bit_count(a.bitwiseXOR(b))


def hex_distance(a: Column, b: Column) -> Column:
    """Hamming distance of two hexadecimal hashes; the shorter is filled with zeros on the left. 32 digits at most."""
    parts = []
    for i in range(4):
        half = lambda c, i=i: F.conv(F.substring(F.lpad(c, 32, "0"), 8 * i + 1, 8), 16, 10).cast("long")
        parts.append(bit_distance(half(a), half(b)))
    return parts[0] + parts[1] + parts[2] + parts[3]


def binary_distance(a: Column, b: Column) -> Column:
    """Hamming distance of two strings of 0 and 1, and the difference of their lengths."""
    both = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x.isNotNull() & y.isNotNull() & (x != y), 1).otherwise(0))
    return F.aggregate(both, F.lit(0), lambda s, x: s + x) + F.abs(F.length(a) - F.length(b))


def binary_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return (longest - binary_distance(a, b)) / longest * 100


def character_similarity(a: Column, b: Column) -> Column:
    """Share of equal characters at equal places, in percent."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return same / F.greatest(F.length(a), F.length(b)) * 100


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the parts that are there, by their weights; null if none is."""
    total = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts), F.lit(0.0))
    value = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return value / F.nullif(total, F.lit(0.0))


def hash_distance(a: Column, d: Column, p: Column) -> Column:
    """Weighted mean of the distances of average, difference and block hashes."""
    return weighted([(a, 0.25), (d, 0.35), (p, 0.40)])


def hash_similarity(a: Column, d: Column, p: Column, bits: tuple[int, int, int] = (64, 56, 64), normalized: bool = False) -> Column:
    """100 (1 - mean distance / all bits), as the original has it; ``normalized`` takes the mean of the bits instead."""
    present = [(F.when(c.isNotNull(), F.lit(n)).otherwise(0), w, c) for c, n, w in zip((a, d, p), bits, (0.25, 0.35, 0.40), strict=True)]
    length = present[0][0] + present[1][0] + present[2][0]
    if normalized:
        length = weighted([(F.when(c.isNotNull(), F.lit(float(n))), w) for c, n, w in zip((a, d, p), bits, (0.25, 0.35, 0.40), strict=True)])
    value = 100 * (1 - hash_distance(a, d, p) / length)
    return F.when(value.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)))


def hash_vote(a: Column, d: Column, p: Column) -> Column:
    """Similarity p .5, d .3, a .2, each 100 - distance * 100 / 64, rounded."""
    part = lambda c: 100 - c * 100.0 / 64
    return F.coalesce(F.floor(weighted([(part(p), 0.5), (part(d), 0.3), (part(a), 0.2)]) + 0.5), F.lit(0)).cast("int")


def weighted_similarity(a: Column, d: Column, p: Column, bits: tuple[int, int, int] = (64, 56, 64)) -> Column:
    """Mean of the similarities of the hashes that are there, block and difference hash .4 each, average hash .2; 0 without any."""
    parts = [(100 * (1 - c / n), w) for c, n, w in zip((a, d, p), bits, (0.2, 0.4, 0.4), strict=True)]
    return F.coalesce(weighted(parts), F.lit(0.0))


def adjusted_similarity(similarity: Column, brightness: tuple[Column, Column], contrast: tuple[Column, Column]) -> Column:
    return similarity * 0.7 + (100 - F.abs(brightness[0] - brightness[1])) * 0.15 + (100 - F.abs(contrast[0] - contrast[1])) * 0.15


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Signed cosine; 0 for a zero vector."""
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def dots(a: Column, b: Column) -> Column:
    """``dot`` of many pairs, in whole columns; it adds in the same order, so that the values are the same."""

    @F.arrow_udf("double")
    def added(x: pa.Array, y: pa.Array) -> pa.Array:
        out = np.full(len(x), np.nan)
        size = np.where(x.is_valid(), x.value_lengths().fill_null(0), -1)
        same = (size == np.where(y.is_valid(), y.value_lengths().fill_null(0), -1)) & (size >= 0)
        for n in np.unique(size[same]):
            at = np.flatnonzero(same & (size == n))
            u, v = (c.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n).T.copy() for c in (x, y))
            total = np.zeros(len(at))
            for i in range(n):
                total += u[i] * v[i]
            out[at] = total
        return pa.array(out, mask=~same)

    return added(a, b)


def clamped_cosine(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def mapped_cosine(c: Column) -> Column:
    return (c + 1) / 2


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def distance_similarity(distance: Column, most: float) -> Column:
    return 100 * F.exp(-distance / most)


def neighbour_similarity(distance: Column, farthest: Column) -> Column:
    """1 at no distance, 0 at the farthest neighbour, a bell between."""
    return F.when(distance == 0, 1.0).when(distance >= farthest, 0.0).otherwise(F.exp(-5 * (distance / farthest) * (distance / farthest)))


def fusion(low: Column, mid: Column, high: Column) -> Column:
    """Similarity and method from three levels, .3, .3 and .4; the share of missing levels goes to the others in equal parts."""
    weights = [(low, 0.3), (mid, 0.3), (high, 0.4)]
    there = [c.isNotNull() for c, _ in weights]
    n = sum((t.cast("int") for t in there), F.lit(0))
    unused = sum((F.when(t, 0.0).otherwise(w) for t, (_, w) in zip(there, weights, strict=True)), F.lit(0.0))
    final = [F.when(t, F.lit(w) + unused / F.nullif(n, F.lit(0))).otherwise(F.lit(0.0)) for t, (_, w) in zip(there, weights, strict=True)]
    value = sum((F.coalesce(c, F.lit(0.0)) * w for (c, _), w in zip(weights, final, strict=True)), F.lit(0.0))
    only = lambda i: there[i] & (n == 1)
    method = F.when(only(0), "hash").when(only(1), "color_texture").when(only(2), "deep_learning").otherwise("fusion")
    return F.struct((F.floor(value * 10 + 0.5) / 10).alias("similarity"), method.alias("method"))


def mid_level(colour: Column, texture: Column) -> Column:
    """Colour .6 and texture .4 in percent, or the one that is there."""
    return F.when(colour.isNotNull() & texture.isNotNull(), colour * 0.6 + texture * 0.4).otherwise(F.coalesce(colour, texture))


def cascade(feature: Column, hashes: Column, raw: Column, threshold: float) -> Column:
    """Similarity and method: feature and hash where the feature is near enough, else feature, hash, raw vector or none."""
    near = feature.isNotNull() & (feature >= 0.7 * threshold) & hashes.isNotNull()
    value = F.when(near, feature * 0.6 + hashes * 0.4).otherwise(F.coalesce(feature, hashes, raw, F.lit(0.0)))
    method = F.when(near, "combined").when(feature.isNotNull(), "feature").when(hashes.isNotNull(), "hash").when(raw.isNotNull(), "raw_feature").otherwise("none")
    return F.struct(value.alias("similarity"), method.alias("method"))


def coarse_to_fine(levels: list[Column], threshold: float, margin: float = 5.0) -> Column:
    """Whether a pair passes its levels, coarsest first: a level below its threshold rejects, one above it by the margin accepts."""
    n = len(levels)
    out = F.lit(True)
    for i in reversed(range(n)):
        least = threshold * (0.7 + 0.3 * i / (n - 1)) if n > 1 else threshold
        out = F.when(levels[i] < least, F.lit(False)).when(levels[i] > least + margin, F.lit(True)).otherwise(out)
    return out


def level_mask(low: Column, mid: Column, high: Column) -> Column:
    return F.when(low.isNotNull(), 1).otherwise(0).bitwiseOR(F.when(mid.isNotNull(), 2).otherwise(0)).bitwiseOR(F.when(high.isNotNull(), 4).otherwise(0))


def at_level(level: str, a: Column, d: Column, p: Column, feature: Column, raw: Column, threshold: float, bits: tuple[int, int, int] = (64, 56, 64)) -> Column:
    """Similarity and method at a level of care, from distances of hashes (null: missing), the similarity of reduced vectors and of whole ones.

    basic: the block hash; standard and advanced: all hashes by weight; professional: the reduced vectors, with the hashes where
    they are similar enough, else as advanced. What a level lacks is made up by the first hash there is (block, difference,
    average), then by whole vectors; without any, 0.
    """
    if level not in ("basic", "standard", "advanced", "professional"):
        raise ValueError(f"no such level: {level}")
    share = lambda c, n: F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (1 - c / n)))
    result = lambda value, name: F.struct(value.cast("double").alias("similarity"), F.lit(name).alias("method"))
    fallback = F.coalesce(*[F.when(c.isNotNull(), result(share(c, n), "fallback_hash")) for c, n in ((p, bits[2]), (d, bits[1]), (a, bits[0]))], F.when(raw.isNotNull(), result(raw, "fallback_feature")), result(F.lit(0.0), "no_data"))
    if level == "basic":
        return F.coalesce(F.when(p.isNotNull(), result(share(p, bits[2]), "basic_hash")), fallback)
    some = a.isNotNull() | d.isNotNull() | p.isNotNull()
    hashes = hash_similarity(a, d, p, bits)
    by_hash = F.coalesce(F.when(some, result(hashes, "weighted_hash" if level == "standard" else "advanced_hash")), fallback)
    if level != "professional":
        return by_hash
    near = feature >= 0.7 * threshold
    return F.when(near & some, result(feature * 0.6 + hashes * 0.4, "feature_and_hash")).when(near, result(feature, "feature_only")).when(feature.isNotNull(), result(feature, "feature_only_low")).otherwise(by_hash)
