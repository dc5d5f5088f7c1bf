"""All pairs of 64-bit signatures within a Hamming radius, by multi-index hashing.

The bits are cut into bands, and the radius is spread over them: two signatures within ``most`` bits differ by no more than
``radii(most, bands)[i]`` bits in some band i, for if every band had one more, the sum would exceed ``most``. One side is stored
under its own key of every band, the other asks for all keys within the band's radius. Wide bands make few candidates and many
questions; how many bands there are is decided by what the keys of the stored side say, and never changes the result.

A pair is kept in the first band that qualifies, so that no duplicates arise and nothing has to be made distinct. A key with
more than ``HOT`` stored rows is split by id, and questions go to all of its parts.

Signatures are two longs of 32 bits, ``hi`` and ``lo``, as in ``simhash``.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.distances import bit_distance
from kinfold.operators.simhash import band_cuts, band_keys, bands, low_bits, whole
from kinfold.session import materialize

#: Numbers of bands to choose from: 32, 21, 16 and 9 bits of a key.
CHOICES = (2, 3, 4, 7)
#: Most keys that one row asks for.
MOST_PROBES = 8192
#: Stored rows of a key from which it is split, and most split keys that are broadcast.
HOT, MOST_HOT = 4096, 200_000


def radii(most: int, n: int) -> list[int]:
    """Bits by which each of ``n`` bands may differ; -1 where a band need not be asked at all."""
    return [(most + 1) // n - 1 + (i < (most + 1) % n) for i in range(n)]


def masks(width: int, radius: int) -> list[int]:
    """All changes of up to ``radius`` of ``width`` bits, none first."""
    return [sum(1 << b for b in at) for r in range(radius + 1) for at in combinations(range(width), r)]


def probes(most: int, n: int) -> int:
    """Keys that a row asks for with ``n`` bands."""
    cuts = band_cuts(n)
    return sum(comb(hi - lo, r) for (lo, hi), radius in zip(cuts, radii(most, n), strict=True) for r in range(radius + 1))


def choose(stored: DataFrame, asking: int, most: int, choices: tuple[int, ...] = CHOICES) -> int:
    """The number of bands with the fewest keys and candidates.

    Candidates under a row's own key are counted from the keys of ``stored``, those under the other keys are taken to lie evenly.
    """
    fit = [n for n in choices if n <= most + 1 and probes(most, n) <= MOST_PROBES] or [most + 1]
    if len(fit) == 1:
        return fit[0]
    every = [F.struct(F.lit(n).alias("n"), F.lit(b).alias("band"), key.alias("key")) for n in fit for b, key in enumerate(band_keys(n))]
    sizes = stored.select(F.explode(F.array(*every)).alias("k")).groupBy("k.n", "k.band", "k.key").agg(F.count("*").alias("rows"))
    # One row for each number of bands.
    same = {r.n: (r.same, r.rows) for r in sizes.groupBy("n").agg(F.sum(F.col("rows").cast("double") * F.col("rows")).alias("same"), (F.sum("rows") / F.col("n")).alias("rows")).collect()}
    total = max((rows for _, rows in same.values()), default=0)

    def cost(n: int) -> float:
        own = same.get(n, (0, 0))[0] * asking / max(1, total)
        other = sum((len(masks(hi - lo, r)) - 1) * asking * total / 2 ** (hi - lo) for (lo, hi), r in zip(band_cuts(n), radii(most, n), strict=True) if r > 0)
        return asking * probes(most, n) + total * n + own + other

    return min(fit, key=cost)


def _band_distance(lo: int, hi: int) -> Column:
    """Bits of a band in which the signatures a and b differ."""
    differ = whole("a_").bitwiseXOR(whole("b_"))
    return F.bit_count(F.call_function("shiftrightunsigned", differ, F.lit(64 - hi)).bitwiseAND(F.lit(low_bits(hi - lo))))


def candidates(asking: DataFrame, stored: DataFrame, most: int, n: int, hot: int = HOT) -> DataFrame:
    """a, b, distance and the band of every question that met a stored row; both sides: id, hi, lo."""
    spread = radii(most, n)
    asked = [i for i in range(n) if spread[i] >= 0]
    keyed = stored.select("id", "hi", "lo", F.explode(bands(n)).alias("k")).filter(F.col("k.band").isin(asked))
    keyed = keyed.select(F.col("id").alias("b"), F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"), "k.band", "k.key")
    changes = F.array(*[F.lit(masks(hi - lo, max(0, r))) for (lo, hi), r in zip(band_cuts(n), spread, strict=True)])
    asks = asking.select("id", "hi", "lo", F.explode(bands(n)).alias("k")).filter(F.col("k.band").isin(asked))
    asks = asks.select(F.col("id").alias("a"), F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"), F.col("k.band").alias("band"), F.col("k.key").alias("own"), F.explode(F.element_at(changes, F.col("k.band") + 1)).alias("change"))
    asks = asks.select("a", "a_hi", "a_lo", "band", F.col("own").bitwiseXOR(F.col("change").cast("long")).alias("key"))
    many = materialize(keyed.groupBy("band", "key").agg(F.count("*").alias("rows")).filter(F.col("rows") > hot).select("band", "key", F.ceil(F.col("rows") / hot).cast("int").alias("parts")), "hot")
    on = ["band", "key"]
    some = many.limit(MOST_HOT + 1).count()
    if some:
        many = F.broadcast(many) if some <= MOST_HOT else many
        keyed = keyed.join(many, on, "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("parts"))).cast("int")).drop("parts")
        asks = asks.join(many, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        on = [*on, "part"]
    distance = bit_distance(F.col("a_hi"), F.col("b_hi")) + bit_distance(F.col("a_lo"), F.col("b_lo"))
    # The stored side is hashed in partitions: its size on disk says nothing of how many questions the other side becomes.
    return asks.join(keyed.hint("shuffle_hash"), on).select("a", "b", "band", "a_hi", "a_lo", "b_hi", "b_lo", distance.alias("distance"))


def within(asking: DataFrame, stored: DataFrame, most: int, n: int | None = None, hot: int = HOT) -> DataFrame:
    """a, b, distance of all pairs of an asking and a stored row (id, hi, lo) at a distance of ``most`` or less, each once.

    ids should be unique on each side. The two may be one table; then every row finds itself, and every pair both ways.
    """
    n = n or choose(stored, asking.count(), most)
    return _kept(candidates(asking, stored, most, n, hot), most, n)


def pairs(rows: DataFrame, most: int, n: int | None = None, hot: int = HOT) -> DataFrame:
    """a, b, distance of all pairs of ``rows`` (id, hi, lo) at a distance of ``most`` or less, a < b."""
    n = n or choose(rows, rows.count(), most)
    return _kept(candidates(rows, rows, most, n, hot).filter("a < b"), most, n)


def first_band(most: int, n: int) -> Column:
    """The first band within its radius, of a row of ``candidates``."""
    return F.coalesce(*[F.when(_band_distance(lo, hi) <= r, i) for i, ((lo, hi), r) in enumerate(zip(band_cuts(n), radii(most, n), strict=True)) if r >= 0])


def _kept(found: DataFrame, most: int, n: int) -> DataFrame:
    """Pairs within the radius, in the first of the bands in which they meet."""
    return found.filter((F.col("distance") <= most) & (F.col("band") == first_band(most, n))).select("a", "b", "distance")
