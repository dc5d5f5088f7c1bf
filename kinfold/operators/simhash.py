"""SimHash of texts, and joins of bit signatures by bands.

A signature is two longs of 32 bits, ``hi`` and ``lo``. Rows with one signature are one class, known by its first id;
pairs are pairs of classes, so that a group of copies makes no pairs within itself.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.distances import bit_distance
from kinfold.session import ship


def simhash(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, hi, lo over the distinct words of each text; a bit is set where more than half of the words have it.

    Row by row, without a shuffle. Texts without words have no signature and are left out.
    """
    ship(df.sparkSession)
    words = F.array_distinct(F.filter(F.split(F.lower(text_col), r"\s+"), lambda w: w != ""))

    @F.arrow_udf("hi long, lo long")
    def fold(column: pa.Array) -> pa.Array:
        # Each distinct word of a batch is hashed once.
        flat, sizes = column.flatten().dictionary_encode(), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = b"".join(md5(w.encode()).digest()[:8] for w in flat.dictionary.to_pylist())
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64)[flat.indices.to_numpy()]
        some, count = sizes > 0, np.zeros((len(sizes), 64), np.int32)
        if some.any():
            count[some] = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.int32)
        votes = count * 2 > sizes[:, None]
        halves = np.packbits(votes, axis=1).view(">u4").astype(np.int64).reshape(-1, 2)
        mask = sizes == 0
        return pa.StructArray.from_arrays([pa.array(halves[:, 0], mask=mask), pa.array(halves[:, 1], mask=mask)], ["hi", "lo"])

    signed = df.select(F.col(id_col).alias("id"), fold(words).alias("s"))
    return signed.select("id", "s.*").filter("hi is not null")


def classes(signatures: DataFrame) -> DataFrame:
    """id (the first of the class), hi, lo, members."""
    return signatures.groupBy("hi", "lo").agg(F.min("id").alias("id"), F.count("*").alias("members")).select("id", "hi", "lo", "members")


def bit_at(i: int) -> Column:
    """Bit i of a signature, 0 to 63, the highest first."""
    c, at = ("hi", 31 - i) if i < 32 else ("lo", 63 - i)
    return F.call_function("shiftright", F.col(c), F.lit(at)).bitwiseAND(1)


def band_cuts(n: int) -> list[tuple[int, int]]:
    """First bit and end of ``n`` bands of nearly equal length."""
    return [(i * 64 // n, (i + 1) * 64 // n) for i in range(n)]


def whole(prefix: str = "") -> Column:
    """The 64 bits of a signature as one long."""
    return F.call_function("shiftleft", F.col(f"{prefix}hi"), F.lit(32)).bitwiseOR(F.col(f"{prefix}lo"))


def low_bits(width: int) -> int:
    """A long whose lower ``width`` bits are set."""
    return (1 << width) - 1 if width < 64 else -1


def band_keys(n: int) -> list[Column]:
    """The 64 bits cut into ``n`` runs of nearly equal length."""
    return [F.call_function("shiftrightunsigned", whole(), F.lit(64 - hi)).bitwiseAND(F.lit(low_bits(hi - lo))).cast("long") for lo, hi in band_cuts(n)]


def bands(n: int) -> Column:
    """An array of (band, key)."""
    return F.array(*[F.struct(F.lit(b).alias("band"), key.alias("key")) for b, key in enumerate(band_keys(n))])


def band_pairs(classes: DataFrame, n: int) -> DataFrame:
    """a, b, distance of the classes that share a band, a < b."""
    keyed = classes.select("id", "hi", "lo", F.explode(bands(n)).alias("k")).select("id", "hi", "lo", "k.band", "k.key")
    left = keyed.select(F.col("id").alias("a"), F.col("hi").alias("ahi"), F.col("lo").alias("alo"), "band", "key")
    right = keyed.select(F.col("id").alias("b"), F.col("hi").alias("bhi"), F.col("lo").alias("blo"), "band", "key")
    distance = bit_distance(F.col("ahi"), F.col("bhi")) + bit_distance(F.col("alo"), F.col("blo"))
    return left.join(right, ["band", "key"]).filter("a < b").select("a", "b", distance.alias("distance")).distinct()


def near_pairs(classes: DataFrame, most: int) -> DataFrame:
    """a, b, distance of all pairs of classes at a Hamming distance of ``most`` or less, a < b."""
    from kinfold.operators.radius import pairs

    return pairs(classes.select("id", "hi", "lo"), most)


def band_stats(classes: DataFrame, n: int) -> DataFrame:
    """band, buckets, average and largest bucket."""
    buckets = classes.select(F.explode(bands(n)).alias("k")).groupBy("k.band", "k.key").count()
    return buckets.groupBy("band").agg(F.count("*").alias("buckets"), F.avg("count").alias("mean_size"), F.max("count").alias("max_size"))
