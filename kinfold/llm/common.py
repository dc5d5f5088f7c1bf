"""What several of the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.session import ship

#: Rows of text that go to Python at once; a batch of very long texts is cut further by bytes (tokens.pieces).
TEXT_BATCH = 512
#: Most rows of a side that is broadcast. Beyond it the join shuffles.
BROADCAST_ROWS = 300_000
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"
#: Words as the contracts define them: runs of anything but U+0020 and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_batches(spark: SparkSession) -> None:
    """Make the session fit for Python work on texts: the package on the executors, and batches of few rows."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > TEXT_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH))


def fold(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def crc_mod(id_column: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % m


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has no more than ``most`` rows; reads no further."""
    return df.limit(most + 1).count() <= most


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is not to be broadcast: what Spark takes for its size, that of compressed files, may be far too low."""
    return df.hint("merge")


def sized_join(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts ``right``, a materialised table, only where it has been counted to have ``most`` rows or fewer."""
    return left.join(F.broadcast(right) if small(right, most) else shuffled(right), on, how)
