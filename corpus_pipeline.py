"""The corpus pipeline: five stages of the subpackage llm, from documents to a mix.

Every stage takes (spark, docs, sf_dir), where docs is all that the stage before it kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

Defined cases of every stage: further columns, of any name, are kept as they are by all but the last; an empty table gives an
empty one. Null and empty texts are kept by the quality scorer, the line dedup and the decontamination; of those the n-gram
join keeps one for each id and all without id; the mix takes nothing of them. Null ids come last in every order, a null
source is a source of its own. Repeated rows share a verdict; the n-gram join keeps one of them, and the line dedup takes equal rows for one
document. Ties go to the smaller id, then to the smaller hash of the text. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from kinfold.session import materialize, scratch, table


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer keeps."""
    return quality.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks that an earlier document holds; a document of which nothing is left goes."""
    return line_dedup.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every group of near copies."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the words that the mix takes of it."""
    return mixing.mix(docs)[1]


STAGES = [
    ("quality", drop_bad),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
]

#: The scorer and the alignment are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        # What a stage wrote for itself goes with it; its result stays.
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, outlive=True)
