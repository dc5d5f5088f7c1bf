"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import ann, class_lm, decontaminate, filters, line_dedup, mixing, ngram_join, pii, prefix_trie, quality, token_files, toxicity, warc
from kinfold.session import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.digest(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))[1]


def op5_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.digest(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.digest(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.digest(table(spark, sf_dir, "conversations"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_toxicity, op2_ngram_join, op3_pii, op4_source_mix, op5_warc_chunks, op6_nearest, op7_quality, op8_class_lm, op9_decontaminate, op10_line_dedup, op11_filter_audit, op12_prefix_trie, op13_token_files)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_join": ngram_join.ORACLE_SQL,
        "op4_source_mix": mixing.ORACLE_SQL,
        "op5_warc_chunks": warc.ORACLE_SQL,
        "op9_decontaminate": decontaminate.ORACLE_SQL,
        "op11_filter_audit": filters.ORACLE_SQL,
        "op12_prefix_trie": prefix_trie.ORACLE_SQL,
    }
