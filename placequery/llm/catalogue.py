"""Registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    archives, bit_clusters, bpe, decontamination, embedding_join, infilling, jaccard_join, main_text, maxent, prefix_counts,
    quality, token_files, url_filters,
)
from .common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.page_verdicts(table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.page_texts(table(spark, sf_dir, "pages"))


def op4_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.token_counts(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(table(spark, sf_dir, "pages"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"), percent=90, width=3)


def op11_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.digests(table(spark, sf_dir, "documents"))


def op12_bit_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_clusters.clusters(table(spark, sf_dir, "embeddings"))


def op13_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scored(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_quality, op3_main_text, op4_embedding_join, op5_bpe, op6_token_files, op7_token_counts,
        op8_decontamination, op9_warc, op10_jaccard_join, op11_infilling, op12_bit_clusters,
        op13_maxent,
    )
}
ORACLES: dict[str, str] = {
    "op1_url_filters": url_filters.VERDICTS_SQL,
    "op9_warc": archives.ROUND_TRIP_SQL,
}
