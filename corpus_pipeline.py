"""From raw documents to token ids, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in
the shared folder and reads again as the next stage's documents. A stage's decisions take effect
on all rows that the one before has kept; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placequery.functions.storage import scratch_path
from placequery.llm import bpe, decontamination, jaccard_join, quality
from placequery.llm.common import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, out="_score").where(F.col("_score") >= quality.THRESHOLD).drop("_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), the one of least doc_id."""
    table(spark, sf_dir, "documents")
    return jaccard_join.one_of_each(docs, percent=80, width=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their decoded text of every document."""
    table(spark, sf_dir, "documents")
    coded = bpe.encode_and_decode(docs.select("doc_id", "text"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", to_tokens),
]

# No stage but the join of exact sets can be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
