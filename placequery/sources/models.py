"""Choice and storage of fitted vocabularies and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .results import _stored

# The domain each dataset's vocabulary is fitted on.
DOMAINS = {
    "17places": "indoor",
    "baidu": "indoor",
    "pitts": "urban",
    "mslsSF": "urban",
    "mslsCPH": "urban",
    "SFXL": "urban",
    "AmsterTime": "urban",
    "InsideOut": "urban",
    "VPAir": "aerial",
}


def model_key(kind: str, dataset: str, vocab: str = "domain", finetuned: bool = False) -> str:
    """Key of a stored model: per domain or per dataset ("map")."""
    if vocab not in ("domain", "map"):
        raise ValueError(f"unknown vocabulary choice: {vocab}")
    scope = DOMAINS.get(dataset, dataset) if vocab == "domain" else dataset
    return "_".join([kind, scope] + (["finetuned"] if finetuned else []))


def resolve_model(
    spark: SparkSession, path: str, kind: str, dataset: str, fit, rows: int | None = None,
    vocab: str = "domain", finetuned: bool = False,
) -> DataFrame:
    """Stored model of the key, or ``fit()`` stored under it; ``rows`` is asserted."""
    key = model_key(kind, dataset, vocab, finetuned)
    stored = _stored(spark, path)
    found = None if stored is None else stored.where(F.col("model_key") == key)
    if found is None or found.isEmpty():
        fit().withColumn("model_key", F.lit(key)).write.mode("append").partitionBy("model_key").parquet(path)
        found = spark.read.parquet(path).where(F.col("model_key") == key)
    if rows is not None:
        n = found.count()
        if n != rows:
            raise ValueError(f"model {key} has {n} rows, expected {rows}")
    return found
