"""Visual vocabulary: fitting, assignment and residuals."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import map_vectors
from ..functions.vectors import doubles, l2_normalize, mean_vectors

MAX_MODEL_BYTES = 256 << 20


class Vocabulary(NamedTuple):
    """Cluster ids and centroids: K x D numbers, small by construction."""

    clusters: np.ndarray
    centroids: np.ndarray

    @property
    def unit(self) -> np.ndarray:
        return unit_rows(self.centroids)


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=x.astype(float).copy(), where=n > 0)


def load_vocabulary(table: DataFrame, max_bytes: int = MAX_MODEL_BYTES) -> Vocabulary:
    """Read a fitted model; its measured size is checked before any row is fetched."""
    rows, width = table.agg(F.count(F.lit(1)), F.max(F.size("centroid"))).first()
    if not rows:
        raise ValueError("the vocabulary is empty")
    if rows * width * 8 > max_bytes:
        raise ValueError(f"vocabulary of {rows} x {width} exceeds {max_bytes} bytes")
    fetched = sorted(table.select("cluster", doubles("centroid").alias("centroid")).collect())
    return Vocabulary(np.array([r.cluster for r in fetched]), np.array([r.centroid for r in fetched]))


def nearest(x: np.ndarray, vocabulary: Vocabulary, metric: str) -> np.ndarray:
    """Row of the nearest centroid; the lowest cluster id wins ties."""
    if metric == "cosine":
        return np.argmax(x @ vocabulary.unit.T, axis=1)
    if metric == "euclidean":
        c = vocabulary.centroids
        return np.argmin((c * c).sum(1)[None, :] - 2.0 * (x @ c.T), axis=1)
    raise ValueError(f"unknown metric: {metric}")


def assign_cluster(patches: DataFrame, vocabulary: Vocabulary, metric: str = "cosine", vec: str = "embedding") -> DataFrame:
    """Add the nearest cluster of every patch (map-only, one matrix product per batch)."""
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric: {metric}")

    def kernel(x):
        return [vocabulary.clusters[nearest(x, vocabulary, metric)].astype(np.int32)]

    return map_vectors(patches, vec, kernel, "cluster INT")


def assign_residuals(
    patches: DataFrame, vocabulary: Vocabulary, metric: str = "cosine", vec: str = "embedding", normalize: bool = False
) -> DataFrame:
    """Add cluster and residual; normalised centroids decide, raw ones are subtracted (T13)."""

    def kernel(x):
        x = unit_rows(x) if normalize else x
        best = nearest(x, vocabulary, metric)
        return [vocabulary.clusters[best].astype(np.int32), x - vocabulary.centroids[best]]

    return map_vectors(patches, vec, kernel, "cluster INT, residual ARRAY<DOUBLE>")


def residual_vectors(patches: DataFrame, vocabulary: Vocabulary, vec: str = "embedding", normalize: bool = False) -> DataFrame:
    """Residual of every patch to every centroid, concatenated to one K*D vector.

    With ``normalize`` each part is scaled to unit length and then the whole.
    """

    def kernel(x):
        parts = x[:, None, :] - vocabulary.centroids[None, :, :]
        if normalize:
            n = np.linalg.norm(parts, axis=2, keepdims=True)
            parts = np.divide(parts, n, out=np.zeros_like(parts), where=n > 0)
        flat = parts.reshape(len(x), -1)
        return [unit_rows(flat) if normalize else flat]

    return map_vectors(patches, vec, kernel, "residuals ARRAY<DOUBLE>")


def fit_vocabulary(
    patches: DataFrame, k: int = 32, metric: str = "cosine", iterations: int = 100, seed: int = 42,
    vec: str = "embedding", normalize: bool = True,
) -> DataFrame:
    """K-means vocabulary ``(cluster, centroid)``; centroids are raw member means (T13)."""
    v = doubles(vec)
    data = patches.select((l2_normalize(v) if normalize else v).alias("v")).withColumn("features", array_to_vector("v"))
    model = KMeans(k=k, distanceMeasure=metric, maxIter=iterations, seed=seed, featuresCol="features").fit(data)
    labelled = model.transform(data)
    return labelled.groupBy(F.col("prediction").alias("cluster")).agg(mean_vectors(F.col("v")).alias("centroid"))


def lloyd_step(patches: DataFrame, vocabulary: Vocabulary, metric: str = "cosine", vec: str = "embedding") -> DataFrame:
    """One fixed-start k-means iteration: assign, then average per cluster."""
    assigned = assign_cluster(patches, vocabulary, metric, vec)
    return assigned.groupBy("cluster").agg(mean_vectors(F.col(vec)).alias("centroid"), F.count(F.lit(1)).alias("n"))


def quantisation_error(patches: DataFrame, vocabulary: Vocabulary, metric: str = "cosine", vec: str = "embedding") -> DataFrame:
    """Mean squared distance to the assigned centroid."""
    def kernel(x):
        r = x - vocabulary.centroids[nearest(x, vocabulary, metric)]
        return [(r * r).sum(1)]

    return map_vectors(patches.select(vec), vec, kernel, "sq DOUBLE").agg(F.avg("sq").alias("mean_sq"))
