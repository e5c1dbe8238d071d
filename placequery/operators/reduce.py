"""Principal components: fitting, applying and whitening.

A fitted model is a table ``(component INT, axis ARRAY<DOUBLE>, variance DOUBLE)`` plus
one row with component -1 whose axis is the mean.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import map_vectors
from ..functions.vectors import doubles
from . import wide_pca
from .vocabulary import unit_rows

MAX_MODEL_BYTES = 1 << 30
# The driver decomposes a d x d matrix; beyond this width the SVD route is taken.
MAX_COVARIANCE_DIM = 4096
# With fewer rows than dimensions it decomposes a rows x rows matrix, up to so many rows.
MAX_GRAM_ROWS = 2048


class Model(NamedTuple):
    mean: np.ndarray
    axes: np.ndarray
    variance: np.ndarray


def model_table(spark, model: Model) -> DataFrame:
    rows = [(-1, model.mean.tolist(), 0.0)] + [(i, a.tolist(), float(v)) for i, (a, v) in enumerate(zip(model.axes, model.variance))]
    return spark.createDataFrame(rows, "component INT, axis ARRAY<DOUBLE>, variance DOUBLE")


def load_model(table: DataFrame, max_bytes: int = MAX_MODEL_BYTES) -> Model:
    """Fetch a stored model after measuring it; ``wide_pca.apply_table`` applies larger ones unfetched."""
    rows, width = table.agg(F.count(F.lit(1)), F.max(F.size("axis"))).first()
    if rows * width * 8 > max_bytes:
        raise ValueError(f"model of {rows} x {width} exceeds {max_bytes} bytes")
    fetched = sorted(table.select("component", doubles("axis").alias("axis"), "variance").collect())
    if not fetched or fetched[0].component != -1:
        raise ValueError("the model has no mean row")
    return Model(np.array(fetched[0].axis), np.array([r.axis for r in fetched[1:]]), np.array([r.variance for r in fetched[1:]]))


def _signed(axes: np.ndarray) -> np.ndarray:
    """Largest-magnitude entry of every axis positive."""
    peak = np.take_along_axis(axes, np.abs(axes).argmax(axis=1)[:, None], axis=1)
    return axes * np.where(peak < 0, -1.0, 1.0)


def _moments(df: DataFrame, vec: str):
    features = df.select(array_to_vector(doubles(vec)).alias("features"))
    row = features.agg(
        Summarizer.mean(F.col("features")).alias("mean"), Summarizer.variance(F.col("features")).alias("var"), F.count(F.lit(1)).alias("n")
    ).first()
    return features, np.array(row["mean"].toArray()), float(np.sum(row["var"].toArray())), int(row["n"])


def _svd_axes(df: DataFrame, vec: str, mean: np.ndarray, k: int, n: int):
    """Leading axes of the centred rows without forming the d x d covariance.

    The decomposition multiplies through the distributed rows, which also covers the case
    of fewer rows than dimensions.
    """
    def kernel(x):
        return [x - mean]

    centred = map_vectors(df.select(doubles(vec).alias(vec)), vec, kernel, "centred ARRAY<DOUBLE>")
    rows = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("centred").alias("v")), "v").select("v")
    svd = RowMatrix(rows).computeSVD(min(k, n - 1, len(mean)))
    values = np.array(svd.s.toArray())
    return svd.V.toArray().T[: len(values)], values**2 / (n - 1)


def fit_pca(df: DataFrame, n: int = 1024, whiten: bool = True, vec: str = "vec", null_axes: bool = False) -> Model:
    """Mean, axes and variances of the ``n`` leading components.

    Tall data goes through Spark's PCA estimator (distributed covariance, one small
    decomposition), data with fewer rows than dimensions through the Gram matrix of its rows,
    and what is too large for both through a distributed SVD. ``whiten`` False stores unit
    variances, so that applying the model only rotates. More axes than the data has are an
    error; ``null_axes`` admits axes without variance on the covariance route.
    """
    features, mean, total, rows = _moments(df, vec)
    if n > (len(mean) if null_axes else min(len(mean), rows - 1)):
        raise ValueError(f"{n} axes asked for, {rows} rows of {len(mean)} dimensions have {min(len(mean), rows - 1)} at most")
    covariance = len(mean) <= MAX_COVARIANCE_DIM and (rows >= len(mean) or null_axes or rows > MAX_GRAM_ROWS)
    if covariance:
        fitted = PCA(k=n, inputCol="features", outputCol="out").fit(features)
        axes, variance = fitted.pc.toArray().T, np.array(fitted.explainedVariance.toArray()) * total
    elif rows <= MAX_GRAM_ROWS:
        table, variance = wide_pca.gram_axes(df, n, rows, vec)
        _check_rank(variance, n, rows, len(mean))
        return load_model(_with_variance(table, variance if whiten else np.ones(n)))
    else:
        axes, variance = _svd_axes(df, vec, mean, n, rows)
    if not null_axes:
        _check_rank(variance, n, rows, len(mean))
    return Model(mean, _signed(axes), variance if whiten else np.ones(len(axes)))


def _check_rank(variance: np.ndarray, n: int, rows: int, width: int) -> None:
    rank = int((variance > wide_pca.noise(variance, min(rows, width))).sum())
    if rank < n:
        raise ValueError(f"{n} axes asked for, the data vary along {rank}")


def _with_variance(table: DataFrame, variance: np.ndarray) -> DataFrame:
    listed = [(-1, 0.0), *((k, float(v)) for k, v in enumerate(variance))]
    # One row per component, at most MAX_GRAM_ROWS.
    return table.join(F.broadcast(table.sparkSession.createDataFrame(listed, "component INT, variance DOUBLE")), "component")


def fit_pca_table(df: DataFrame, n: int, whiten: bool = True, vec: str = "vec", eps: float = 0.0) -> DataFrame:
    """``fit_pca`` as a model table; with fewer rows than dimensions the axes are never fetched."""
    rows, width = df.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    if rows >= (width or 0) or rows > MAX_GRAM_ROWS:
        model = fit_pca(df, n, whiten, vec)
        return model_table(df.sparkSession, model._replace(variance=model.variance + eps))
    if n > rows - 1:
        raise ValueError(f"{n} axes asked for, {rows} rows have {rows - 1} at most")
    table, variance = wide_pca.gram_axes(df, n, rows, vec)
    _check_rank(variance, n, rows, width)
    return _with_variance(table, variance + eps if whiten else np.ones(n))


def apply_pca(df: DataFrame, model: Model, vec: str = "vec", out: str = "reduced", normalize: bool = False) -> DataFrame:
    """``(x - mean) . axes / sqrt(variance)``: one matrix product per Arrow batch."""
    scale = np.sqrt(np.where(model.variance > 0, model.variance, 1.0))
    weights = (model.axes / scale[:, None]).T
    mean = model.mean

    def kernel(x):
        y = (x - mean) @ weights
        return [unit_rows(y) if normalize else y]

    return map_vectors(df.withColumn(vec, doubles(vec)), vec, kernel, f"{out} ARRAY<DOUBLE>")


def project_patches(patches: DataFrame, model: Model, vec: str = "embedding") -> DataFrame:
    """Patch descriptors reduced before the vocabulary and scaled to unit length again."""
    return apply_pca(patches, model, vec, "_reduced", normalize=True).withColumn(vec, F.col("_reduced")).drop("_reduced")


def reduce_pca_mixed(train: DataFrame, test: DataFrame, lower_dim: int, low_factor: float, fallback: int, vec: str = "vec"):
    """Leading axes mixed with axes from the low-variance end.

    ``low_factor`` of the output comes from the smallest variances. With fewer rows than
    dimensions both sets are first reduced together to ``fallback`` dimensions.
    """
    if not 0 <= low_factor <= 1:
        raise ValueError("low_factor must be within [0, 1]")
    if low_factor == 0:
        model = fit_pca(train, lower_dim, whiten=False, vec=vec)
        return apply_pca(train, model, vec), apply_pca(test, model, vec)
    rows, width = train.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    if rows < width:
        first = fit_pca(train.select(vec).unionByName(test.select(vec)), fallback, whiten=False, vec=vec)
        train, test = (apply_pca(d, first, vec, "_r").withColumn(vec, F.col("_r")).drop("_r") for d in (train, test))
        width = min(fallback, width)
    full = fit_pca(train, width, whiten=False, vec=vec, null_axes=True)
    down = int(low_factor * lower_dim)
    picked = np.r_[np.arange(lower_dim - down), np.arange(len(full.axes) - down, len(full.axes))] if down else np.arange(lower_dim)
    mixed = Model(full.mean, full.axes[picked], np.ones(len(picked)))
    return apply_pca(train, mixed, vec), apply_pca(test, mixed, vec)


def whiten_pca(df: DataFrame, num_pcs: list[int], eps: float = 1e-9, vec: str = "vec") -> dict[int, Model]:
    """Whitening models of several sizes from one fit; variances carry ``+ eps``."""
    largest = fit_pca(df, max(num_pcs), vec=vec)
    return {n: Model(largest.mean, largest.axes[:n], largest.variance[:n] + eps) for n in num_pcs}


def whiten_pca_tables(df: DataFrame, num_pcs: list[int], eps: float = 1e-9, vec: str = "vec") -> dict[int, DataFrame]:
    """``whiten_pca`` as model tables of any size, to be applied with ``wide_pca.apply_table``."""
    from ..functions.storage import cut_lineage

    largest = cut_lineage(fit_pca_table(df, max(num_pcs), vec=vec, eps=eps))
    return {n: largest.where(F.col("component") < n) for n in num_pcs}


def apply_whitening(df: DataFrame, model: Model, vec: str = "vec", out: str = "white") -> DataFrame:
    return apply_pca(df, model, vec, out, normalize=True)


def column_moments(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Mean and variance per dimension, as arrays."""
    v = array_to_vector(doubles(vec))
    return df.agg(vector_to_array(Summarizer.mean(v)).alias("mean"), vector_to_array(Summarizer.variance(v)).alias("variance"))

