"""Burst weights: how many near-copies each patch has inside its image.

All pairs of an image are compared, but only as matrix products between bounded blocks;
a task returns one partial sum per patch, never a row per pair.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import group_blocks, map_block_rows, map_vectors, pair_blocks, scalar_matrix
from ..functions.vectors import let, mean_vectors
from .aggregate import softmax_rows
from .vocabulary import Vocabulary

PATCH = ["image_id", "patch_id"]


def _pair_sums(patches: DataFrame, term, extra: list[str] | None = None) -> DataFrame:
    """``(image_id, patch_id, s)``: sum over all patches j of ``term(-2 + 2 x_i.x_j)``."""
    extra = extra or []
    blocks = group_blocks(patches, ["image_id"], "patch_id", "embedding", extra, any_ids=True)
    pairs = pair_blocks(blocks, blocks.select("image_id", "chunk", "ids", "flat"), ["image_id"])

    def kernel(row):
        ids = np.asarray(row["ids"].values)
        left, right = scalar_matrix(row["flat"], len(ids)), scalar_matrix(row["r_flat"], len(row["r_ids"]))
        params = {c: np.asarray(row[f"{c}_values"].values)[:, None] for c in extra}
        return [ids, term(-2.0 + 2.0 * (left @ right.T), params).sum(axis=1)]

    parts = map_block_rows(pairs, kernel, "patch_id BIGINT, part DOUBLE", ["image_id"])
    return parts.groupBy(*PATCH).agg(F.sum("part").alias("s"))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1.0 + e)


def burst_weights(
    patches: DataFrame, w: float = 8.0, b: float = 7.0, p: float = 1.0,
    relu: bool = False, inv: bool = False, softmax: bool = False,
) -> DataFrame:
    """``(image_id, patch_id, w)``: (sum_j sigmoid(w * d + b)) ^ p with d = -2 + 2 x_i.x_j.

    ``inv`` divides by w instead. ``softmax`` normalises each row before summing it, so
    the sum is always 1 (T21); it is answered without comparing anything.
    """
    if softmax:
        return patches.select(*PATCH, F.lit(1.0).alias("w"))

    def term(d, _):
        z = (d / w if inv else d * w) + b
        return _sigmoid(np.maximum(z, 0.0) if relu else z)

    return _pair_sums(patches, term).select(*PATCH, F.pow("s", F.lit(float(p))).alias("w"))


def burst_count(patches: DataFrame, t: float) -> DataFrame:
    """Neighbours with d + t > 0."""
    return _pair_sums(patches, lambda d, _: (d + t > 0).astype(float)).select(*PATCH, F.col("s").alias("w"))


def burst_soft_threshold(patches: DataFrame, t: float, w: float = 8.0) -> DataFrame:
    """Sum of sigmoid(w * relu(d + t))."""
    return _pair_sums(patches, lambda d, _: _sigmoid(w * np.maximum(d + t, 0.0))).select(*PATCH, F.col("s").alias("w"))


def burst_weights_per_cluster(
    patches: DataFrame, vocabulary: Vocabulary, alpha: float, params: np.ndarray, relu: bool = False
) -> DataFrame:
    """Burst weights whose (w, b, p) are the soft assignment times a K x 3 table."""
    table = np.asarray(params, dtype=float)
    if table.shape != (len(vocabulary.clusters), 3):
        raise ValueError("params must be K x 3")

    def kernel(x):
        own = softmax_rows(alpha * (x @ vocabulary.unit.T)) @ table
        return [own[:, 0].copy(), own[:, 1].copy(), own[:, 2].copy()]

    tuned = map_vectors(patches, "embedding", kernel, "ab_w DOUBLE, ab_b DOUBLE, ab_p DOUBLE")

    def term(d, own):
        z = d * own["ab_w"] + own["ab_b"]
        return _sigmoid(np.maximum(z, 0.0) if relu else z)

    sums = _pair_sums(tuned, term, ["ab_w", "ab_b"])
    return sums.join(tuned.select(*PATCH, "ab_p"), PATCH).select(*PATCH, F.pow("s", "ab_p").alias("w"))


def pool_avg_burst(patches: DataFrame, weights: DataFrame) -> DataFrame:
    """Image mean of the descriptors divided by their burst weight."""
    weighed = patches.join(weights.select(*PATCH, "w"), PATCH)
    divided = let(F.col("w"), lambda w: F.transform("embedding", lambda x: x / w))
    return weighed.groupBy("image_id").agg(mean_vectors(divided).alias("vec"))

