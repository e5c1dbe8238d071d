"""Optimal-transport assignment of patches to clusters plus a dustbin, in log space.

State per image is one number per cluster. Patch potentials are recomputed from it inside
each block, so an iteration moves K numbers per block, not the score matrix, and images of
any size take part together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import group_blocks, map_block_rows, scalar_matrix
from ..functions.storage import cut_lineage
from ..functions.vectors import sum_vectors
from .aggregate import normalise_vlad


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _couplings(row, dustbin: float) -> np.ndarray:
    """Scores [n, K] with the dustbin as last column."""
    s = scalar_matrix(row["flat"], len(row["ids"]))
    return np.hstack([s, np.full((len(s), 1), dustbin)])


def sinkhorn_assign(scores: DataFrame, clusters: int, dustbin: float = 1.0, iters: int = 3) -> DataFrame:
    """``(image_id, patch_id, assignment ARRAY<DOUBLE>)`` from ``(image_id, patch_id, scores)``.

    ``scores`` holds the K cluster scores of a patch. Cluster mass is 1 each, the dustbin
    takes the remaining n - K, patches have mass 1; the dustbin entry is dropped.
    """
    blocks = group_blocks(scores, ["image_id"], "patch_id", "scores", any_ids=True)
    sizes = blocks.groupBy("image_id").agg(F.sum(F.size("ids")).alias("n"))
    blocks = cut_lineage(blocks.join(sizes, "image_id"))
    k = clusters
    out = "cluster INT, top DOUBLE, mass DOUBLE"

    def column_sums(row):
        """Partial log-sum-exp of scores + patch potential over the block, per cluster."""
        z = _couplings(row, dustbin)
        if row["u"].is_valid:
            u = np.asarray(row["u"].values)
            norm = -np.log(row["n"].as_py() + k)
            z = z + (norm - _log_sum(z + u[None, :], 1))[:, None]
        top = z.max(axis=0)
        return [np.arange(k + 1, dtype=np.int32), top, np.exp(z - top).sum(axis=0)]

    def next_u(state: DataFrame) -> DataFrame:
        parts = map_block_rows(state, column_sums, out, ["image_id", "n"])
        # Partial sums of one (image, cluster) are rescaled to the largest block maximum.
        tops = parts.groupBy("image_id", "n", "cluster").agg(F.max("top").alias("peak"))
        merged = parts.join(tops, ["image_id", "n", "cluster"]).groupBy("image_id", "n", "cluster").agg(
            (F.log(F.sum(F.col("mass") * F.exp(F.col("top") - F.col("peak")))) + F.first("peak")).alias("lse")
        )
        norm = -F.log(F.col("n") + k)
        mass = F.when(F.col("cluster") < k, norm).otherwise(norm + F.log(F.col("n") - F.lit(k)))
        # With n <= K nothing is left for the dustbin: its mass is 0, its log -infinity.
        mass = F.when((F.col("cluster") == k) & (F.col("n") <= k), F.lit(float("-inf"))).otherwise(mass)
        u = merged.select("image_id", F.struct("cluster", (mass - F.col("lse")).alias("u")).alias("_u"))
        return u.groupBy("image_id").agg(F.array_sort(F.collect_list("_u"))["u"].alias("u"))

    u = None
    for _ in range(iters):
        state = blocks.withColumn("u", F.lit(None).cast("array<double>")) if u is None else blocks.join(u, "image_id")
        # Each iteration reads its state twice: stored, the plan grows by one step an iteration.
        u = cut_lineage(next_u(state))

    def assignment(row):
        z = _couplings(row, dustbin)
        u = np.asarray(row["u"].values)
        norm = -np.log(row["n"].as_py() + k)
        z = z + u[None, :]
        z = z + (norm - _log_sum(z, 1))[:, None]
        return [np.asarray(row["ids"].values), np.exp(z - norm)[:, :k]]

    return map_block_rows(blocks.join(u, "image_id"), assignment, "patch_id BIGINT, assignment ARRAY<DOUBLE>", ["image_id"])


def ot_aggregate(patches: DataFrame, assignment: DataFrame, clusters: int) -> DataFrame:
    """Assignment-weighted descriptor sums per cluster, unit length per cluster."""
    joined = patches.select("image_id", "patch_id", "embedding").join(assignment, ["image_id", "patch_id"])
    blocks = group_blocks(
        joined.withColumn("_both", F.concat("embedding", "assignment")), ["image_id"], "patch_id", "_both"
    )

    def kernel(row):
        both = scalar_matrix(row["flat"], len(row["ids"]))
        x, p = both[:, :-clusters], both[:, -clusters:]
        return [np.arange(clusters, dtype=np.int32), p.T @ x]

    parts = map_block_rows(blocks, kernel, "cluster INT, residual ARRAY<DOUBLE>", ["image_id"])
    sums = parts.groupBy("image_id", "cluster").agg(sum_vectors(F.col("residual")).alias("residual"))
    return normalise_vlad(sums, ["image_id", "cluster"])
