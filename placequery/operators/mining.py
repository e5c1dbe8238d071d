"""Hard pair and triplet mining inside training batches.

Samples are ``(batch, id, label, vec)``. Similarities of a batch are matrix products of
bounded blocks; only the pairs a rule keeps leave a task. Batches of any size work, since
one batch may span many blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import group_blocks, map_block_rows, pair_blocks, scalar_matrix
from ..functions.vectors import doubles, l2_normalize

KEYS = ["batch"]


def _pairs(samples: DataFrame, keep, bounds: list[str] | None = None) -> DataFrame:
    """``(batch, anchor, other, same, sim)`` for ordered pairs with ``keep(sim, same, bounds)``.

    ``bounds`` names numeric columns of the anchor handed to ``keep`` as column vectors.
    """
    bounds = bounds or []
    unit = samples.withColumn("vec", l2_normalize(doubles("vec"))).withColumn("label", F.col("label").cast("double"))
    blocks = group_blocks(unit, KEYS, "id", "vec", ["label", *bounds], any_ids=True)
    pairs = pair_blocks(blocks, blocks.select("batch", "chunk", "ids", "flat", "label_values"), KEYS)

    def kernel(row):
        a, b = np.asarray(row["ids"].values), np.asarray(row["r_ids"].values)
        sim = scalar_matrix(row["flat"], len(a)) @ scalar_matrix(row["r_flat"], len(b)).T
        same = np.asarray(row["label_values"].values)[:, None] == np.asarray(row["r_label_values"].values)[None, :]
        own = {c: np.asarray(row[f"{c}_values"].values.to_numpy(zero_copy_only=False), dtype=float)[:, None] for c in bounds}
        i, j = np.nonzero((a[:, None] != b[None, :]) & keep(sim, same, own))
        return [a[i], b[j], same[i, j], sim[i, j]]

    return map_block_rows(pairs, kernel, "anchor BIGINT, other BIGINT, same BOOLEAN, sim DOUBLE", KEYS)


def mine_pairs(samples: DataFrame, positive: float = 0.7, negative: float = 0.3) -> DataFrame:
    """Positives less similar than ``positive``, negatives more similar than ``negative``."""
    return _pairs(samples, lambda s, same, _: np.where(same, s < positive, s > negative))


def _extremes(samples: DataFrame) -> DataFrame:
    """Per anchor: range of the similarities of its positives and of its negatives.

    Blocks report one number per anchor; the grouped minimum and maximum merge them.
    """
    unit = samples.withColumn("vec", l2_normalize(doubles("vec"))).withColumn("label", F.col("label").cast("double"))
    blocks = group_blocks(unit, KEYS, "id", "vec", ["label"], any_ids=True)
    pairs = pair_blocks(blocks, blocks, KEYS)

    def kernel(row):
        a, b = np.asarray(row["ids"].values), np.asarray(row["r_ids"].values)
        sim = scalar_matrix(row["flat"], len(a)) @ scalar_matrix(row["r_flat"], len(b)).T
        same = np.asarray(row["label_values"].values)[:, None] == np.asarray(row["r_label_values"].values)[None, :]
        positive = same & (a[:, None] != b[None, :])
        return [a, np.where(positive, sim, np.inf).min(1), np.where(positive, sim, -np.inf).max(1), np.where(same, np.inf, sim).min(1), np.where(same, -np.inf, sim).max(1)]

    parts = map_block_rows(pairs, kernel, "id BIGINT, pmin DOUBLE, pmax DOUBLE, nmin DOUBLE, nmax DOUBLE", KEYS)
    return parts.groupBy("batch", "id").agg(
        F.min("pmin").alias("pmin"), F.max("pmax").alias("pmax"), F.min("nmin").alias("nmin"), F.max("nmax").alias("nmax")
    )


def mine_multi_similarity(samples: DataFrame, eps: float = 0.1) -> DataFrame:
    """Negatives above (hardest positive - eps), positives below (hardest negative + eps)."""
    bounded = samples.join(_extremes(samples), ["batch", "id"])
    return _pairs(
        bounded, lambda s, same, own: np.where(same, s < own["nmax"] + eps, s > own["pmin"] - eps), ["pmin", "nmax"]
    )


def mine_triplets(samples: DataFrame, margin: float = 0.1) -> DataFrame:
    """Semi-hard triplets: 0 < d(a, n) - d(a, p) <= margin, Euclidean on unit vectors.

    Positives and negatives out of each other's reach are never produced.
    """
    def distance(s):
        return np.sqrt(np.maximum(2.0 - 2.0 * s, 0.0))

    bounded = samples.join(_extremes(samples), ["batch", "id"])

    def reachable(s, same, own):
        # d(a, n) must lie in (min d(a, p), max d(a, p) + margin], and the other way round.
        d, slack = distance(s), 1e-9
        negative = (d > distance(own["pmax"]) - slack) & (d <= distance(own["pmin"]) + margin + slack)
        positive = (d < distance(own["nmin"]) + slack) & (d >= distance(own["nmax"]) - margin - slack)
        return np.where(same, positive, negative)

    close = _pairs(bounded, reachable, ["pmin", "pmax", "nmin", "nmax"])
    close = close.withColumn("d", F.sqrt(F.greatest(F.lit(2.0) - 2 * F.col("sim"), F.lit(0.0))))
    p = close.where("same").select("batch", "anchor", F.col("other").alias("positive"), F.col("d").alias("d_pos"))
    n = close.where("not same").select("batch", "anchor", F.col("other").alias("negative"), F.col("d").alias("d_neg"))
    gap = F.col("d_neg") - F.col("d_pos")
    return p.join(n, ["batch", "anchor"]).where((gap > 0) & (gap <= margin)).select(
        "batch", "anchor", "positive", "negative", gap.alias("gap")
    )
