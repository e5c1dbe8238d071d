"""What an aggregation did to each image: assignments, self-distances, burst weights and the descriptor."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import group_blocks, map_block_rows, pair_blocks, scalar_matrix
from ..functions.vectors import let
from . import aggregate, burst
from .vocabulary import Vocabulary

PATCH = ["image_id", "patch_id"]


def self_distances(patches: DataFrame) -> DataFrame:
    """``(image_id, patch_id, other_id, d)`` with d = -2 + 2 x_i.x_j for all patches of an image.

    The pairs themselves are the result; they are made by products of bounded blocks, so an image of
    many patches is spread over many tasks.
    """
    blocks = group_blocks(patches, ["image_id"], "patch_id", "embedding", any_ids=True)
    pairs = pair_blocks(blocks, blocks.select("image_id", "chunk", "ids", "flat"), ["image_id"])

    def kernel(row):
        ids, others = np.asarray(row["ids"].values), np.asarray(row["r_ids"].values)
        d = 2 * scalar_matrix(row["flat"], len(ids)) @ scalar_matrix(row["r_flat"], len(others)).T - 2
        return [np.repeat(ids, len(others)), np.tile(others, len(ids)), d.ravel()]

    return map_block_rows(pairs, kernel, "patch_id BIGINT, other_id BIGINT, d DOUBLE", ["image_id"])


def assignment_fields(patches: DataFrame, vocabulary: Vocabulary, alpha: float, **weighing) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The stored fields of an aggregation by name, each computed for the ``image_id`` of a table.

    For ``results.cached_fields``; ``weighing`` goes to ``burst.burst_weights``.
    """

    def of(ids: DataFrame) -> DataFrame:
        return patches.join(ids.select("image_id").distinct(), "image_id", "left_semi")

    def soft(ids: DataFrame) -> DataFrame:
        return aggregate.soft_assignment(of(ids).select(*PATCH, "embedding"), vocabulary, alpha).drop("embedding")

    def weights(ids: DataFrame) -> DataFrame:
        return burst.burst_weights(of(ids), **weighing)

    def adjusted(ids: DataFrame) -> DataFrame:
        divided = let(F.col("w"), lambda w: F.transform("soft", lambda x: x / w))
        return soft(ids).join(weights(ids), PATCH).select(*PATCH, divided.alias("adjusted"))

    return {
        "soft": soft, "adjusted": adjusted, "burst": weights, "self_distance": lambda ids: self_distances(of(ids)),
        "vlad": lambda ids: aggregate.netvlad(of(ids), vocabulary, alpha, weights(ids)),
    }


def cache_fields(vectors: DataFrame, vocabulary: Vocabulary, temp: float = 1.0, key: str = "cache_id") -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Residuals, labels and soft assignments of ``(key, embedding)`` rows, each computed for the ids of a table."""
    from .vocabulary import assign_cluster, residual_vectors

    def of(ids: DataFrame) -> DataFrame:
        return vectors.join(ids.select(key).distinct(), key, "left_semi").select(key, "embedding")

    return {
        "residuals": lambda ids: residual_vectors(of(ids), vocabulary).drop("embedding"),
        "labels": lambda ids: assign_cluster(of(ids), vocabulary).drop("embedding"),
        "soft": lambda ids: aggregate.soft_assignment(of(ids), vocabulary, temp).drop("embedding"),
    }
