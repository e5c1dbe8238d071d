"""VLAD descriptors of segments and images, in long form ``(owner, cluster, residual)``.

Only clusters an owner uses have a row; ``densify`` fills the rest with zeros.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.blocks import BLOCK_BYTES, BLOCK_ROWS, group_blocks, map_block_rows, map_vectors, scalar_matrix
from ..functions.vectors import dot, l2_normalize, let, sum_vectors
from .graph import reached_patches
from .vocabulary import Vocabulary, assign_residuals, nearest, unit_rows

SEGMENT = ["image_id", "seg_id"]
# Segments that one product covers at most, and bytes of its result over all clusters.
PIECE_SEGMENTS = 512
PIECE_BYTES = 32 << 20


def normalise_vlad(sums: DataFrame, owner: list[str], intra_norm: bool = True) -> DataFrame:
    """Unit length per cluster, then over the whole owner; zeros stay zeros (T14).

    The window spans the at most K cluster rows of one owner.
    """
    if intra_norm:
        sums = sums.withColumn("residual", l2_normalize(F.col("residual")))
    total = F.sum(dot(F.col("residual"), F.col("residual"))).over(Window.partitionBy(*owner))
    sized = sums.withColumn("_norm", F.sqrt(total))
    scaled = let(F.col("_norm"), lambda n: F.when(n > 0, F.transform(F.col("residual"), lambda x: x / n)).otherwise(F.col("residual")))
    return sized.select(*owner, "cluster", scaled.alias("residual"))


def segment_vlad(patches: DataFrame, incidence: DataFrame, vocabulary: Vocabulary, metric: str = "cosine") -> DataFrame:
    """Residual sums of the patches of each segment, per cluster.

    ``incidence`` is ``(image_id, seg_id, patch_id)``: plain segments, or super-segments
    from ``graph.reached_patches``; repeated rows count once. Vectors stay in blocks of
    their image: a block meets the id lists of the segments that touch it, cut into pieces,
    and multiplies 0/1 rows of segments with the residuals of one cluster after the other.
    Blocks, pieces and products are bounded in bytes, so an image of any size spreads over
    tasks, and one row per (segment, cluster, block) is all that is shuffled.
    """
    k, width = vocabulary.centroids.shape
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))
    piece = max(1, min(PIECE_SEGMENTS, PIECE_BYTES // (8 * k * width)))
    blocks = group_blocks(patches.select("image_id", "patch_id", "embedding"), ["image_id"], "patch_id", "embedding", rows=rows)
    ids = {c: F.col(c).cast("long").alias(c) for c in ("seg_id", "patch_id")}
    placed = incidence.select(
        "image_id", *ids.values(), F.floor(F.col("patch_id") / F.lit(rows)).cast("long").alias("chunk"),
        F.pmod(F.xxhash64("seg_id"), F.lit(1 << 31)).alias("_draw"),
    )
    # As many pieces as the image has segments for; their number is one small row per image.
    pieces = incidence.groupBy("image_id").agg(F.ceil(F.approx_count_distinct("seg_id") / F.lit(piece)).alias("_pieces"))
    lists = (
        placed.join(pieces, "image_id").withColumn("_piece", F.col("_draw") % F.greatest("_pieces", F.lit(1)))
        .repartition("image_id", "chunk").groupBy("image_id", "chunk", "_piece")
        .agg(F.collect_set(F.struct("seg_id", "patch_id")).alias("_edges"))
    )

    def kernel(row):
        x, held = scalar_matrix(row["flat"], len(row["ids"])), np.asarray(row["ids"].values)
        best = nearest(x, vocabulary, metric)
        residuals = x - vocabulary.centroids[best]
        edges = row["_edges"].values
        at = np.minimum(np.searchsorted(held, np.asarray(edges.field("patch_id"))), len(held) - 1)
        there = held[at] == np.asarray(edges.field("patch_id"))
        segs, seg = np.unique(np.asarray(edges.field("seg_id"))[there], return_inverse=True)
        at = at[there]
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros((0, width))]
        for c in np.unique(best[at]):
            mine, of = np.flatnonzero(best == c), best[at] == c
            member = np.zeros((len(segs), len(mine)))
            member[seg[of], np.searchsorted(mine, at[of])] = 1
            used = np.flatnonzero(member.any(axis=1))
            parts = segs[used], np.full(len(used), vocabulary.clusters[c], np.int32), member[used] @ residuals[mine]
            for column, part in zip(out, parts, strict=True):
                column.append(part)
        return [np.concatenate(column) for column in out]

    products = map_block_rows(blocks.join(lists, ["image_id", "chunk"]), kernel, "seg_id BIGINT, cluster INT, residual ARRAY<DOUBLE>", ["image_id"])
    # Dealt out by segment once, for the sums and for the norms over a segment's clusters.
    sums = products.repartition(*SEGMENT).groupBy(*SEGMENT, "cluster").agg(sum_vectors(F.col("residual")).alias("residual"))
    return normalise_vlad(sums.withColumn("seg_id", F.col("seg_id").cast(incidence.schema["seg_id"].dataType)), SEGMENT)


def super_segment_vlad(patches: DataFrame, hops: DataFrame, incidence: DataFrame, vocabulary: Vocabulary, metric: str = "cosine") -> DataFrame:
    """``segment_vlad`` of super-segments: each segment with the patches of all segments in ``hops`` of it."""
    return segment_vlad(patches, reached_patches(hops, incidence), vocabulary, metric)


def image_vlad_hard(
    patches: DataFrame, vocabulary: Vocabulary, intra_norm: bool = True, norm_descs: bool = True, metric: str = "cosine"
) -> DataFrame:
    """Whole-image VLAD with hard assignment."""
    residuals = assign_residuals(patches.select("image_id", "embedding"), vocabulary, metric, normalize=norm_descs).drop("embedding")
    sums = residuals.groupBy("image_id", "cluster").agg(sum_vectors(F.col("residual")).alias("residual"))
    return normalise_vlad(sums, ["image_id"], intra_norm)


def softmax_rows(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _soft_sums(patches: DataFrame, vocabulary: Vocabulary, weights, value, extra: list[str]) -> DataFrame:
    """Sum of weighted residuals per (image, cluster) from per-block matrix products.

    ``weights(x, extra)`` gives [n, K] weights, ``value(x)`` the vectors that are summed.
    A block never exceeds its row bound, whatever the size of the image.
    """
    blocks = group_blocks(patches, ["image_id"], "patch_id", "embedding", extra)

    def kernel(row):
        n = len(row["ids"])
        x = scalar_matrix(row["flat"], n)
        w = weights(x, {c: np.asarray(row[f"{c}_values"].values) for c in extra})
        return [vocabulary.clusters.astype(np.int32), value(x, w)]

    parts = map_block_rows(blocks, kernel, "cluster INT, residual ARRAY<DOUBLE>", ["image_id"])
    return parts.groupBy("image_id", "cluster").agg(sum_vectors(F.col("residual")).alias("residual"))


def image_vlad_soft(
    patches: DataFrame, vocabulary: Vocabulary, temp: float = 1.0, mode: str = "standard",
    intra_norm: bool = True, norm_descs: bool = True,
) -> DataFrame:
    """Soft assignment by softmax(temp * cosine).

    ``standard`` weighs the residual to cluster k; ``literal`` repeats the published code,
    which weighs the residuals to *all* clusters with cluster k's probability (T12).
    """
    if mode not in ("standard", "literal"):
        raise ValueError(f"unknown mode: {mode}")
    c, k = vocabulary.centroids, len(vocabulary.clusters)

    def weights(x, _):
        return softmax_rows(temp * (unit_rows(x) @ vocabulary.unit.T))

    def value(x, w):
        x = unit_rows(x) if norm_descs else x
        if mode == "literal":
            return k * (w.T @ x) - np.outer(w.sum(0), c.sum(0))
        return w.T @ x - w.sum(0)[:, None] * c

    return normalise_vlad(_soft_sums(patches, vocabulary, weights, value, []), ["image_id"], intra_norm)


def alpha_table(patches: DataFrame, vocabulary: Vocabulary, vec: str = "embedding") -> DataFrame:
    """``-ln(0.01) / mean(best - second best similarity)`` as one row."""

    def kernel(x):
        top = np.sort(x @ vocabulary.unit.T, axis=1)
        return [top[:, -1] - top[:, -2]]

    gaps = map_vectors(patches.select(vec), vec, kernel, "gap DOUBLE")
    return gaps.agg((F.lit(-float(np.log(0.01))) / F.avg("gap")).alias("alpha"))


def fit_alpha(patches: DataFrame, vocabulary: Vocabulary, vec: str = "embedding") -> float:
    """The same as a number for the model."""
    return float(alpha_table(patches, vocabulary, vec).first()[0])


def soft_assignment(patches: DataFrame, vocabulary: Vocabulary, alpha: float, vec: str = "embedding") -> DataFrame:
    """Add the softmax assignment of each patch as a K-long array."""

    def kernel(x):
        return [softmax_rows(alpha * (x @ vocabulary.unit.T))]

    return map_vectors(patches, vec, kernel, "soft ARRAY<DOUBLE>")


def netvlad(
    patches: DataFrame, vocabulary: Vocabulary, alpha: float, burst: DataFrame | None = None, normalize_input: bool = False
) -> DataFrame:
    """NetVLAD aggregation; ``burst`` rows ``(image_id, patch_id, w)`` divide the assignment."""
    extra = []
    if burst is not None:
        patches = patches.join(burst.select("image_id", "patch_id", "w"), ["image_id", "patch_id"])
        extra = ["w"]
    c = vocabulary.centroids

    def weights(x, more):
        x = unit_rows(x) if normalize_input else x
        soft = softmax_rows(alpha * (x @ vocabulary.unit.T))
        return soft / more["w"][:, None] if more else soft

    def value(x, w):
        x = unit_rows(x) if normalize_input else x
        return w.T @ x - w.sum(0)[:, None] * c

    return normalise_vlad(_soft_sums(patches, vocabulary, weights, value, extra), ["image_id"])


def densify(vlad: DataFrame, owner: list[str], vocabulary: Vocabulary, out: str = "vec") -> DataFrame:
    """One dense K*D vector per owner, clusters in id order, unused ones zero."""
    width = vocabulary.centroids.shape[1]
    ids = F.array(*[F.lit(int(c)) for c in vocabulary.clusters])
    by_cluster = F.map_from_entries(F.collect_list(F.struct(F.col("cluster").cast("int"), F.col("residual"))))
    zeros = F.array_repeat(F.lit(0.0), width)
    grouped = vlad.groupBy(*owner).agg(by_cluster.alias("_parts"))
    return grouped.select(
        *owner, F.flatten(F.transform(ids, lambda c: F.coalesce(F.element_at("_parts", c), zeros))).alias(out)
    )
