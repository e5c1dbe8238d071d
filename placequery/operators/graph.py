"""Neighbour graph of segments and its expansion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import group_blocks, map_block_rows, pair_blocks, scalar_matrix
from ..functions.ordering import dense_position
from ..functions.storage import cut_lineage

SMALL_IMAGE = 3
# Share of the squared extent by which points are lifted, each by its own amount.
LIFT = 1e-12
# Images up to this many segments are triangulated in one call, larger ones in strips.
STRIP_SEGMENTS = 2048


def _turn(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Positive when p lies left of the directed line a -> b."""
    return (b[..., 0] - a[..., 0]) * (p[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (p[..., 0] - a[..., 0])


def _inside_circle(a, b, c, p) -> np.ndarray:
    """p strictly inside the circumcircle of counter-clockwise triangles (a, b, c).

    Rows are (x, y, lift). Lifts are tiny weights that decide between points on a common circle,
    the same way wherever they meet; orientation does not depend on them.
    """
    lifts = [x[..., 2] - p[..., 2] for x in (a, b, c)]
    da, db, dc = (x[..., :2] - p[..., :2] for x in (a, b, c))
    sa, sb, sc = ((d * d).sum(-1) + w for d, w in zip((da, db, dc), lifts, strict=True))
    det = (
        da[..., 0] * (db[..., 1] * sc - dc[..., 1] * sb)
        - da[..., 1] * (db[..., 0] * sc - dc[..., 0] * sb)
        + sa * (db[..., 0] * dc[..., 1] - db[..., 1] * dc[..., 0])
    )
    return det > 0


def triangulate(points: np.ndarray) -> set[tuple[int, int]]:
    """Delaunay edges of one point set, rows (x, y) or (x, y, lift), as index pairs (i < j).

    Points enter one at a time; triangles whose circle holds the new point are replaced.
    The outside is covered by ghost triangles (u, v, -1) whose "circle" is the half-plane
    beyond the hull edge. Points on one line are linked to their neighbours along it. Of points
    in one place only the first has edges.
    """
    first = np.sort(np.unique(points[:, :2], axis=0, return_index=True)[1])
    if len(first) < len(points):
        return {(int(first[i]), int(first[j])) for i, j in triangulate(points[first])}
    n = len(points)
    if points.shape[1] == 2:
        points = np.column_stack([points, np.zeros(n)])
    p = points - points.mean(axis=0) * [1, 1, 0]
    order = np.lexsort((p[:, 1], p[:, 0]))
    span = np.abs(p[:, :2]).max() or 1.0
    first = next(
        ((0, 1, j) for j in range(2, n) if abs(_turn(p[order[0]], p[order[1]], p[order[j]])) > 1e-12 * span * span), None
    ) if n > 2 else None
    if first is None:
        return {(min(i, j), max(i, j)) for i, j in zip(order[:-1].tolist(), order[1:].tolist())}
    i, j, k = (int(order[f]) for f in first)
    if _turn(p[i], p[j], p[k]) < 0:
        i, j = j, i
    triangles = np.array([(i, j, k), (j, i, -1), (k, j, -1), (i, k, -1)])
    for m in (int(o) for o in order if int(o) not in (i, j, k)):
        ghost = triangles[:, 2] < 0
        a, b = p[triangles[:, 0]], p[triangles[:, 1]]
        side = _turn(a, b, p[m])
        # A turn within rounding is none.
        reach = np.linalg.norm((b - a)[:, :2], axis=1) * np.linalg.norm((p[m] - a)[:, :2], axis=1)
        side = np.where(np.abs(side) <= 1e-12 * reach, 0.0, side)
        # On the line of a hull edge, only a point between its ends removes the ghost.
        between = ((p[m] - a) * (p[m] - b))[:, :2].sum(-1) < 0
        hit = np.where(ghost, (side > 0) | ((side == 0) & between), _inside_circle(a, b, p[triangles[:, 2]], p[m]))
        if not hit.any():
            continue
        hole = triangles[hit]
        sides = {(int(t[s]), int(t[(s + 1) % 3])) for t in hole for s in range(3)}
        rim = [(u, v) for u, v in sides if (v, u) not in sides]
        fresh = [(u, v, m) if u >= 0 and v >= 0 else ((v, m, -1) if u < 0 else (m, u, -1)) for u, v in rim]
        triangles = np.concatenate([triangles[~hit], np.array(fresh)])
    edges = set()
    for t in triangles:
        for u, v in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
            if u >= 0 and v >= 0:
                edges.add((int(min(u, v)), int(max(u, v))))
    return edges


def delaunay_edges(centroids: DataFrame) -> DataFrame:
    """``(image_id, seg_a, seg_b, small)`` from ``(image_id, seg_id, cx, cy)``.

    Both directions and self-loops. Images with three segments or fewer link every
    segment to the first two instead (T10). Segment counts are taken first: only images
    within ``STRIP_SEGMENTS`` are handled in one call each.
    """
    points = centroids.select(
        F.col("image_id").cast("long").alias("image_id"), F.col("seg_id").cast("long").alias("seg_id"),
        F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"),
    )
    extents = points.groupBy("image_id").agg(
        (F.pow(F.max("cx") - F.min("cx"), F.lit(2)) + F.pow(F.max("cy") - F.min("cy"), F.lit(2))).alias("_extent")
    )
    share = F.pmod(F.xxhash64("cx", "cy"), F.lit(1 << 20)) / F.lit(1 << 20)
    points = points.join(extents, "image_id").withColumn("lift", share * F.col("_extent") * LIFT).drop("_extent")
    sizes = points.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    crowded = cut_lineage(sizes.where(F.col("_n") > STRIP_SEGMENTS).select("image_id"))

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg_id", kind="stable")
        ids = pdf["seg_id"].to_numpy()
        n = len(ids)
        small = n <= SMALL_IMAGE
        if small:
            a = [i for i in range(n) for _ in range(min(n, 2))]
            b = [j for _ in range(n) for j in range(min(n, 2))]
        else:
            pairs = triangulate(pdf[["cx", "cy", "lift"]].to_numpy(dtype=float))
            a = [i for i, _ in pairs] + [j for _, j in pairs] + list(range(n))
            b = [j for _, j in pairs] + [i for i, _ in pairs] + list(range(n))
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "seg_a": ids[a], "seg_b": ids[b], "small": small})

    schema = "image_id LONG, seg_a LONG, seg_b LONG, small BOOLEAN"
    if crowded.isEmpty():
        return points.groupBy("image_id").applyInPandas(edges, schema)
    found = points.join(crowded, "image_id", "left_anti").groupBy("image_id").applyInPandas(edges, schema)
    large = points.join(crowded, "image_id", "left_semi")
    places = large.groupBy("image_id", "cx", "cy", "lift").agg(F.min("seg_id").alias("seg_id"))
    one_way = strip_edges(places)
    both = one_way.unionByName(one_way.select("image_id", F.col("seg_b").alias("seg_a"), F.col("seg_a").alias("seg_b")))
    loops = large.select("image_id", F.col("seg_id").alias("seg_a"), F.col("seg_id").alias("seg_b"))
    return found.unionByName(both.unionByName(loops).withColumn("small", F.lit(False)))


def _circle_bounds(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of circle centres through a and b that keep the points p outside.

    Rows are (x, y, lift). Centres lie at signed offset t on the line of equal power of a and b
    (the perpendicular bisector, moved by the difference of their lifts). A point left of a -> b
    bounds t from above, one to the right from below; a point between a and b leaves none.
    """
    lift_a, lift_b, lift_p = a[:, 2], b[:, 2], p[:, 2]
    a, b, p = a[:, :2], b[:, :2], p[:, :2]
    mid, along = (a + b) / 2, b - a
    length = np.linalg.norm(along, axis=1, keepdims=True)
    along = along / np.where(length > 0, length, 1.0)
    d = p[None, :, :] - mid[:, None, :]
    u = d[..., 0] * along[:, None, 0] + d[..., 1] * along[:, None, 1]
    v = d[..., 1] * along[:, None, 0] - d[..., 0] * along[:, None, 1]
    # Rounding must not put a point on the line to one side of it.
    v = np.where(np.abs(v) <= 1e-13 * (np.abs(u) + length), 0.0, v)
    # A lift raises the power of a centre towards its point: |c - x|^2 + lift.
    move = (lift_b - lift_a)[:, None] / np.where(length > 0, 2 * length, 1.0)
    s = u * u + v * v - (length / 2) ** 2 - 2 * move * u - move * length + lift_p[None, :] - lift_a[:, None]
    own = (p[None] == a[:, None]).all(-1) | (p[None] == b[:, None]).all(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = s / (2 * v)
    high = np.where(~own & (v > 0), t, np.inf).min(axis=1)
    low = np.where(~own & (v < 0), t, -np.inf).max(axis=1)
    blocked = (~own & (v == 0) & (s < 0)).any(axis=1)
    return np.where(blocked, np.inf, low), np.where(blocked, -np.inf, high)


def strip_edges(points: DataFrame) -> DataFrame:
    """Delaunay edges (one direction) of images too large for one call.

    Points are cut into strips. Every edge of the whole image is also an edge of the
    triangulation of any two strips holding its ends, so strip pairs yield all candidates.
    A candidate is kept if some circle through its ends is empty: each strip reports the
    range of centres it allows and the ranges are intersected by a grouped min and max.
    """
    placed = dense_position(points, [F.col("cx"), F.col("cy"), F.col("seg_id")], "pos", ["image_id"])
    xy = placed.select("image_id", "pos", F.array("cx", "cy", "lift").alias("xy"))
    strips = cut_lineage(group_blocks(xy, ["image_id"], "pos", "xy", rows=STRIP_SEGMENTS))
    pairs = pair_blocks(strips, strips, ["image_id"]).where(F.col("chunk") <= F.col("r_chunk"))
    ends = ["pos_a", "pos_b", "ax", "ay", "al", "bx", "by", "bl"]

    def candidates(row):
        a, b = np.asarray(row["ids"].values), np.asarray(row["r_ids"].values)
        p, q = scalar_matrix(row["flat"], len(a)), scalar_matrix(row["r_flat"], len(b))
        if a[0] == b[0]:
            ids, xy = a, p
        else:
            ids, xy = np.r_[a, b], np.vstack([p, q])
        found = np.array(sorted(triangulate(xy))).reshape(-1, 2)
        if a[0] != b[0]:
            # Edges inside one strip come from that strip alone.
            found = found[(found[:, 0] < len(a)) != (found[:, 1] < len(a))]
        i, j = found[:, 0], found[:, 1]
        return [ids[i], ids[j], *xy[i].T, *xy[j].T]

    schema = "pos_a BIGINT, pos_b BIGINT, ax DOUBLE, ay DOUBLE, al DOUBLE, bx DOUBLE, by DOUBLE, bl DOUBLE"
    proposed = map_block_rows(pairs, candidates, schema, ["image_id"])
    numbered = dense_position(proposed, [F.col("pos_a"), F.col("pos_b")], "edge", ["image_id"])
    batches = group_blocks(numbered.withColumn("ends", F.array(*[F.col(c).cast("double") for c in ends])), ["image_id"], "edge", "ends", rows=STRIP_SEGMENTS)

    def allowed(row):
        e = scalar_matrix(row["flat"], len(row["ids"]))
        strip = scalar_matrix(row["r_flat"], len(row["r_ids"]))
        # Slices keep the edge-by-point arrays of a task small.
        parts = [_circle_bounds(e[i : i + 256, 2:5], e[i : i + 256, 5:8], strip) for i in range(0, len(e), 256)]
        low, high = (np.concatenate(side) for side in zip(*parts))
        return [e[:, 0].astype(np.int64), e[:, 1].astype(np.int64), low, high]

    ranges = map_block_rows(
        pair_blocks(batches, strips, ["image_id"]), allowed, "pos_a BIGINT, pos_b BIGINT, low DOUBLE, high DOUBLE", ["image_id"]
    )
    kept = ranges.groupBy("image_id", "pos_a", "pos_b").agg(F.max("low").alias("low"), F.min("high").alias("high")).where("low <= high")
    names = placed.select("image_id", "pos", "seg_id")
    return (
        kept.join(names.select("image_id", F.col("pos").alias("pos_a"), F.col("seg_id").alias("seg_a")), ["image_id", "pos_a"])
        .join(names.select("image_id", F.col("pos").alias("pos_b"), F.col("seg_id").alias("seg_b")), ["image_id", "pos_b"])
        .select("image_id", "seg_a", "seg_b")
    )


def expand_hops(edges: DataFrame, order: int, segments: DataFrame | None = None) -> DataFrame:
    """``(image_id, seg_a, seg_b, hops)``: segments within ``order`` steps.

    Order 0 is each segment alone (needs ``segments``). Small images keep their fixed
    links whatever the order (T10). Each step is one join on (image, segment) and one
    grouped minimum; self-loops make the reachable set grow monotonically.
    """
    if order == 0:
        if segments is None:
            raise ValueError("order 0 needs the segment list")
        return segments.select("image_id", F.col("seg_id").alias("seg_a"), F.col("seg_id").alias("seg_b"), F.lit(0).alias("hops")).distinct()
    if order > 1:
        # Every step joins the same edges; the id table is small next to what built it.
        edges = cut_lineage(edges)
    step = F.when(F.col("seg_a") == F.col("seg_b"), 0).otherwise(1)
    reach = edges.select("image_id", "seg_a", "seg_b", "small", step.alias("hops")).distinct()
    moves = edges.where(~F.col("small")).select(
        "image_id", F.col("seg_a").alias("seg_b"), F.col("seg_b").alias("_to"), step.alias("_step")
    ).distinct()
    kept = reach.where("small").drop("small")
    grown = reach.where("not small").drop("small")
    for _ in range(order - 1):
        grown = (
            grown.join(moves, ["image_id", "seg_b"])
            .groupBy("image_id", "seg_a", F.col("_to").alias("seg_b"))
            .agg(F.min(F.col("hops") + F.col("_step")).alias("hops"))
        )
    return grown.unionByName(kept)


def reached_patches(hops: DataFrame, incidence: DataFrame) -> DataFrame:
    """Patches of all reachable segments; a patch repeats when several of them hold it."""
    reached = incidence.select("image_id", F.col("seg_id").alias("seg_b"), "patch_id")
    return (
        hops.select("image_id", "seg_a", "seg_b").join(reached, ["image_id", "seg_b"])
        .select("image_id", F.col("seg_a").alias("seg_id"), "patch_id")
    )


def super_segment_patches(hops: DataFrame, incidence: DataFrame) -> DataFrame:
    """Union of the patches of all reachable segments; each patch counts once (T11)."""
    return reached_patches(hops, incidence).distinct()
