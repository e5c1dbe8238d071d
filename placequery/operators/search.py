"""Exact nearest-neighbour search as blocked matrix products.

The work of every search is |query| x |reference| distances; what is controlled here is
what moves. No distance leaves a task unless it is among the k best of its query in the
blocks that task has seen, and the query side is broadcast only while its measured size
and that of its candidates are small. Beyond that both sides are cut into stripes bounded in bytes, and each (query
stripe, reference stripe) tile is a partition of its own: its task holds the query stripe
and streams the reference stripe past it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.blocks import pack_rows, scalar_matrix
from ..functions.vectors import doubles, l2_normalize

BROADCAST_BYTES = 64 << 20
STATE_BYTES = 64 << 20
# Temporaries of the row-by-row distances.
EXACT_BYTES = 4 << 20
# Distances held at once, and candidates of the queries that are merged at once.
SCORE_BYTES = 4 << 20
MERGE_BYTES = 2 << 20
# A query stripe is held by a task with its candidates, a reference stripe streams through one.
QUERY_STRIPE_BYTES = 64 << 20
REF_STRIPE_BYTES = 512 << 20


def _score(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Smaller is better: squared distance, or the negated inner product."""
    out = q @ r.T
    if metric == "ip":
        return np.negative(out, out=out)
    out *= -2.0
    out += np.einsum("ij,ij->i", q, q)[:, None]
    out += np.einsum("ij,ij->i", r, r)
    return out


def _exact(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Pairwise value of matching rows, independent of how rows were blocked."""
    if metric == "ip":
        return -(q * r).sum(1)
    diff = q - r
    return (diff * diff).sum(1)


def _block_best(q, r, r_ids, k, metric):
    """Candidates (query row, reference ids, value) holding the k best of each query row.

    The matrix product only preselects, with slack for rounding; values that decide the
    order are recomputed row by row. Queries are taken a slice at a time, so that the
    distances in memory do not grow with the product of the block sizes.
    """
    step = max(1, SCORE_BYTES // (8 * max(1, len(r))))
    parts = []
    for s in range(0, len(q), step):
        rows, found, values = _slice_best(q[s : s + step], r, r_ids, k, metric)
        parts.append((rows + s, found, values))
    if len(parts) == 1:
        return parts[0]
    found = [np.concatenate(c) for c in zip(*(p[1] for p in parts))]
    return np.concatenate([p[0] for p in parts]), found, np.concatenate([p[2] for p in parts])


def _slice_best(q, r, r_ids, k, metric):
    approx = _score(q, r, metric)
    if approx.shape[1] > k:
        kth = np.partition(approx, k - 1, axis=1)[:, k - 1]
        slack = 1e-9 * (1.0 + np.maximum(approx.max(axis=1), -approx.min(axis=1)))
        rows, cols = np.nonzero(approx <= (kth + slack)[:, None])
    else:
        rows, cols = (a.ravel() for a in np.indices(approx.shape))
    # In slices: all candidates at once would be an array of (query rows x k x dimensions).
    step = max(1, EXACT_BYTES // (8 * q.shape[1]))
    parts = [_exact(q[rows[s : s + step]], r[cols[s : s + step]], metric) for s in range(0, len(rows), step)]
    values = np.concatenate(parts) if parts else np.empty(0)
    return _cut(rows, [ids[cols] for ids in r_ids], values, k)


def _cut(rows, ids, values, k):
    """Keep the k smallest values per row, ties by reference ids."""
    order = np.lexsort([*ids[::-1], values, rows])
    rows, values, ids = rows[order], values[order], [i[order] for i in ids]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    keep = rank < k
    return rows[keep], [i[keep] for i in ids], values[keep]


def _tiles(n_q: int, n_r: int, width: int, slots: int, kept: int = 0) -> tuple[int, int]:
    """Stripe counts (query, reference): bounded stripes, and about 4 tiles a slot with few repeated rows.

    ``kept`` is the size of a query's candidates; a task holds those of its whole query stripe.
    """
    target = 4 * max(1, slots)
    a = min(target, max(1, round(math.sqrt(target * n_q / max(1, n_r)))))
    a = max(a, math.ceil(n_q * (width * 8 + kept) / QUERY_STRIPE_BYTES))
    return a, max(1, math.ceil(target / a), math.ceil(n_r * width * 8 / REF_STRIPE_BYTES))


def _stripes(df: DataFrame, ids: list[str], count: int) -> DataFrame:
    """Blocks of ``df``, stripe by stripe; a stripe is a partition and depends on the row alone, so a rerun task cannot move a row."""
    stripe = F.pmod(F.xxhash64(*ids), F.lit(count)).cast("int")
    return pack_rows(df.withColumn("_stripe", stripe).repartitionById(count, "_stripe"), ids, "_v", "_stripe")


def _tile_rows(q: DataFrame, r: DataFrame, q_ids: list[str], r_ids: list[str], a: int, b: int) -> DataFrame:
    """One partition per tile with its query blocks first, then its reference blocks.

    Rows are numbered by tile, not hashed, so that no two tiles share a partition.
    """
    def copies(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    q_side = _stripes(q, q_ids, a).withColumn("_other", copies(b)).withColumn("_tile", (F.col("_stripe") * b + F.col("_other")).cast("int"))
    r_side = _stripes(r, r_ids, b).withColumn("_other", copies(a)).withColumn("_tile", (F.col("_other") * b + F.col("_stripe")).cast("int"))
    r_side = r_side.withColumnRenamed("flat", "r_flat")
    both = q_side.withColumn("_side", F.lit(0)).unionByName(r_side.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return both.drop("_stripe", "_other").repartitionById(a * b, "_tile").sortWithinPartitions("_side")


def knn(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    q_ids: list[str],
    r_ids: list[str],
    q_vec: str = "vec",
    r_vec: str = "vec",
    metric: str = "l2",
    normalize: bool = False,
    value: str = "sq_dist",
) -> DataFrame:
    """``k`` nearest references of every query: ``q_ids + r_ids + [rank, value]``.

    ``metric`` is ``l2`` (squared distance, ascending) or ``ip``/``cosine`` (inner
    product, descending; cosine normalises first). Ranks start at 1, ties go by r_ids.
    """
    if metric not in ("l2", "ip", "cosine"):
        raise ValueError(f"unknown metric: {metric}")
    unit = normalize or metric == "cosine"
    kernel_metric = "l2" if metric == "l2" else "ip"

    def side(df, ids, vec):
        v = doubles(vec)
        return df.select(*[F.col(i).cast("long").alias(i) for i in ids], (l2_normalize(v) if unit else v).alias("_v"))

    q, r = side(queries, q_ids, q_vec), side(refs, r_ids, r_vec)
    n_q, width = queries.agg(F.count(F.lit(1)), F.max(F.size(q_vec))).first()
    kept = 8 * (2 + len(r_ids)) * k
    if n_q * (width or 0) * 8 <= BROADCAST_BYTES and n_q * kept <= STATE_BYTES:
        # Small query set, size just measured: references are scanned in place.
        # The single tile is a real column of the blocks, so the join stays a hash join.
        q_blocks = pack_rows(q.withColumn("_tile", F.lit(0)), q_ids, "_v", "_tile")
        r_blocks = pack_rows(r.withColumn("_tile", F.lit(0)), r_ids, "_v", "_tile").withColumnRenamed("flat", "r_flat")
        pairs = r_blocks.join(F.broadcast(q_blocks), "_tile")
        tiled = False
    else:
        a, b = _tiles(n_q, refs.count(), width or 0, queries.sparkSession.sparkContext.defaultParallelism, kept)
        pairs = _tile_rows(q, r, q_ids, r_ids, a, b)
        tiled = True

    columns = [f"{i}_ids" for i in q_ids] + ["flat"] + [f"{i}_ids" for i in r_ids] + ["r_flat"]
    out = T.StructType(
        [T.StructField(i, T.LongType()) for i in [*q_ids, *r_ids]] + [T.StructField("_value", T.DoubleType())]
    )
    nq = len(q_ids)
    merged = max(1, MERGE_BYTES // kept)

    def block(batch: pa.RecordBatch, i: int, first: int, ids: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        held = [np.asarray(batch.column(first + j)[i].values) for j in range(len(ids))]
        return held, scalar_matrix(batch.column(first + len(ids))[i], len(held[0]))

    def met(batches: Iterator[pa.RecordBatch]):
        """Pairs of a slice of a query block and a reference block: those of a row, or those of a tile."""
        waiting = []
        for batch in batches:
            for i in range(batch.num_rows):
                if tiled and batch.column(nq)[i].is_valid:
                    # Copies: a view would hold its whole Arrow batch.
                    keys, q = block(batch, i, 0, q_ids)
                    waiting.append(([key.copy() for key in keys], q.copy()))
                    continue
                ref = block(batch, i, nq + 1, r_ids)
                for keys, q in waiting if tiled else [block(batch, i, 0, q_ids)]:
                    for s in range(0, len(q), merged):
                        yield [key[s : s + merged] for key in keys], q[s : s + merged], *ref

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple] = {}
        held = 0

        def emit():
            for keys, (rows, ids, values) in best.values():
                data = [key[rows] for key in keys] + ids + [values]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in data], names=out.names)

        for keys, q, ids, r in met(batches):
            name = b"".join(key.tobytes() for key in keys)
            rows, found, values = _block_best(q, r, ids, k, kernel_metric)
            if name not in best:
                keys = [key.copy() for key in keys]
            else:
                keys, (rows0, found0, values0) = best[name]
                held -= values0.nbytes * (2 + len(found0))
                rows, values = np.r_[rows0, rows], np.r_[values0, values]
                found = [np.r_[x, y] for x, y in zip(found0, found)]
                rows, found, values = _cut(rows, found, values, k)
            best[name] = (keys, (rows, found, values))
            held += values.nbytes * (2 + len(found))
            if held > STATE_BYTES:
                # Partial results are merged below, so flushing early loses nothing.
                yield from emit()
                best, held = {}, 0
        yield from emit()

    found = pairs.select(*columns).mapInArrow(search, out)
    order = Window.partitionBy(*q_ids).orderBy("_value", *r_ids)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    sign = F.col("_value") if metric == "l2" else -F.col("_value")
    return ranked.select(*q_ids, *r_ids, "rank", sign.alias(value))


def knn_l2(queries: DataFrame, refs: DataFrame, k: int = 200, **kwargs) -> DataFrame:
    """Segment search: squared Euclidean distance, 200 neighbours by default."""
    return knn(queries, refs, k, metric="l2", **kwargs)


def knn_ip(queries: DataFrame, refs: DataFrame, k: int, metric: str = "cosine", **kwargs) -> DataFrame:
    """Inner-product or cosine search; any other metric is an error."""
    if metric not in ("ip", "cosine"):
        raise ValueError(f"unknown metric: {metric}")
    return knn(queries, refs, k, metric=metric, value=kwargs.pop("value", "sim"), **kwargs)


def knn_image(queries: DataFrame, refs: DataFrame, k: int = 5, **kwargs) -> DataFrame:
    """Whole-image search by plain Euclidean distance."""
    found = knn(queries, refs, k, metric="l2", value="_sq", **kwargs)
    return found.withColumn("dist", F.sqrt(F.greatest(F.col("_sq"), F.lit(0.0)))).drop("_sq")


def segment_matches(found: DataFrame, top: int = 50) -> DataFrame:
    """Cut a search result to the ranks that vote and turn distances into similarities."""
    return found.where(F.col("rank") <= top).withColumn("sim", F.lit(2.0) - F.col("sq_dist"))


def segments_to_images(found: DataFrame, index: DataFrame, key: str = "r_uid") -> DataFrame:
    """Replace a matched segment by its image; Spark picks the join by the index size."""
    return found.join(index, key).drop(key)
