"""Near duplicates of vectors by an epsilon grid order join.

Vectors of unit length with cosine >= t are at most epsilon = sqrt(2 - 2t) apart. They are sorted
by their grid cells of width epsilon on leading principal axes, cut into stripes of the sequence,
and intervals of stripes are joined recursively: a pair of intervals whose boxes lie further
apart than epsilon is skipped with all that is in it. A pair of stripes that is left goes to one
task, which halves both down to small blocks by the same rule, now with boxes on all axes, and
compares the blocks that remain in double precision.

Equal vectors are one node with a weight. A task returns counts and a spanning forest of its
links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import dense_position
from .common import stored
from .components import components

# Vectors on which the principal axes are fitted (they only decide the order), axes of the grid, rows of a stripe and of a block.
FIT_VECTORS, GRID_AXES, STRIPE, BLOCK = 4096, 6, 4096, 256
# Intervals of one level that make an interval of the next.
_FAN = 4
_SLACK = 1e-9


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of unit length, whether usable); shorter vectors count as padded by zeros."""
    out = np.zeros((len(vectors), width))
    good = np.ones(len(vectors), bool)
    for k, v in enumerate(vectors):
        values = v.values if v.is_valid else None
        if values is None or len(values) == 0 or values.null_count:
            good[k] = False
        else:
            out[k, : len(values)] = values.to_numpy(zero_copy_only=False)
    good &= np.isfinite(out).all(axis=1)
    out[~good] = 0
    # The largest component first: squares of very small or large ones would leave the range.
    peak = np.abs(out).max(axis=1, initial=0)
    good &= peak > 0
    out /= np.where(peak > 0, peak, 1)[:, None]
    out /= np.where(peak > 0, np.sqrt((out * out).sum(axis=1)), 1)[:, None]
    return out, good


def _axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Orthonormal axes, those of largest variance in a bounded sample first."""
    sample = vectors.orderBy(F.xxhash64("embedding")).limit(FIT_VECTORS).select("embedding").toArrow()
    units, good = _matrix(sample.column(0).combine_chunks(), width) if sample.num_rows else (np.zeros((0, width)), np.zeros(0, bool))
    units = units[good]
    centred = units - units.mean(axis=0) if len(units) else np.zeros((1, width))
    return np.linalg.svd(centred.T @ centred + 1e-12 * np.eye(width))[0]


def _prepared(vectors: DataFrame, width: int, axes: np.ndarray, epsilon: float) -> DataFrame:
    """vec_id, and of usable rows node (hash of the vector), grid cells, leading coordinates and unit vector on the axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, good = _matrix(batch.column(1), width)
            units = units[good]
            turned = units @ axes
            cells = np.floor(turned[:, :GRID_AXES] / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).filter(pa.array(good)),
                    pa.array(np.array([xxhash.xxh3_64_intdigest(u.tobytes()) for u in units + 0.0], np.uint64).view(np.int64)),
                    pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), cells.shape[1]).cast(pa.list_(pa.int32())),
                    pa.FixedSizeListArray.from_arrays(pa.array(turned[:, :GRID_AXES].ravel()), cells.shape[1]).cast(pa.list_(pa.float64())),
                    pa.array([t.tobytes() for t in turned], pa.binary()),
                    pa.array(np.ones(len(units), bool)),
                ],
                names,
            )
            bad = batch.column(0).filter(pa.array(~good))
            yield pa.RecordBatch.from_arrays([bad, *(pa.nulls(len(bad), t) for t in types[:-1]), pa.array(np.zeros(len(bad), bool))], names)

    names = ["vec_id", "node", "cell", "near", "vector", "good"]
    types = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.binary(), pa.bool_()]
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "vec_id bigint, node bigint, cell array<int>, near array<double>, vector binary, good boolean")


def _near(low_a, high_a, low_b, high_b, epsilon: float) -> bool:
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float(gap @ gap) <= epsilon * epsilon + _SLACK


def _block_pairs(x: np.ndarray, a: tuple[int, int], b: tuple[int, int], boxes: dict, epsilon: float) -> Iterator[tuple]:
    """Pairs of small intervals within reach, the first not after the second."""
    for part in (a, b):
        if part not in boxes:
            boxes[part] = x[slice(*part)].min(axis=0), x[slice(*part)].max(axis=0)
    if not _near(*boxes[a], *boxes[b], epsilon):
        return
    if max(a[1] - a[0], b[1] - b[0]) <= BLOCK:
        yield a, b
        return
    halves = [[p] if p[1] - p[0] <= BLOCK else [(p[0], sum(p) // 2), (sum(p) // 2, p[1])] for p in (a, b)]
    for p in halves[0]:
        for q in halves[1]:
            if a != b or p <= q:
                yield from _block_pairs(x, p, q, boxes, epsilon)


def linked_pairs(x: np.ndarray, first: int, same: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of linked pairs of one stripe (``same``) or across ``x[:first]`` and ``x[first:]``, block by block."""
    epsilon, boxes, n = np.sqrt(max(2 - 2 * cosine, 0)), {}, len(x)
    if not n or not same and first in (0, n):
        return
    a, b = ((0, n), (0, n)) if same else ((0, first), (first, n))
    for p, q in _block_pairs(x, a, b, boxes, epsilon):
        i, j = np.nonzero(x[slice(*p)] @ x[slice(*q)].T >= cosine)
        i, j = i + p[0], j + q[0]
        if p == q:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i, j


def _forest(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least row number that each row reaches by the links."""
    label = np.arange(n)
    while True:
        before = label.copy()
        for i, j in links:
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _compared(cosine: float, width: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        a, b = key[0].as_py(), key[1].as_py()
        stripe = rows.column("stripe").to_numpy()
        order = np.lexsort((rows.column("place").to_numpy(), stripe))
        x = np.frombuffer(b"".join(v.as_py() for v in rows.column("vector")), np.float64).reshape(-1, width)[order]
        node, weight = rows.column("node").to_numpy()[order], rows.column("weight").to_numpy()[order]
        n_links = np.zeros(len(x), np.int64)
        links = []
        for i, j in linked_pairs(x, int((stripe == a).sum()), a == b, cosine):
            np.add.at(n_links, i, weight[j])
            np.add.at(n_links, j, weight[i])
            links.append((i, j))
            if sum(len(i) for i, _ in links) > 1 << 22:  # keep a spanning forest of what was found
                label = _forest(len(x), links)
                links = [(np.arange(len(x)), label)]
        label = _forest(len(x), links)
        some = n_links > 0
        return pa.table({"node": node[some], "n_links": n_links[some], "root": node[label][some]})

    return run


def _stripe_pairs(placed: DataFrame, epsilon: float) -> DataFrame:
    """Pairs (a, b), a <= b, of stripes whose boxes on the grid axes are within reach, from the whole sequence down."""
    axes = range(GRID_AXES)
    boxes = stored(placed.groupBy("stripe").agg(*(F.min(f"x{k}").alias(f"l{k}") for k in axes), *(F.max(f"x{k}").alias(f"h{k}") for k in axes)))
    last = boxes.agg(F.max("stripe")).first()[0] or 0
    levels = [boxes.withColumnRenamed("stripe", "at")]
    while last:
        last //= _FAN
        up = levels[-1].withColumn("at", F.floor(F.col("at") / _FAN))
        levels.append(up.groupBy("at").agg(*(F.min(f"l{k}").alias(f"l{k}") for k in axes), *(F.max(f"h{k}").alias(f"h{k}") for k in axes)))
    top = levels.pop().select("at")
    pairs = top.select(F.col("at").alias("a"), F.col("at").alias("b"))
    for level in reversed(levels):

        def side(s: str, level=level) -> DataFrame:
            return level.select(F.floor(F.col("at") / _FAN).alias(s), F.col("at").alias(f"{s}_at"), *(F.col(c).alias(f"{s}_{c}") for c in level.columns[1:]))

        gaps = [F.greatest(F.lit(0.0), F.col(f"a_l{k}") - F.col(f"b_h{k}"), F.col(f"b_l{k}") - F.col(f"a_h{k}")) for k in axes]
        reach = sum((g * g for g in gaps), F.lit(0.0)) <= epsilon * epsilon + _SLACK
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("a_at") <= F.col("b_at")) & reach)
        pairs = stored(pairs.select(F.col("a_at").alias("a"), F.col("b_at").alias("b")))
    return pairs


def near_duplicates(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links (other rows linked), component_id (least vec_id reachable) and kept, of every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    shorter vectors count as padded by zeros. A null vec_id is never the least unless alone.
    Other columns are not read; an empty table gives no rows.
    """
    epsilon = float(np.sqrt(max(2 - 2 * cosine, 0)))
    rows = vectors.select("vec_id", "embedding")
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    width = max(width, 1)
    axes = _axes(rows, width)
    every = stored(_prepared(rows, width, axes, epsilon))
    ready = every.where("good")
    nodes = ready.groupBy("node").agg(F.count(F.lit(1)).alias("weight"), *(F.first(c).alias(c) for c in ("cell", "near", "vector")))
    placed = dense_position(nodes, [F.col("cell"), F.col("near"), F.col("node")], "place")
    placed = placed.select(
        "node", "weight", "vector", "place", F.floor(F.col("place") / STRIPE).alias("stripe"),
        *(F.get("near", F.lit(k)).alias(f"x{k}") for k in range(GRID_AXES)),
    )
    placed = stored(placed.fillna(0.0))
    pairs = _stripe_pairs(placed, epsilon)
    part = placed.select("stripe", "place", "node", "weight", "vector")
    ends = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("stripe"))
    found = ends.join(part, "stripe").groupBy("a", "b").applyInArrow(_compared(cosine, width), "node bigint, n_links bigint, root bigint")
    found = stored(found)
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    known = ready.groupBy("node").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    known = known.join(sums, "node", "left").join(labels.select(F.col("id").alias("node"), "component"), "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("node", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = ready.select("vec_id", "node").join(known, "node").select("vec_id", "n_links", "component_id")
    alone = every.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
