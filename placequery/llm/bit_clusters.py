"""Centroid clustering on bit planes.

Components become integers and their bits are stored plane by plane: plane j of a vector is one
64-bit word with bit j of each of the 64 components (two's complement, so the top plane weighs
negative). The dot product of two vectors is the sum over pairs of planes of the popcount of their
AND, weighted by powers of two; distances are exact integers. A vector has as many planes as its
widest component needs, so one wide vector does not widen the others.

Centroids are summed as bit counts per plane by Spark, map-side first; only these counts, bounded
by centroids, planes and components, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WIDTH = 64
# Vectors compared with all centroids at once.
_BLOCK = 2048
# Planes of which products still fit 64-bit sums; wider numbers are Python's.
_NARROW = 28
_BITS = np.uint64(1) << np.arange(WIDTH, dtype=np.uint64)


def integers(vector: np.ndarray, scale: int = 256) -> list[int]:
    """floor(scale * x) of each component, exact for every finite double (``scale`` a power of two)."""
    return [int(np.floor(x * scale)) if abs(x) < 2**53 else int(x) * scale for x in vector.tolist()]


def width_of(values: list[int]) -> int:
    """Planes that hold all ``values`` in two's complement."""
    return 1 + max((v if v >= 0 else ~v).bit_length() for v in values)


def planes(values: list[int], width: int) -> np.ndarray:
    """[width] 64-bit words; bit d of word j is bit j of component d."""
    if width <= 62:
        bits = np.array(values, np.int64)[None, :] >> np.arange(width, dtype=np.int64)[:, None] & 1
        return (bits.astype(np.uint64) * _BITS).sum(axis=1, dtype=np.uint64)
    return np.array([sum((v >> j & 1) << d for d, v in enumerate(values)) for j in range(width)], np.uint64)


def values_of(words: np.ndarray) -> list[int]:
    """The components of ``planes``."""
    bits = (words[:, None] & _BITS != 0).T
    top = len(words) - 1
    return [sum(int(b) << j for j, b in enumerate(row[:top])) - (int(row[top]) << top) for row in bits]


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """[n, k] exact dot products of planes [n, a] and [k, b]; object numbers where 64 bits do not hold them."""
    a, b = x.shape[1], c.shape[1]
    narrow = a <= _NARROW and b <= _NARROW
    total = np.zeros((len(x), len(c)), np.int64 if narrow else object)
    # Pairs of planes of one weight and sign share an accumulator of small counts.
    by_weight = defaultdict(list)
    for i in range(a):
        for j in range(b):
            by_weight[i + j, (i == a - 1) != (j == b - 1)].append((i, j))
    for (power, negative), pairs in by_weight.items():
        count = np.zeros(total.shape, np.uint32)
        for i, j in pairs:
            count += np.bitwise_count(x[:, i, None] & c[None, :, j])
        part = count.astype(np.int64) << power if narrow else count.astype(object) * (1 << power)
        total = total - part if negative else total + part
    return total


def _norms(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64 if x.shape[1] <= _NARROW else object)
    for n in range(0, len(x), _BLOCK):
        part = x[n : n + _BLOCK]
        a = part.shape[1]
        for i in range(a):
            for j in range(a):
                count = np.bitwise_count(part[:, i] & part[:, j]).astype(out.dtype)
                weight = -(1 << i + j) if (i == a - 1) != (j == a - 1) else 1 << i + j
                out[n : n + _BLOCK] += count * weight
    return out


class Centroids:
    """Centroids by width of their planes."""

    def __init__(self, values: list[list[int]]):
        self.values = values
        by_width = defaultdict(list)
        for k, v in enumerate(values):
            by_width[width_of(v)].append(k)
        self.groups = [(np.array(ks), np.stack([planes(values[k], w) for k in ks])) for w, ks in by_width.items()]
        self.norms = [sum(c * c for c in v) for v in values]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row of planes; of equals the least number."""
        own = _norms(x)
        low, number = self._nearest(x, own, *self.groups[0])
        for ks, c in self.groups[1:]:
            best, who = self._nearest(x, own, ks, c)
            better = (best < low) | ((best == low) & (who < number))
            low, number = np.where(better, best, low), np.where(better, who, number)
        return number, low

    def _nearest(self, x: np.ndarray, own: np.ndarray, ks: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, number = [], []
        for n in range(0, len(x), _BLOCK):
            product = dots(x[n : n + _BLOCK], c)
            kind = object if object in (product.dtype, own.dtype) else np.int64
            norms = np.array([self.norms[k] for k in ks], kind)
            d = own[n : n + _BLOCK, None].astype(kind) + norms - 2 * product.astype(kind)
            at = d.argmin(axis=1)
            low.append(d[np.arange(len(d)), at])
            number.append(ks[at])
        return np.concatenate(low), np.concatenate(number)


def _by_width(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, planes) of rows of one width."""
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    sizes = np.diff(ends) // 8
    data = np.frombuffer(data or b"", np.uint8)
    for w in np.unique(sizes):
        rows = np.flatnonzero(sizes == w)
        # One gather of equal-length rows.
        yield rows, np.ascontiguousarray(data[ends[rows][:, None] + np.arange(8 * w)]).view("<u8")


def sound(vec: str, width: int = WIDTH) -> Column:
    """Vectors of ``width`` components, none null or non-finite."""
    x = F.col(vec)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return x.isNotNull() & (F.size(x) == width) & fine


def pack(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and planes of every sound vector; other vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, WIDTH)
            out = []
            for start in range(0, len(x), _BLOCK):
                part = x[start : start + _BLOCK]
                if np.abs(part).max() >= 2**40:
                    out += [planes(v, width_of(v)).astype("<u8").tobytes() for v in (integers(row, scale) for row in part)]
                    continue
                values = np.floor(part * scale).astype(np.int64)
                widest = np.maximum(values, ~values).max(axis=1)
                widths = 1 + np.where(widest > 0, np.frexp(widest.astype(np.float64))[1], 0)
                words = np.stack([((values >> j & 1).astype(np.uint64) * _BITS).sum(axis=1, dtype=np.uint64) for j in range(int(widths.max()))], axis=1)
                out += [row[:w].astype("<u8").tobytes() for row, w in zip(words, widths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "words"])

    rows = vectors.where(sound(vec)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("_x"))
    return rows.mapInArrow(run, "vec_id bigint, words binary")


def seeds(packed: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors of least SHA-256 of ``seed:vec_id``; a null id counts as an empty string, of equals the least planes come first."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    # At most k rows reach the driver.
    return [values_of(np.frombuffer(r["words"], "<u8")) for r in packed.orderBy(F.sha2(name, 256), "words").limit(k).collect()]


def assign(packed: DataFrame, centroids: Centroids) -> DataFrame:
    """vec_id, cluster and squared distance of every vector; a distance beyond 64 bits is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, object)
            for rows, x in _by_width(batch.column(1)):
                cluster[rows], distance[rows] = centroids.nearest(x)
            held = [int(d) if d < 2**63 else None for d in distance]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(held, pa.int64())], ["vec_id", "cluster", "distance"])

    return packed.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


_COUNTS = [f"c{d}" for d in range(WIDTH)]


def moved(packed: DataFrame, centroids: Centroids) -> Centroids:
    """Centroids after one round: floor of the mean of their vectors; empty ones stay.

    A task counts set bits per (cluster, plane, sign) of its vectors; Spark adds the counts up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int, bool], np.ndarray] = {}
        for batch in batches:
            for rows, x in _by_width(batch.column(1)):
                cluster, _ = centroids.nearest(x)
                for k in np.unique(cluster):
                    mine = x[cluster == k]
                    for j in range(x.shape[1]):
                        bits = np.unpackbits(np.ascontiguousarray(mine[:, j]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                        key = (int(k), j, j == x.shape[1] - 1)
                        totals[key] = totals.get(key, 0) + bits.sum(axis=0, dtype=np.int64)
                    # Plane -1 counts the vectors.
                    key = (int(k), -1, False)
                    totals[key] = totals.get(key, 0) + np.full(WIDTH, len(mine), np.int64)
        if totals:
            keys = list(totals)
            counts = np.stack([totals[key] for key in keys])
            columns = [pa.array([key[0] for key in keys], pa.int32()), pa.array([key[1] for key in keys], pa.int32()), pa.array([key[2] for key in keys])]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(counts[:, d]) for d in range(WIDTH)], ["cluster", "plane", "negative", *_COUNTS])

    schema = "cluster int, plane int, negative boolean, " + ", ".join(f"{c} bigint" for c in _COUNTS)
    counted = packed.mapInArrow(run, schema).groupBy("cluster", "plane", "negative").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    sums, sizes = defaultdict(lambda: [0] * WIDTH), {}
    for row in counted.collect():
        counts = row[3:]
        if row["plane"] < 0:
            sizes[row["cluster"]] = counts[0]
            continue
        weight = -(1 << row["plane"]) if row["negative"] else 1 << row["plane"]
        sums[row["cluster"]] = [s + weight * c for s, c in zip(sums[row["cluster"]], counts, strict=True)]
    return Centroids([[s // sizes[k] for s in sums[k]] if k in sizes else v for k, v in enumerate(centroids.values)])


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every sound vector.

    Vectors with another number of components, or with null or non-finite ones, are left out; rows
    that repeat a vec_id or a vector count each; with fewer than ``k`` vectors there are as many
    centroids as vectors; without any the result is empty. Distances and sums beyond 64 bits are
    null. Other columns are not read.
    """
    packed = stored(pack(vectors, scale=scale))
    now = Centroids(seeds(packed, k, seed))
    if now.values:
        for _ in range(rounds):
            now = moved(packed, now)
    found = stored(assign(packed, now))

    per = found.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), F.try_sum("distance")).alias("sum"))
    # One row per centroid.
    sums = {r["cluster"]: r["sum"] for r in per.collect()}
    total = None if None in sums.values() else sum(sums.values())
    total = total if total is None or total < 2**63 else None
    facts = [(n, sums[n], total, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for n, v in enumerate(now.values) if n in sums]
    facts = found.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
