"""Clustering on bit planes against plain integer arithmetic."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from placequery.llm import bit_clusters


def plain_version(rows, k, rounds):
    kept = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: name(r[0]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        where = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), w in zip(kept, where, strict=True) if w == n]
            if mine:
                centroids[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = sum(d for *_, d in out)
    per = {n: sum(d for _, c, d in out if c == n) for n in range(len(centroids))}
    return sorted(((i, c, d, per[c], total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in out), key=str)


def vectors(n, seed, scale=1.0):
    rnd = random.Random(seed)
    middles = [[rnd.gauss(0, 0.3) for _ in range(64)] for _ in range(5)]
    return [(i, [scale * (m + rnd.gauss(0, 0.1)) for m in rnd.choice(middles)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, words string")


def found(spark, rows, k, rounds):
    return sorted((tuple(r) for r in bit_clusters.clusters(frame(spark, rows), k, rounds).collect()), key=str)


@pytest.mark.parametrize("scale", [1.0, 40.0, 1e-4])
def test_clusters(spark, scale):
    odd = [(900, None), (901, [0.5] * 63), (902, [0.5] * 63 + [None]), (903, [0.5] * 63 + [float("nan")]), (904, [float("-inf")] + [0.5] * 63),
           (905, [0.0] * 64), (906, [0.0] * 64), (907, [-0.001] * 64), (3, [0.25] * 64), (None, [0.125] * 64)]
    rows = vectors(120, 4, scale) + odd
    assert found(spark, rows, 7, 5) == plain_version(rows, 7, 5)


def test_wide_components(spark):
    rows = vectors(40, 9) + [(100, [1e6] * 64), (101, [2.0**45 + 0.5] + [0.0] * 63), (102, [-(2.0**45)] + [-1.0] * 63), (103, [3e38] + [0.0] * 63), (104, [1e308] * 64)]
    got, expected = found(spark, rows, 6, 3), plain_version(rows, 6, 3)
    assert [r[:2] + r[5:] for r in got] == [r[:2] + r[5:] for r in expected]
    narrow = lambda v: v if v < 2**63 else None
    assert [r[2] for r in got] == [narrow(r[2]) for r in expected]


def test_few_or_no_vectors(spark):
    rows = [(4, [0.5] * 64), (4, [0.5] * 64), (9, [0.25] * 64)]
    assert found(spark, rows, 40, 5) == plain_version(rows, 40, 5)
    assert found(spark, [(1, None), (2, [1.0])], 40, 5) == [] and found(spark, [], 40, 5) == []


def test_dots_of_all_widths():
    rnd = random.Random(1)
    for a, b in ((1, 1), (3, 9), (28, 28), (30, 5), (70, 140)):
        x = [[rnd.randrange(-(1 << a - 1), 1 << a - 1) for _ in range(64)] for _ in range(5)]
        c = [[rnd.randrange(-(1 << b - 1), 1 << b - 1) for _ in range(64)] for _ in range(3)]
        got = bit_clusters.dots(np.stack([bit_clusters.planes(v, a) for v in x]), np.stack([bit_clusters.planes(v, b) for v in c]))
        assert got.tolist() == [[sum(p * q for p, q in zip(v, w, strict=True)) for w in c] for v in x]
        assert [bit_clusters.values_of(bit_clusters.planes(v, a)) for v in x] == x
