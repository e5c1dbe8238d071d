"""Brute-force comparisons, many-block and hot-key cases, and plan checks."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from placequery.functions import blocks, ordering, skew, storage
from placequery.operators import (
    aggregate, burst, graph, margins, masks, mining, pooling, reduce, regions, search, spatial, suppression, transport, vocabulary, wide_pca,
)
from placequery.operators.vocabulary import Vocabulary
from placequery.sources import results

RNG = np.random.default_rng(0)


def vectors(spark, x, name, parts=3):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, f"{name} BIGINT, vec ARRAY<DOUBLE>").repartition(parts)


def brute_knn(q, r, k):
    d = ((q[:, None, :] - r[None]) ** 2).sum(2)
    return {(i, int(j), n + 1) for i in range(len(q)) for n, j in enumerate(np.lexsort((np.arange(len(r)), d[i]))[:k])}


@pytest.mark.parametrize("mode", ["broadcast", "tiles", "flushing"])
def test_knn_equals_brute_force(spark, monkeypatch, mode):
    q, r = RNG.normal(size=(37, 6)), RNG.normal(size=(211, 6))
    r[50:60] = r[40]  # equal vectors: ties by id
    if mode != "broadcast":
        monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    if mode == "flushing":
        monkeypatch.setattr(search, "STATE_BYTES", 1)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 8 * 6 * 10)
    got = search.knn_l2(vectors(spark, q, "qi"), vectors(spark, r, "ri"), 12, q_ids=["qi"], r_ids=["ri"])
    assert {(x.qi, x.ri, x.rank) for x in got.collect()} == brute_knn(q, r, 12)


@pytest.mark.parametrize(("n_q", "n_r", "width", "slots"), [(10**9, 10**10, 1024, 1000), (10**6, 10**9, 49152, 8), (10, 10**9, 64, 100), (5, 3, 8, 1), (0, 0, 0, 4)])
def test_stripes_are_bounded_in_bytes(n_q, n_r, width, slots):
    a, b = search._tiles(n_q, n_r, width, slots)
    assert n_q * width * 8 <= a * search.QUERY_STRIPE_BYTES and n_r * width * 8 <= b * search.REF_STRIPE_BYTES
    assert a * b >= 4 * slots


def test_every_tile_is_a_partition(spark, monkeypatch):
    """No two tiles share a task, and every query block meets every reference block in one."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 8 * 4 * 3)
    q, r = (vectors(spark, RNG.normal(size=(n, 4)), name).withColumnRenamed("vec", "_v") for n, name in ((40, "qi"), (90, "ri")))
    tiles = search._tile_rows(q, r, ["qi"], ["ri"], 3, 5)
    rows = tiles.select(F.spark_partition_id().alias("part"), "_tile", "_side", "qi_ids", "ri_ids", F.monotonically_increasing_id().alias("at")).orderBy("at").collect()
    assert {(x.part, x._tile) for x in rows} == {(t, t) for t in range(15)}
    pairs = set()
    for t in range(15):
        mine = [x for x in rows if x._tile == t]
        assert [x._side for x in mine] == sorted(x._side for x in mine)
        pairs |= {(i, j) for x in mine if x._side == 0 for i in x.qi_ids for y in mine if y._side == 1 for j in y.ri_ids}
    assert pairs == {(i, j) for i in range(40) for j in range(90)}


def test_search_memory_does_not_grow_with_the_product_of_block_sizes(monkeypatch):
    monkeypatch.setattr(search, "SCORE_BYTES", 1 << 20)
    q, r = RNG.normal(size=(3000, 4)), RNG.normal(size=(3000, 4))
    tracemalloc.start()
    rows, (found,), values = search._block_best(q, r, [np.arange(3000)], 3, "l2")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3000 * 3000 * 8 / 4  # a quarter of the distances
    assert {(i, j, n % 3 + 1) for n, (i, j) in enumerate(zip(rows.tolist(), found.tolist()))} == brute_knn(q, r, 3)


def test_search_temporaries_stay_small_beside_full_blocks():
    """A block pair of full size needs a few slices of distances, whatever its metric."""
    q, r = RNG.normal(size=(1500, 8)), RNG.normal(size=(16384, 8))
    for metric in ("l2", "ip"):
        tracemalloc.start()
        search._block_best(q, r, [np.arange(len(r))], 20, metric)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 24 << 20


def test_candidates_are_merged_in_slices_of_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "MERGE_BYTES", 8 * 3 * 12 * 5)
    monkeypatch.setattr(search, "SCORE_BYTES", 8 * 100)
    q, r = RNG.normal(size=(37, 6)), RNG.normal(size=(211, 6))
    for state in (search.STATE_BYTES, 8 * 3 * 12 * 36):  # too many candidates for a broadcast
        monkeypatch.setattr(search, "STATE_BYTES", state)
        found = search.knn_l2(vectors(spark, q, "qi"), vectors(spark, r, "ri"), 12, q_ids=["qi"], r_ids=["ri"])
        assert {(x.qi, x.ri, x.rank) for x in found.collect()} == brute_knn(q, r, 12)


def test_stripes_leave_room_for_candidates():
    a, _ = search._tiles(10**6, 10**6, 64, 8, 200 * 32)
    assert 10**6 * 200 * 32 <= a * search.QUERY_STRIPE_BYTES


def test_knn_with_more_neighbours_than_references(spark):
    got = search.knn_l2(vectors(spark, RNG.normal(size=(3, 4)), "qi"), vectors(spark, RNG.normal(size=(5, 4)), "ri"), 9, q_ids=["qi"], r_ids=["ri"])
    assert got.count() == 15
    with pytest.raises(ValueError):
        search.knn_ip(got, got, 1, metric="hamming", q_ids=["qi"], r_ids=["ri"])


def test_knn_plan_has_no_cartesian_product(spark):
    q, r = vectors(spark, RNG.normal(size=(5, 4)), "qi"), vectors(spark, RNG.normal(size=(5, 4)), "ri")
    plan = search.knn_l2(q, r, 3, q_ids=["qi"], r_ids=["ri"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def points(spark, xyz, first=0):
    return spark.createDataFrame([(first + i, *map(float, p)) for i, p in enumerate(xyz)], "image_id BIGINT, x DOUBLE, y DOUBLE, z DOUBLE")


def test_nearest_within_ranks_few_of_the_pairs(spark, monkeypatch):
    q, r = np.zeros((3, 3)), RNG.normal(size=(400, 3)).round(1)
    q[1, 0], q[2, 0] = 1, 1000  # one query without references
    ranked = []
    plain = spatial.top_per_group
    monkeypatch.setattr(spatial, "top_per_group", lambda df, *rest: ranked.append(df.count()) or plain(df, *rest))
    got = {(x.q_image, x.r_image, x.n) for x in spatial.nearest_within(points(spark, q), points(spark, r), 9.0, 5).collect()}
    d = np.sqrt(((q[:, None, :2] - r[None, :, :2]) ** 2).sum(2))
    assert got == {(i, int(j), n + 1) for i in (0, 1) for n, j in enumerate(np.lexsort((np.arange(400), d[i]))[:5])}
    assert ranked[0] < 80  # of 800 pairs


@pytest.mark.parametrize("hot", [False, True])
def test_radius_join_equals_brute_force(spark, monkeypatch, hot):
    q, r = RNG.uniform(-20, 20, (40, 3)), RNG.uniform(-20, 20, (150, 3))
    if hot:
        # A third of both sides sits in one cell; pieces of ten rows force salting.
        q[:15] = [1.0, 1.0, 1.0] + RNG.uniform(0, 0.5, (15, 3))
        r[:50] = [1.0, 1.0, 1.0] + RNG.uniform(0, 0.5, (50, 3))
        monkeypatch.setattr(skew, "SPLIT_ROWS", 10)
    got = {(x.q_image, x.r_image) for x in spatial.radius_join(points(spark, q), points(spark, r), 4.0).collect()}
    d = np.hypot(q[:, None, 0] - r[None, :, 0], q[:, None, 1] - r[None, :, 1])
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 4.0))}


@pytest.mark.parametrize("split", [3, 7, 1000])
def test_salted_join_keeps_every_pair(spark, split):
    left = spark.range(20).select((F.col("id") % 2).alias("k"), F.col("id").alias("a"))
    right = spark.range(60).select(F.when(F.col("id") < 50, 0).otherwise(1).cast("long").alias("k"), F.col("id").alias("b"))
    got = skew.salted_join(left, right, ["k"], split_rows=split)
    want = left.join(right, "k")
    assert sorted(map(tuple, got.select("k", "a", "b").collect())) == sorted(map(tuple, want.select("k", "a", "b").collect()))


def test_positions_and_running_totals_on_a_hot_group(spark):
    df = spark.range(500).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 7).alias("g"), (F.col("id") * 37 % 500).alias("v"))
    got = {}
    for r in ordering.dense_position(df, [F.col("v")], "pos", ["g"]).collect():
        got.setdefault(r.g, []).append((r.pos, r.v))
    for rows in got.values():
        rows.sort()
        assert [p for p, _ in rows] == list(range(len(rows)))
        assert [v for _, v in rows] == sorted(v for _, v in rows)
    total = ordering.running_total(df, [F.col("v")], "v", "t").orderBy("v").collect()
    assert [r.t for r in total] == np.cumsum([r.v for r in total]).tolist()


def greedy(boxes, threshold):
    order = sorted(range(len(boxes)), key=lambda i: (-boxes[i][6], boxes[i][1]))
    kept = []
    for i in order:
        a = boxes[i][2:6]
        for j in kept:
            b = boxes[j][2:6]
            w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            inter = max(w, 0) * max(h, 0)
            union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
            if inter > threshold * union:
                break
        else:
            kept.append(i)
    return {boxes[i][1] for i in kept}


def chain(image, n):
    """Boxes in a row; each overlaps the next by 3/7 and is better than it."""
    return [(image, i, 4.0 * i, 0.0, 4.0 * i + 10, 10.0, float(n - i)) for i in range(n)]


def test_suppression_of_a_long_chain(spark, monkeypatch):
    """A thousand boxes in one pass; where an image is too large for it, a round per link."""
    schema = "image_id BIGINT, seg_id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, predicted_iou DOUBLE"
    rows = chain(1, 1000) + chain(2, 7)
    kept = suppression.nms_boxes(spark.createDataFrame(rows, schema), 0.3).collect()
    assert sorted((r.image_id, r.seg_id) for r in kept) == [(1, i) for i in range(0, 1000, 2)] + [(2, i) for i in range(0, 7, 2)]
    monkeypatch.setattr(suppression, "STREAM_PAIRS", 8)
    calls = []
    monkeypatch.setattr(suppression, "cut_lineage", lambda df: calls.append(1) or storage.cut_lineage(df))
    rows = chain(1, 14) + chain(2, 7)
    kept = suppression.nms_boxes(spark.createDataFrame(rows, schema), 0.3).collect()
    assert sorted((r.image_id, r.seg_id) for r in kept) == [(1, i) for i in range(0, 14, 2)] + [(2, i) for i in range(0, 7, 2)]
    # Three tables before, one per round after: seven rounds decide, the last finds nothing left.
    assert len(calls) == 3 + 8


@pytest.mark.parametrize("pairs", [1 << 20, 0])
@pytest.mark.parametrize("threshold", [0.2, 0.7])
def test_suppression_equals_greedy(spark, monkeypatch, threshold, pairs):
    monkeypatch.setattr(suppression, "STREAM_PAIRS", pairs)
    xy = RNG.integers(0, 200, (150, 2)).astype(float)
    wh = RNG.integers(0, 90, (150, 2)).astype(float)
    rows = [(0, i, *p, *(p + s), float(v)) for i, (p, s, v) in enumerate(zip(xy, wh, RNG.integers(0, 5, 150)))]
    rows += [(0, 200 + i, *rows[3][2:6], 1.0) for i in range(30)]
    schema = "image_id BIGINT, seg_id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, predicted_iou DOUBLE"
    rows = [tuple(float(v) if i > 1 else v for i, v in enumerate(r)) for r in rows]
    kept = suppression.nms_boxes(spark.createDataFrame(rows, schema), threshold).collect()
    assert {r.seg_id for r in kept} == greedy(rows, threshold)


def circumcircle_edges(p):
    n, out = len(p), set()
    for i in range(n):
        for j in range(i + 1, n):
            for k in range(j + 1, n):
                a, b, c = p[i], p[j], p[k]
                d = 2 * ((b - a)[0] * (c - a)[1] - (b - a)[1] * (c - a)[0])
                if abs(d) < 1e-12:
                    continue
                u = np.array([(c - a)[1] * ((b - a) @ (b - a)) - (b - a)[1] * ((c - a) @ (c - a)),
                              (b - a)[0] * ((c - a) @ (c - a)) - (c - a)[0] * ((b - a) @ (b - a))]) / d
                if not (((p - a - u) ** 2).sum(1) < u @ u - 1e-9).any():
                    out |= {(i, j), (i, k), (j, k)}
    return out


def test_triangulation_has_empty_circles():
    for n in (4, 5, 9, 25):
        p = RNG.uniform(0, 100, (n, 2))
        assert graph.triangulate(p) == circumcircle_edges(p)


def test_triangulation_of_a_line_links_neighbours():
    assert graph.triangulate(np.array([[3.0, 3.0], [1.0, 1.0], [2.0, 2.0], [0.0, 0.0]])) == {(1, 3), (1, 2), (0, 2)}


def test_triangulation_of_a_grid_is_planar():
    p = np.array([(x, y) for x in range(5) for y in range(4)], dtype=float)
    # Any triangulation of n points with h on the hull has 3n - 3 - h edges.
    assert len(graph.triangulate(p)) == 3 * 20 - 3 - 14


def test_large_images_in_strips_equal_one_triangulation(spark, monkeypatch):
    monkeypatch.setattr(graph, "STRIP_SEGMENTS", 25)
    rows, want = [], set()
    for image, n in ((0, 120), (1, 60), (2, 10)):
        p = RNG.uniform(0, 100, (n, 2))
        rows += [(image, i, float(a), float(b)) for i, (a, b) in enumerate(p)]
        for i, j in graph.triangulate(p):
            want |= {(image, i, j), (image, j, i)}
        want |= {(image, i, i) for i in range(n)}
    df = spark.createDataFrame(rows, "image_id BIGINT, seg_id BIGINT, cx DOUBLE, cy DOUBLE")
    got = [(r.image_id, r.seg_a, r.seg_b) for r in graph.delaunay_edges(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_strips_agree_on_grids_circles_lines_and_duplicates(spark, monkeypatch):
    grid = [(float(x), float(y)) for x in range(12) for y in range(12)]
    circle = [(50 + 40 * np.cos(a), 50 + 40 * np.sin(a)) for a in np.linspace(0, 2 * np.pi, 60, endpoint=False)]
    slanted = [(0.3 * x + 0.1 * y, 0.7 * y - 0.2 * x) for x, y in grid[:96]]
    line = [(1.0 * k, 2.0 * k) for k in range(60)]
    images = [grid, circle, slanted, line, [*grid[:70], *grid[:20]]]
    rows = [(i, k, float(x), float(y)) for i, points in enumerate(images) for k, (x, y) in enumerate(points)]
    df = spark.createDataFrame(rows, "image_id BIGINT, seg_id BIGINT, cx DOUBLE, cy DOUBLE")
    names = {(i, k): (x, y) for i, k, x, y in rows}

    def edges():
        return {(r.image_id, names[r.image_id, r.seg_a], names[r.image_id, r.seg_b]) for r in graph.delaunay_edges(df).collect()}

    whole = edges()
    monkeypatch.setattr(graph, "STRIP_SEGMENTS", 25)
    assert edges() == whole
    one_way = sum(1 for i, a, b in whole if i == 0 and a < b)
    assert one_way == 3 * 144 - 3 - 44


def test_one_sided_hot_key_is_split(spark):
    left = spark.createDataFrame([(1, i) for i in range(90)] + [(2, 0)], "k int, a int")
    right = spark.createDataFrame([(1, 5), (2, 6)], "k int, b int")
    joined = skew.salted_join(left, right, ["k"], split_rows=10)
    assert sorted(map(tuple, joined.collect())) == sorted([(1, i, 5) for i in range(90)] + [(2, 0, 6)])
    assert "_sl" in joined._jdf.queryExecution().analyzed().toString()


def test_lists_are_cut_by_position(spark, monkeypatch):
    monkeypatch.setattr(results, "PART_ENTRIES", 2)
    info = spark.createDataFrame([(0, 0, 1, 20005, 1), (0, 1, 2, 5, 2)], "q_image long, q_seg long, r_seg long, r_image long, r_rank long")
    gt = spark.createDataFrame([(0, 5), (0, 10005), (0, 20005)], "q_image long, r_image long")
    found = results.match_records(info, gt, spark.createDataFrame([(0,)], "q_image long")).where("kind = 'gt'").collect()
    assert sorted((r.part, r.payload) for r in found) == [(0, "[5,10005]"), (1, "[20005]")]


def test_hops_grow_with_order(spark):
    p = RNG.uniform(0, 100, (30, 2))
    df = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(p)], "image_id BIGINT, seg_id BIGINT, cx DOUBLE, cy DOUBLE")
    edges = storage.cut_lineage(graph.delaunay_edges(df))
    adj = np.eye(30, dtype=int)
    for i, j in graph.triangulate(p):
        adj[i, j] = adj[j, i] = 1
    for order in (1, 2, 3):
        got = {(r.seg_a, r.seg_b) for r in graph.expand_hops(edges, order).collect()}
        assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.linalg.matrix_power(adj, order)))}
    assert graph.expand_hops(edges, 0, df).count() == 30


def random_masks(spark, n=25, h=9, w=7):
    grids = RNG.random((n, h, w)) > RNG.random((n, 1, 1))
    grids[0], grids[1] = False, True
    rows = [(i // 5, i % 5, h, w, [bool(v) for v in g.T.ravel()]) for i, g in enumerate(grids)]
    df = spark.createDataFrame(rows, "image_id BIGINT, seg_id INT, h INT, w INT, bits ARRAY<BOOLEAN>")
    return grids, df.select("image_id", "seg_id", "h", "w", masks.rle_from_bits(F.col("bits")).alias("rle"))


def test_run_lengths_round_trip(spark):
    grids, df = random_masks(spark)
    pixels = masks.rle_decode(df)
    assert {(r.image_id * 5 + r.seg_id, r.y, r.x) for r in pixels.collect()} == {tuple(map(int, t)) for t in zip(*np.nonzero(grids))}
    again = masks.rle_encode(pixels, df.select("image_id", "seg_id", "h", "w"))
    assert sorted((r.image_id, r.seg_id, tuple(r.rle)) for r in again.collect()) == sorted((r.image_id, r.seg_id, tuple(r.rle)) for r in df.collect())


def flood(mask):
    label, out = np.zeros(mask.shape, int), []
    for y, x in zip(*np.nonzero(mask)):
        if label[y, x]:
            continue
        stack, size = [(y, x)], 0
        label[y, x] = len(out) + 1
        while stack:
            a, b = stack.pop()
            size += 1
            for c in range(max(a - 1, 0), min(a + 2, mask.shape[0])):
                for d in range(max(b - 1, 0), min(b + 2, mask.shape[1])):
                    if mask[c, d] and not label[c, d]:
                        label[c, d] = len(out) + 1
                        stack.append((c, d))
        out.append(size)
    return label, out


def cleaned(mask, area):
    changed = False
    label, sizes = flood(~mask)
    small = [i + 1 for i, s in enumerate(sizes) if s < area]
    if small:
        mask, changed = mask | np.isin(label, small), True
    label, sizes = flood(mask)
    if any(s < area for s in sizes):
        keep = [i + 1 for i, s in enumerate(sizes) if s >= area] or [int(np.argmax(sizes)) + 1]
        mask, changed = np.isin(label, keep), True
    return mask, changed


@pytest.mark.parametrize("area", [3, 12])
def test_region_cleaning_equals_flood_fill(spark, area):
    grids, df = random_masks(spark)
    for r in regions.clean_masks(df, area).collect():
        want, changed = cleaned(grids[r.image_id * 5 + r.seg_id], area)
        ends = np.cumsum(r.rle)
        got = np.zeros(63, bool)
        for s, e in zip(ends[0::2], ends[1::2]):
            got[s:e] = True
        assert (got.reshape(7, 9).T == want).all() and r.unchanged == (not changed)


def patch_frame(spark, x, image=None):
    image = np.zeros(len(x), int) if image is None else image
    seen, rows = {}, []
    for i, v in zip(image, x):
        rows.append((int(i), seen.get(int(i), 0), v.tolist()))
        seen[int(i)] = seen.get(int(i), 0) + 1
    return spark.createDataFrame(rows, "image_id BIGINT, patch_id INT, embedding ARRAY<DOUBLE>")


def test_burst_weights_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 7)
    x = RNG.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    image = np.r_[np.zeros(40, int), np.arange(20) % 4 + 1]
    got = {(r.image_id, r.patch_id): r.w for r in burst.burst_weights(patch_frame(spark, x, image)).collect()}
    for i in range(5):
        own = x[image == i]
        want = (1 / (1 + np.exp(-(8 * (-2 + 2 * own @ own.T) + 7)))).sum(1)
        assert [got[i, j] for j in range(len(own))] == pytest.approx(want.tolist())


def log_sum(z, axis):
    m = z.max(axis=axis, keepdims=True)
    return (np.log(np.exp(z - m).sum(axis=axis, keepdims=True)) + m).squeeze(axis)


def test_transport_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 6)
    s = RNG.normal(size=(40, 4)) * 3
    df = patch_frame(spark, s).withColumnRenamed("embedding", "scores")
    got = {r.patch_id: r.assignment for r in transport.sinkhorn_assign(df, 4).collect()}
    z = np.vstack([s.T, np.ones(40)])
    norm = -np.log(44)
    mu, nu = np.r_[np.full(4, norm), np.log(36) + norm], np.full(40, norm)
    u, v = np.zeros(5), np.zeros(40)
    for _ in range(3):
        u = mu - log_sum(z + v[None], 1)
        v = nu - log_sum(z + u[:, None], 0)
    want = np.exp(z + u[:, None] + v[None] - norm)[:-1].T
    assert np.array([got[i] for i in range(40)]) == pytest.approx(want)


def test_mining_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 8)
    x = RNG.normal(size=(50, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = RNG.integers(0, 4, 50)
    df = spark.createDataFrame([(0, i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x))], "batch INT, id BIGINT, label INT, vec ARRAY<DOUBLE>")
    d = np.sqrt(np.maximum(2 - 2 * x @ x.T, 0))
    want = {(a, p, n) for a in range(50) for p in range(50) for n in range(50)
            if a != p and label[a] == label[p] and label[a] != label[n] and 0 < d[a, n] - d[a, p] <= 0.1}
    assert {(r.anchor, r.positive, r.negative) for r in mining.mine_triplets(df, 0.1).collect()} == want
    pairs = {(r.anchor, r.other) for r in mining.mine_pairs(df).collect()}
    s = x @ x.T
    assert pairs == {(a, b) for a in range(50) for b in range(50) if a != b and (s[a, b] < 0.7 if label[a] == label[b] else s[a, b] > 0.3)}


def test_sparse_ids_fill_their_blocks(spark):
    """Four hundred ids far apart are one block a group; close ids are cut as they are."""
    rows = [(g, i * 10**9 + g, [float(i), 1.0]) for g in range(3) for i in range(400)]
    df = spark.createDataFrame(rows, "g long, id long, vec array<double>")
    sparse = blocks.group_blocks(df, ["g"], "id", "vec", any_ids=True).collect()
    assert sorted((r.g, r.chunk, len(r.ids)) for r in sparse) == [(g, 0, 400) for g in range(3)]
    assert all(r.flat[::2] == [float(i) for i in range(400)] and r.ids[1] == 10**9 + r.g for r in sparse)
    assert blocks.group_blocks(df, ["g"], "id", "vec").count() == 1200
    cut = blocks.group_blocks(df, ["g"], "id", "vec", rows=150, any_ids=True).collect()
    assert sorted((r.g, r.chunk, len(r.ids)) for r in cut) == [(g, c, n) for g in range(3) for c, n in ((0, 150), (1, 150), (2, 100))]
    close = spark.createDataFrame([(0, i, [0.0]) for i in range(5000)], "g long, id long, vec array<double>")
    assert not blocks.scattered(close, ["g"], "id", 2048) and blocks.scattered(df, ["g"], "id", 2048)


def test_pca_axes_are_orthonormal_and_whiten(spark):
    x = RNG.normal(size=(200, 6)) @ RNG.normal(size=(6, 6))
    df = vectors(spark, x, "i")
    model = reduce.fit_pca(df, 4)
    assert model.axes @ model.axes.T == pytest.approx(np.eye(4), abs=1e-9)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1][:4]
    assert model.variance == pytest.approx(values)
    y = np.array([r.reduced for r in reduce.apply_pca(df, model).collect()])
    assert np.cov(y.T) == pytest.approx(np.eye(4), abs=1e-8)


def test_wide_data_takes_the_distributed_route(spark, monkeypatch):
    x = RNG.normal(size=(12, 30))
    df = vectors(spark, x, "i")
    dual = reduce.fit_pca(df, 5)
    monkeypatch.setattr(reduce, "MAX_GRAM_ROWS", 5)
    narrow = reduce.fit_pca(df, 5)
    monkeypatch.setattr(reduce, "MAX_COVARIANCE_DIM", 10)
    wide = reduce.fit_pca(df, 5)
    for other in (wide, dual):
        assert other.variance == pytest.approx(narrow.variance)
        assert other.mean == pytest.approx(narrow.mean)
        assert other.axes == pytest.approx(narrow.axes, abs=1e-8)


@pytest.mark.parametrize("slice_bytes", [8 << 20, 8 * 14 * 7])
def test_gram_route_equals_covariance_route_under_rank_loss(spark, monkeypatch, slice_bytes):
    """Rank 4 in 40 dimensions, with repeated rows, in one slice and in many."""
    monkeypatch.setattr(wide_pca, "BLOCK_BYTES", slice_bytes)
    x = np.vstack([RNG.normal(size=(10, 4)) @ RNG.normal(size=(4, 40))] * 2)[:14] + 3
    df = vectors(spark, x, "i")
    dual = reduce.fit_pca(df, 4)
    table = {r.component: r for r in reduce.fit_pca_table(df, 4, eps=0.5).collect()}
    assert np.array([table[k].axis for k in range(4)]) == pytest.approx(dual.axes)
    assert [table[k].variance for k in range(4)] == pytest.approx(list(dual.variance + 0.5))
    with pytest.raises(ValueError, match="vary along 4"):
        reduce.fit_pca(df, 5)
    with pytest.raises(ValueError, match="13 at most"):
        reduce.fit_pca(df, 14)
    with pytest.raises(ValueError, match="vary along 4"):
        reduce.fit_pca_table(df, 5)
    monkeypatch.setattr(reduce, "MAX_GRAM_ROWS", 5)
    covariance = reduce.fit_pca(df, 4)
    assert dual.variance == pytest.approx(covariance.variance)
    assert dual.axes == pytest.approx(covariance.axes, abs=1e-8)
    with pytest.raises(ValueError, match="vary along 4"):
        reduce.fit_pca(df, 5)
    values, axes = np.linalg.eigh(np.cov(x.T))
    assert dual.variance == pytest.approx(values[::-1][:4])
    assert np.abs(dual.axes @ axes[:, ::-1][:, :4]) == pytest.approx(np.eye(4), abs=1e-8)


@pytest.mark.parametrize("side", [None, 7])
def test_stored_model_beyond_the_limit_is_applied_in_blocks(spark, monkeypatch, side):
    """Shaped like 8,192 axes of 49,152 dimensions, in small."""
    monkeypatch.setattr(wide_pca, "BLOCK_BYTES", 8 * 7 * 5 if side else 8 << 20)
    x, axes, mean = RNG.normal(size=(23, 48)), RNG.normal(size=(16, 48)), RNG.normal(size=48)
    variance = np.r_[RNG.random(15) + 0.1, 0.0]
    rows = [(i % 5, -i, "kept", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "image_id int, seg_id long, note string, vec array<double>")
    table = reduce.model_table(spark, reduce.Model(mean, axes, variance))
    want = (x - mean) @ axes.T / np.sqrt(np.where(variance > 0, variance, 1))
    for limit in (1 << 30, 100):
        got = {-r.seg_id: np.array(r.reduced) for r in wide_pca.apply_table(df, table, ["image_id", "seg_id"], max_bytes=limit).collect()}
        assert np.array([got[i] for i in range(23)]) == pytest.approx(want)
    direct = wide_pca.project_blocks(df, table, ["image_id", "seg_id"], "vec", "reduced", side)
    assert set(direct.columns) == {"image_id", "seg_id", "note", "vec", "reduced"} and direct.count() == 23
    unit = wide_pca.apply_table(df, table, ["image_id", "seg_id"], normalize=True, max_bytes=100)
    assert [np.linalg.norm(r.reduced) for r in unit.collect()] == pytest.approx([1.0] * 23)
    with pytest.raises(ValueError, match="no mean row"):
        wide_pca.apply_table(df, table.where("component >= 0"), ["image_id", "seg_id"], max_bytes=100)


@pytest.mark.parametrize("step", [1, 1000])
def test_inner_products_are_made_once_per_pair_from_blocks(spark, monkeypatch, step):
    monkeypatch.setattr(wide_pca, "PRODUCT_ROWS", 4)
    x = RNG.normal(size=(23, 5))
    rows = [(step * i - 7, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "id BIGINT, vec ARRAY<DOUBLE>").repartition(3)
    found = wide_pca.inner_products(df, "id", "vec", 5)
    got = [((r.a + 7) // step, (r.b + 7) // step, r["product"]) for r in found.collect()]
    assert sorted(g[:2] for g in got) == [(i, j) for i in range(23) for j in range(i, 23)]
    assert [g[2] for g in got] == pytest.approx([x[i] @ x[j] for i, j, _ in got])


def test_whitening_tables_of_wide_rows(spark):
    x = RNG.normal(size=(20, 50))
    df = vectors(spark, x, "i")
    tables = reduce.whiten_pca_tables(df, [3, 19])
    for n, table in tables.items():
        got = np.array([r.white for r in wide_pca.apply_table(df, table, ["i"], out="white", max_bytes=100).orderBy("i").collect()])
        values, axes = np.linalg.eigh(np.cov(x.T))
        assert np.abs(got) == pytest.approx(np.abs((x - x.mean(0)) @ axes[:, ::-1][:, :n] / np.sqrt(values[::-1][:n])), abs=1e-6)


def test_whitening_sizes_share_one_fit(spark):
    df = vectors(spark, RNG.normal(size=(80, 6)), "i")
    made = reduce.whiten_pca(df, [2, 5])
    assert made[5].axes[:2] == pytest.approx(made[2].axes)
    out = np.array([r.white for r in reduce.apply_whitening(df, made[5]).collect()])
    assert np.linalg.norm(out, axis=1) == pytest.approx(np.ones(80))


def test_mixed_reduction_takes_both_ends(spark):
    x = RNG.normal(size=(60, 6)) * np.array([9, 6, 4, 2, 1, 0.5])
    df = vectors(spark, x, "i")
    train, _ = reduce.reduce_pca_mixed(df, df, 4, 0.5, 6)
    got = np.array([r.reduced for r in train.orderBy("i").collect()])
    values, axes = np.linalg.eigh(np.cov(x.T))
    want = (x - x.mean(0)) @ axes[:, [5, 4, 1, 0]]
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-8)


def test_vocabulary_fit_reduces_error(spark):
    centres = np.eye(5)[:4]
    x = centres[RNG.integers(0, 4, 300)] + RNG.normal(size=(300, 5)) * 0.1
    df = patch_frame(spark, x)
    table = storage.cut_lineage(vocabulary.fit_vocabulary(df, 4, normalize=False))
    fitted = vocabulary.load_vocabulary(table)
    assert fitted.centroids.shape == (4, 5)
    start = Vocabulary(np.arange(4), x[:4])
    assert vocabulary.quantisation_error(df, fitted).first()[0] <= vocabulary.quantisation_error(df, start).first()[0]
    with pytest.raises(ValueError):
        vocabulary.load_vocabulary(table, max_bytes=10)


def test_bilinear_equals_direct_interpolation(spark):
    grid = RNG.normal(size=(3, 4))
    rows = [(0, y * 4 + x, y, x, [float(grid[y, x])]) for y in range(3) for x in range(4)]
    df = spark.createDataFrame(rows, "image_id BIGINT, patch_id INT, py INT, px INT, embedding ARRAY<DOUBLE>")
    got = {(r.y, r.x): r.vec[0] for r in pooling.resample_bilinear(df, 5, 7).collect()}
    for y in range(5):
        for x in range(7):
            sy, sx = y * 2 / 4, x * 3 / 6
            a, b = min(int(sy), 1), min(int(sx), 2)
            fy, fx = sy - a, sx - b
            want = (grid[a, b] * (1 - fy) * (1 - fx) + grid[a + 1, b] * fy * (1 - fx) + grid[a, b + 1] * (1 - fy) * fx + grid[a + 1, b + 1] * fy * fx)
            assert got[y, x] == pytest.approx(want)


def test_cluster_groups_cover_every_role(spark):
    rows = [(0, c, *[RNG.normal(size=3).tolist() for _ in range(3)]) for c in range(6)]
    df = spark.createDataFrame(rows, "q_image BIGINT, cluster INT, q ARRAY<DOUBLE>, p ARRAY<DOUBLE>, n ARRAY<DOUBLE>")
    groups = margins.cluster_groups(df)
    assert groups.count() == 18 and groups.select("group").distinct().count() == 3
    flat = margins.cluster_embedding_2d(df).collect()
    assert np.mean([r.x for r in flat]) == pytest.approx(0, abs=1e-9)


def test_scans_read_only_needed_columns(spark):
    from placequery.plans.fixtures import Fixtures
    plan = Fixtures(spark, "/root/testdata/sf0.001").segment_patches()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint>" in plan


def test_replayed_stream_batches_do_not_repeat_votes(spark, tmp_path):
    from placequery.streaming import retrieve

    refs = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(RNG.normal(size=(20, 3)))], "r_image BIGINT, r_seg BIGINT, vec ARRAY<DOUBLE>")
    queries = spark.createDataFrame([(100 + i // 2, i, v.tolist()) for i, v in enumerate(RNG.normal(size=(6, 3)))], retrieve.SEGMENTS)
    queries.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    for state in ("first", "again"):
        # A second run without the first one's progress replays the same batch.
        stream = retrieve.read_query_segments(spark, f"{tmp_path}/in")
        retrieve.retrieve_stream(stream, refs, (-10.0, 2.0), out, f"{tmp_path}/{state}", k=5, top=5, n=2).awaitTermination()
    got = spark.read.parquet(out).select("q_image", "rank", "r_image")
    want = retrieve.retrieve_batch(queries, refs, (-10.0, 2.0), 5, 5, 2).select("q_image", "rank", "r_image")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 6


@pytest.mark.parametrize("limits", [(8 << 20, 32 << 20), (8 * 8 * 5, 8 * 3 * 8 * 2)])
def test_segment_vlad_of_many_blocks(spark, monkeypatch, limits):
    """Blocks of five patches and pieces of two segments give what one product gives; repeated rows count once."""
    monkeypatch.setattr(aggregate, "BLOCK_BYTES", limits[0])
    monkeypatch.setattr(aggregate, "PIECE_BYTES", limits[1])
    rng = np.random.default_rng(8)
    x, c = rng.normal(size=(2, 60, 8)), rng.normal(size=(3, 8))
    ids = np.sort(rng.choice(500, 60, replace=False))
    patches = [(i, int(p), x[i, j].tolist()) for i in range(2) for j, p in enumerate(ids)]
    edges = [(i, s, int(p)) for i in range(2) for s in range(11) for p in rng.choice(ids, 1 + 4 * s, replace=False)]
    v = vocabulary.Vocabulary(np.array([4, 7, 9]), c)
    frame = spark.createDataFrame(edges + edges[::3] + [(0, 99, 1000), (5, 1, 1)], "image_id long, seg_id int, patch_id long")
    got = aggregate.segment_vlad(spark.createDataFrame(patches, "image_id long, patch_id long, embedding array<double>"), frame, v)
    assert got.schema["seg_id"].dataType.simpleString() == "int"
    where, unit = {int(p): j for j, p in enumerate(ids)}, c / np.linalg.norm(c, axis=1, keepdims=True)
    expected = {}
    for i, s, p in edges:
        k = int((unit @ x[i, where[p]]).argmax())
        expected.setdefault((i, s), {}).setdefault(int(v.clusters[k]), []).append(x[i, where[p]] - c[k])
    found = {}
    for r in got.collect():
        found.setdefault((r.image_id, r.seg_id), {})[r.cluster] = np.array(r.residual)
    assert found.keys() == expected.keys()
    for key, parts in expected.items():
        parts = {k: sum(r) / np.linalg.norm(sum(r)) for k, r in parts.items()}
        assert found[key].keys() == parts.keys()
        for k, r in parts.items():
            assert np.allclose(found[key][k], r / np.sqrt(len(parts)), atol=1e-9)


def test_segment_vlad_moves_blocks_not_vectors(spark):
    v = vocabulary.Vocabulary(np.arange(2), np.eye(2, 4))
    patches = spark.createDataFrame([(0, 0, [1.0] * 4)], "image_id long, patch_id long, embedding array<double>")
    edges = spark.createDataFrame([(0, 0, 0)], "image_id long, seg_id long, patch_id long")
    plan = aggregate.segment_vlad(patches, edges, v)._jdf.queryExecution().optimizedPlan().toString()
    # Vectors are collected into blocks before they meet the ids, and no join is on a single patch.
    assert "flat" in plan and "patch_id#" not in "".join(line for line in plan.splitlines() if "Join" in line)


def runs_of(grid):
    """Column-major run lengths of a 0/1 grid, off run first."""
    flat, out, state = grid.T.ravel(), [], 0
    at = 0
    while at < len(flat):
        end = at
        while end < len(flat) and flat[end] == state:
            end += 1
        out.append(end - at)
        at, state = end, 1 - state
    return out


def random_grids(rng):
    """Noise, full, empty, single pixels, whole columns that touch, and a pixel at the end."""
    shapes = [(5, 7), (9, 4), (1, 6), (6, 1), (1, 1)]
    grids = [(rng.random(s) < share).astype(int) for s in shapes for share in (0, 0.2, 0.5, 0.9, 1)]
    bands = np.zeros((4, 6), int)
    bands[:, 1:3], bands[2, 4], bands[3, 5] = 1, 1, 1
    return [*grids, bands]


def mask_frame(spark, grids, extra="0 as crop_x0, 0 as crop_y0"):
    rows = [(k % 3, k, *g.shape, runs_of(g)) for k, g in enumerate(grids)]
    return spark.createDataFrame(rows, "image_id long, seg_id long, h int, w int, rle array<int>").selectExpr("*", extra.split(", ")[0], extra.split(", ")[1])


def test_masks_on_runs_equal_pixels(spark):
    rng = np.random.default_rng(12)
    grids = random_grids(rng)
    frame = mask_frame(spark, grids, "cast(seg_id % 4 as long) as crop_x0, cast(seg_id % 3 as long) as crop_y0")
    for height, width in ((5, 7), (12, 20), (3, 2), (1, 1), (10, 3)):
        got = {r.seg_id: r.rle for r in masks.resize_mask_nearest(frame, height, width).collect()}
        for k, g in enumerate(grids):
            scaled = g[np.arange(height) * g.shape[0] // height][:, np.arange(width) * g.shape[1] // width]
            assert got[k] == runs_of(scaled)
    got = {r.seg_id: r.rle for r in masks.uncrop_masks(frame, 14, 15).collect()}
    for k, g in enumerate(grids):
        full = np.zeros((14, 15), int)
        full[k % 3 : k % 3 + g.shape[0], k % 4 : k % 4 + g.shape[1]] = g
        assert got[k] == runs_of(full)
    pixels = [(k % 3, k, int(y), int(x)) for k, g in enumerate(grids) for y, x in np.argwhere(g)]
    table = spark.createDataFrame(pixels + pixels[::5], "image_id long, seg_id long, y int, x int")
    assert {r.seg_id: r.rle for r in masks.rle_encode(table, frame).collect()} == {k: runs_of(g) for k, g in enumerate(grids)}


def test_union_of_masks_sweeps_ends(spark):
    rng = np.random.default_rng(13)
    grids = [(rng.random((6, 8)) < 0.25).astype(int) for _ in range(40)] + [np.zeros((6, 8), int)]
    got = {r.image_id: r.rle for r in masks.union_masks(mask_frame(spark, grids)).collect()}
    assert got == {i: runs_of(np.maximum.reduce(grids[i::3])) for i in range(3)}
    empty = mask_frame(spark, [np.zeros((2, 3), int)])
    assert [r.rle for r in masks.union_masks(empty).collect()] == [[6]]


def test_masks_are_moved_inside_their_row(spark):
    frame = mask_frame(spark, random_grids(np.random.default_rng(1)))
    for out in (masks.uncrop_masks(frame, 30, 30), masks.resize_mask_nearest(frame, 9, 9)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Exchange" not in plan
