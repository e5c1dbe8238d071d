"""Small cases worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from placequery.functions.vectors import l2_normalize, minmax_global
from placequery.operators import aggregate, graph, masks, metrics, suppression, vote
from placequery.operators.vocabulary import Vocabulary
from placequery.sources import models, paths

PRED = "q_image BIGINT, rank INT, r_image BIGINT"
PAIR = "q_image BIGINT, r_image BIGINT"


def test_mean_ap(spark):
    flags = [[1, 0, 1, 0, 1], [0, 1, 1, 0, 0], [1, 1, 0, 0, 0]]
    rows = [(q, r + 1, r, f) for q, fs in enumerate(flags) for r, f in enumerate(fs)]
    rel = spark.createDataFrame(rows, PRED + ", relevant INT")
    ap = {r.q_image: r.ap_retrieved for r in metrics.average_precision(rel).collect()}
    assert ap == pytest.approx({0: 0.755556, 1: 0.583333, 2: 1.0}, abs=1e-6)
    assert metrics.mean_ap(rel).first()[0] == pytest.approx(0.779630, abs=1e-6)


def test_recall_with_and_without_ground_truth(spark):
    pred = spark.createDataFrame([(q, r, 10 * q + r) for q in range(3) for r in (1, 2, 3)], PRED)
    gt = spark.createDataFrame([(0, 1), (1, 13)], PAIR)
    queries = spark.createDataFrame([(0,), (1,), (2,)], "q_image BIGINT")
    judged = metrics.recall_at_k(pred, gt, queries, 3).orderBy("k").collect()
    assert [r.recall for r in judged] == [0.5, 0.5, 1.0]
    everyone = metrics.recall_at_k_all(pred, gt, queries, (1, 2, 3), 1.0).orderBy("k").collect()
    assert [r.recall for r in everyone] == pytest.approx([1 / 3, 1 / 3, 2 / 3])


def test_recall_without_any_ground_truth_is_null(spark):
    pred = spark.createDataFrame([(0, 1, 1)], PRED)
    empty = spark.createDataFrame([], PAIR)
    queries = spark.createDataFrame([(0,)], "q_image BIGINT")
    assert metrics.recall_at_k(pred, empty, queries, 1).first().recall is None


MATCH = "q_image BIGINT, q_seg BIGINT, rank INT, r_image BIGINT, r_seg BIGINT, sim DOUBLE"


def test_vote_tie_goes_to_the_better_rank(spark):
    m = spark.createDataFrame([(0, 0, 1, 8, 80, 1.0), (0, 0, 2, 7, 70, 1.0), (0, 1, 1, 5, 50, 0.0)], MATCH)
    got = [r.r_image for r in vote.weighted_borda_images(m, 3).orderBy("rank").collect()]
    assert got == [8, 7, 5]


def test_normalisation_is_global_not_per_query(spark):
    m = spark.createDataFrame([(0, 0, 1, 1, 1, 0.0), (0, 1, 1, 1, 2, 1.0), (1, 0, 1, 1, 1, 2.0)], MATCH)
    assert {r.q_image: r.score for r in vote.weighted_borda_images(m, 1).collect()} == {0: 0.5, 1: 1.0}
    assert [r.n for r in minmax_global(m, "sim", "n").orderBy("sim").collect()] == [0.0, 0.5, 1.0]


def test_segment_borda_counts_distinct_segments(spark):
    m = spark.createDataFrame([(0, s, 1, 1, 10, 1.0) for s in range(5)] + [(0, 6, 1, 2, 20, 0.1), (0, 7, 1, 2, 21, 0.1)], MATCH)
    got = vote.get_matches(m, 2, "max_seg_topk_wt_borda").orderBy("rank").collect()
    assert [(r.r_image, r.score) for r in got] == [(2, 2), (1, 1)]


def test_unknown_methods_are_errors(spark):
    m = spark.createDataFrame([(0, 0, 1, 1, 1, 0.0)], MATCH)
    with pytest.raises(ValueError):
        vote.get_matches(m, 1, "nothing")
    with pytest.raises(ValueError):
        vote.get_matches_old(m, 1, "max_seg_topk")


def test_first_k_unique(spark):
    items = spark.createDataFrame([(0, i, v) for i, v in enumerate([5, 5, 2, 5, 7, 2])], "q INT, pos INT, item INT")
    got = vote.first_k_unique(items, ["q"], "item", "pos", 2).orderBy("rank").collect()
    assert [r.item for r in got] == [5, 2]


def test_small_image_edges_ignore_order(spark):
    points = spark.createDataFrame([(1, s, float(s), float(s * s)) for s in range(3)] + [(2, 0, 0.0, 0.0)],
                                   "image_id BIGINT, seg_id BIGINT, cx DOUBLE, cy DOUBLE")
    edges = graph.delaunay_edges(points)
    want = {(1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1), (1, 2, 0), (1, 2, 1), (2, 0, 0)}
    assert {(r.image_id, r.seg_a, r.seg_b) for r in edges.collect()} == want
    assert {(r.image_id, r.seg_a, r.seg_b) for r in graph.expand_hops(edges, 3).collect()} == want


def test_run_lengths(spark):
    row = spark.createDataFrame([([True, False, False, False],)], "bits ARRAY<BOOLEAN>").select(masks.rle_from_bits(F.col("bits")).alias("rle"))
    got = row.select("rle", masks.rle_area(F.col("rle")).alias("a")).first()
    assert list(got.rle) == [0, 1, 3] and got.a == 1


def test_empty_mask_box(spark):
    m = spark.createDataFrame([(0, 0, 2, 2, [4])], "image_id BIGINT, seg_id INT, h INT, w INT, rle ARRAY<INT>")
    assert tuple(masks.mask_box(m).first())[2:] == (0, 0, 0, 0)


def one_patch(spark, vectors):
    return spark.createDataFrame([(0, i, v) for i, v in enumerate(vectors)], "image_id BIGINT, patch_id INT, embedding ARRAY<DOUBLE>")


def test_vlad_of_a_centroid_is_zero(spark):
    v = Vocabulary(np.array([0, 1]), np.array([[1.0, 0.0], [0.0, 1.0]]))
    patches = one_patch(spark, [[1.0, 0.0]])
    seg = spark.createDataFrame([(0, 0, 0)], "image_id BIGINT, seg_id INT, patch_id INT")
    got = aggregate.segment_vlad(patches, seg, v).collect()
    assert [list(r.residual) for r in got] == [[0.0, 0.0]]


def test_patch_counts_once_per_super_segment(spark):
    v = Vocabulary(np.array([0]), np.array([[1.0, 0.0]]))
    patches = one_patch(spark, [[0.0, 1.0], [2.0, 0.0]])
    hops = spark.createDataFrame([(0, 0, 0), (0, 0, 1)], "image_id BIGINT, seg_a INT, seg_b INT")
    inc = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (0, 1, 1)], "image_id BIGINT, seg_id INT, patch_id INT")
    wide = graph.super_segment_patches(hops, inc)
    assert wide.count() == 2
    got = aggregate.segment_vlad(patches, wide, v).first().residual
    assert list(got) == pytest.approx([0.0, 1.0])


def test_three_patch_vlad(spark):
    v = Vocabulary(np.array([0, 1]), np.array([[1.0, 0.0], [0.0, 1.0]]))
    got = aggregate.image_vlad_hard(one_patch(spark, [[1.0, 0.5], [0.9, -0.2], [0.1, 1.0]]), v, norm_descs=False)
    rows = {r.cluster: np.array(r.residual) for r in got.collect()}
    a, b = np.array([-0.1, 0.3]), np.array([0.1, 0.0])
    assert rows[0] == pytest.approx(a / np.linalg.norm(a) / np.sqrt(2))
    assert rows[1] == pytest.approx(b / np.linalg.norm(b) / np.sqrt(2))


def test_soft_vlad_literal_uses_all_residuals(spark):
    v = Vocabulary(np.array([0, 1]), np.array([[1.0, 0.0], [0.0, 1.0]]))
    x = np.array([0.6, 0.8])
    p = one_patch(spark, [x.tolist()])
    literal = {r.cluster: np.array(r.residual) for r in aggregate.image_vlad_soft(p, v, mode="literal").collect()}
    both = (x - v.centroids).sum(0)
    for c in (0, 1):
        assert literal[c] == pytest.approx(both / np.linalg.norm(both) / np.sqrt(2))


def test_zero_vector_stays_zero(spark):
    got = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v ARRAY<DOUBLE>").select(l2_normalize(F.col("v")).alias("u")).collect()
    assert [list(r.u) for r in got] == [[0.0, 0.0], [0.6, 0.8]]


def test_natural_order(spark):
    names = spark.createDataFrame([("img10.jpg",), ("img2.jpg",), ("img1.jpg",)], "name STRING")
    got = paths.image_index(names).orderBy("image_pos").collect()
    assert [r.name for r in got] == ["img1.jpg", "img2.jpg", "img10.jpg"]


def test_bad_coordinates_are_null(spark):
    got = paths.with_path_coords(spark.createDataFrame([("a@x@1.5@b",), ("plain",)], "path STRING")).collect()
    assert [(r.x, r.y) for r in got] == [(None, 1.5), (None, None)]


def test_model_keys():
    assert models.model_key("vocabulary", "baidu") == "vocabulary_indoor"
    assert models.model_key("pca", "baidu", "map", True) == "pca_baidu_finetuned"


def test_touching_boxes_and_duplicate_ids(spark):
    schema = "image_id BIGINT, seg_id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, predicted_iou DOUBLE"
    chain = [(0, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (0, 1, 2.0, 0.0, 12.0, 10.0, 0.8), (0, 2, 4.0, 0.0, 14.0, 10.0, 0.7)]
    kept = suppression.nms_boxes(spark.createDataFrame(chain, schema), 0.5).collect()
    # The middle box falls to the first and so cannot remove the last.
    assert sorted(r.seg_id for r in kept) == [0, 2]
    with pytest.raises(ValueError):
        suppression.nms_boxes(spark.createDataFrame([chain[0], chain[1][:1] + (0,) + chain[1][2:]], schema), 0.5)
