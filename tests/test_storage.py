"""Stored fields, place tables, lists in parts and renumbered rows on small hand-made cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from placequery.functions import ordering
from placequery.functions.storage import scratch_path
from placequery.operators import burst, diagnostics, masks
from placequery.operators.vocabulary import Vocabulary
from placequery.sources import results, tables

COLUMNS = ["place_id", "city_id", "panoid", "year", "month", "northdeg", "lat", "lon"]


def city(spark, folder, name, ids):
    rows = [(i, name, "p", 2020, 1, 0, 0.0, 0.0) for i in ids]
    spark.createDataFrame(rows, tables.PLACES).write.option("header", True).csv(f"{folder}/{name}")


def test_place_tables_are_numbered_by_their_path(spark):
    folder = scratch_path(spark, "cities")
    names = ["a b", "c+d", "e%20f", "g"]
    for k, name in enumerate(names):
        city(spark, folder, name, [k, k + 1])
    want = sorted((k * 100_000 + k + j, name) for k, name in enumerate(names) for j in (0, 1))

    def read(paths):
        return sorted((r.place_id, r.city_id) for r in tables.read_place_tables(spark, paths).collect())

    assert read([f"{folder}/*"]) == read([f"{folder}/{n}" for n in names]) == want
    # The order of the list counts, and a table listed twice has both numbers.
    assert read([f"{folder}/g", f"{folder}/a b", f"{folder}/g"]) == sorted(
        [(3, "g"), (4, "g"), (100_000, "a b"), (100_001, "a b"), (200_003, "g"), (200_004, "g")]
    )
    with pytest.raises(FileNotFoundError):
        read([f"{folder}/nowhere"])


def test_place_tables_are_one_scan(spark):
    folder = scratch_path(spark, "cities")
    for k in range(12):
        city(spark, folder, f"c{k:02}", [k])
    plans = [tables.read_place_tables(spark, [f"{folder}/c{k:02}" for k in range(n)])._jdf.queryExecution().optimizedPlan() for n in (2, 12)]
    assert len({plan.toString().count("\n") for plan in plans}) == 1
    assert plans[1].toString().count("Relation [") + plans[1].toString().count("Relation spark") == 1


def test_long_list_is_numbered_in_several_tasks(spark, monkeypatch):
    stored = []
    cut = ordering.cut_lineage
    monkeypatch.setattr(ordering, "cut_lineage", lambda df: stored.append(cut(df)) or stored[-1])
    n = 200_000
    gt = spark.range(n).select(F.lit(7).cast("long").alias("q_image"), F.col("id").alias("r_image"))
    info = spark.createDataFrame([], "q_image long, r_rank int, r_image long, q_seg long, r_seg long")
    found = results.match_records(info, gt, spark.createDataFrame([(7,), (8,)], "q_image long"))
    lists = {(r.q_image, r.part): json.loads(r.payload) for r in found.where("kind = 'gt'").collect()}
    assert lists.pop((8, 0)) == []
    assert [x for _, part in sorted(lists) for x in lists[7, part]] == list(range(n))
    assert max(map(len, lists.values())) == results.PART_ENTRIES
    longest = max(stored, key=lambda df: df.count())
    assert len([r for r in longest.groupBy(F.spark_partition_id()).count().collect() if r["count"]]) > 1


def test_renumbering_stores_ids_only(spark, monkeypatch):
    stored = []
    cut = ordering.cut_lineage
    monkeypatch.setattr(ordering, "cut_lineage", lambda df: stored.append(df.columns) or cut(df))
    rows = [(1, 30, 9.0, "x"), (1, 10, 5.0, "y"), (1, 10, 5.0, "z"), (1, 20, 1.0, "small"), (None, 4, 7.0, "no image"), (2, 5, 8.0, "w")]
    segments = spark.createDataFrame(rows, "image_id long, seg_id long, area double, rest string")
    found = masks.filter_segments(segments, 2)
    assert found.columns == [*segments.columns, "new_seg"]
    got = sorted((r.image_id or 0, r.seg_id, r.new_seg) for r in found.collect())
    assert got == [(0, 4, 0), (1, 10, 0), (1, 10, 1), (1, 30, 2), (2, 5, 0)]
    assert {r.rest for r in found.collect()} == {"x", "y", "z", "no image", "w"}
    assert all("rest" not in columns and "area" not in columns for columns in stored)


def test_second_call_computes_nothing(spark):
    rng = np.random.default_rng(3)
    rows = [(i, p, rng.normal(size=4).tolist()) for i in range(3) for p in range(5)]
    patches = spark.createDataFrame(rows, "image_id long, patch_id long, embedding array<double>")
    vocabulary = Vocabulary(np.arange(2), rng.normal(size=(2, 4)))
    fields, path, asked = diagnostics.assignment_fields(patches, vocabulary, 2.0), scratch_path(spark, "fields"), []

    def counted(name, make):
        return lambda ids: asked.append((name, sorted(r.image_id for r in ids.collect()))) or make(ids)

    compute = {name: counted(name, make) for name, make in fields.items()}
    images = patches.select("image_id").distinct()
    results.cached_fields(images.where("image_id > 0"), compute, path, "image_id")
    assert asked == [(name, [1, 2]) for name in fields]
    asked.clear()
    first = results.cached_fields(images, compute, path, "image_id")
    assert asked == [(name, [0]) for name in fields]
    asked.clear()
    again = results.cached_fields(images, compute, path, "image_id")
    assert not asked
    for name in fields:
        assert sorted(map(repr, first[name].collect())) == sorted(map(repr, again[name].collect()))
    x = {(i, p): np.array(v) for i, p, v in rows}
    d = {(r.image_id, r.patch_id, r.other_id): r.d for r in again["self_distance"].collect()}
    assert d == pytest.approx({(i, p, o): 2 * x[i, p] @ x[i, o] - 2 for i, p in x for o in range(5)})
    w = {(r.image_id, r.patch_id): r.w for r in burst.burst_weights(patches).collect()}
    soft = {(r.image_id, r.patch_id): np.array(r.soft) for r in again["soft"].collect()}
    for r in again["adjusted"].collect():
        assert r.adjusted == pytest.approx(soft[r.image_id, r.patch_id] / w[r.image_id, r.patch_id])
