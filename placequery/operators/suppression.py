"""Greedy box suppression: overlapping pairs by joins, decided in the order of their winners."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.ordering import top_per_group
from ..functions.skew import salted_join
from ..functions.storage import cut_lineage

BOX = ["x0", "y0", "x1", "y1"]
KEY = ["image_id", "seg_id"]
# Overlaps of an image that one task decides in order; images with more take rounds of joins.
STREAM_PAIRS = 1 << 20


def iou_pairs(boxes: DataFrame, threshold: float, cell: float = 64.0) -> DataFrame:
    """Pairs of one image overlapping by more than ``threshold``: ``image_id, hi, lo`` and the score of hi.

    Boxes meet in the grid cell that holds the top-left corner of their intersection, so
    each pair is found exactly once and distant boxes are never compared. ``hi`` wins
    over ``lo``: higher score, then lower id.
    """
    def span(low: str, high: str):
        return F.sequence(F.floor(F.col(low) / cell).cast("long"), F.floor(F.col(high) / cell).cast("long"))

    spread = (
        boxes.select(*KEY, *BOX, "score")
        .withColumn("_cx", F.explode(span("x0", "x1"))).withColumn("_cy", F.explode(span("y0", "y1")))
    )
    a = spread.select("image_id", "_cx", "_cy", *[F.col(c).alias(f"a_{c}") for c in ["seg_id", *BOX, "score"]])
    b = spread.select("image_id", "_cx", "_cy", *[F.col(c).alias(f"b_{c}") for c in ["seg_id", *BOX, "score"]])
    left, top = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    overlap = F.greatest(F.least("a_x1", "b_x1") - left, F.lit(0.0)) * F.greatest(F.least("a_y1", "b_y1") - top, F.lit(0.0))

    def area(s: str):
        return (F.col(f"{s}_x1") - F.col(f"{s}_x0")) * (F.col(f"{s}_y1") - F.col(f"{s}_y0"))

    wins = (F.col("a_score") > F.col("b_score")) | ((F.col("a_score") == F.col("b_score")) & (F.col("a_seg_id") < F.col("b_seg_id")))
    condition = (
        wins & (F.floor(left / cell) == F.col("_cx")) & (F.floor(top / cell) == F.col("_cy"))
        & (overlap > F.lit(threshold) * (area("a") + area("b") - overlap))
    )
    return salted_join(a, b, ["image_id", "_cx", "_cy"], condition, self_join=True).select(
        "image_id", F.col("a_seg_id").alias("hi"), F.col("b_seg_id").alias("lo"), F.col("a_score").alias("score")
    )


def _decided_in_order(conflicts: DataFrame) -> DataFrame:
    """``(image_id, lo)`` of suppressed boxes: pairs stream by in the order of their winner, image by image.

    A pair counts if its winner has not been suppressed before; all that could suppress the
    winner has come by then. A task keeps the suppressed boxes of one image.
    """
    ordered = conflicts.repartition("image_id").sortWithinPartitions("image_id", F.col("score").desc(), "hi")
    out = T.StructType([conflicts.schema["image_id"], conflicts.schema["lo"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, gone = None, set()
        for batch in batches:
            images, losers = [], []
            for at, hi, lo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != image:
                    image, gone = at, set()
                if hi not in gone and lo not in gone:
                    gone.add(lo)
                    images.append(at)
                    losers.append(lo)
            yield pa.RecordBatch.from_arrays([pa.array(images, batch.column(0).type), pa.array(losers, batch.column(2).type)], names=out.names)

    return ordered.select("image_id", "hi", "lo").mapInArrow(run, out)


def _decided_in_rounds(conflicts: DataFrame) -> DataFrame:
    """The same for images of any size. One table per round marks the pairs whose loser is out.

    A box is out once a winner over it is beaten by none that is undecided; the next round leaves
    out all pairs of such boxes. Rounds are as many as the longest chain is long.
    """
    found, state = [], conflicts.select("image_id", "hi", "lo", F.lit(False).alias("out"))
    while True:
        lost = state.where("out").select("image_id", "lo").distinct()
        open_ = state.where("NOT out").select("image_id", "hi", "lo")
        if found:
            open_ = open_.join(lost, ["image_id", "lo"], "left_anti").join(lost.withColumnRenamed("lo", "hi"), ["image_id", "hi"], "left_anti")
        beaten = open_.select("image_id", F.col("lo").alias("hi")).distinct().withColumn("_beaten", F.lit(True))
        free = F.max(F.col("_beaten").isNull()).over(Window.partitionBy("image_id", "lo"))
        state = cut_lineage(open_.join(beaten, ["image_id", "hi"], "left").withColumn("out", free).select("image_id", "hi", "lo", "out"))
        left, out = state.agg(F.count(F.lit(1)), F.max("out")).first()
        if not left:
            return _union(found, conflicts)
        if not out:
            raise ValueError("segment ids must be unique within an image")
        found.append(state.where("out").select("image_id", "lo").distinct())


def _union(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.select("image_id", "lo").limit(0)
    for part in parts:
        out = out.unionByName(part)
    return out


def nms_boxes(boxes: DataFrame, iou: float = 0.7, score: str = "predicted_iou") -> DataFrame:
    """Keep a box unless a kept, better box of its image overlaps it by more than ``iou``.

    Identical boxes collapse to their best first (they share every overlap). The overlaps of an
    image are then decided in one pass in the order of their winners, however long the chains of
    suppression are; only images with more than STREAM_PAIRS overlaps are split over tasks and
    take rounds of joins.
    """
    scored = boxes.withColumn("score", F.col(score).cast("double"))
    # Boxes without area overlap nothing, so copies of them all stay.
    flat = (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))
    same = ["image_id", *BOX]
    best = top_per_group(scored.where(~flat), same, [F.col("score").desc(), F.col("seg_id")], 1, "_copy").drop("_copy")
    unique = cut_lineage(best.unionByName(scored.where(flat)))
    conflicts = cut_lineage(iou_pairs(unique, iou))
    by_id = conflicts.groupBy("image_id", "hi").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.max(F.col("hi") == F.col("lo")).alias("own"))
    if not by_id.where("own OR low < high").isEmpty():
        raise ValueError("segment ids must be unique within an image")
    large = cut_lineage(conflicts.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > STREAM_PAIRS).select("image_id"))
    if large.isEmpty():
        dropped = _decided_in_order(conflicts)
    else:
        few = _decided_in_order(conflicts.join(large, "image_id", "left_anti"))
        dropped = few.unionByName(_decided_in_rounds(conflicts.join(large, "image_id", "left_semi")))
    return unique.drop("score").join(dropped.withColumnRenamed("lo", "seg_id"), KEY, "left_anti")


def nms_across_crops(boxes: DataFrame, iou: float = 0.7) -> DataFrame:
    """Suppression between crops: boxes from smaller crops win (score 1 / crop area)."""
    area = (F.col("crop_x1") - F.col("crop_x0")) * (F.col("crop_y1") - F.col("crop_y0"))
    return nms_boxes(boxes.withColumn("_crop_score", 1.0 / area), iou, "_crop_score").drop("_crop_score")
