"""Segment masks: run lengths, geometry and filters.

A mask travels as column-major run lengths starting with the off run. Areas, boxes and
centroids come from the runs in closed form; pixels are only produced when asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import dense_position
from ..functions.vectors import let

MASK = ["image_id", "seg_id"]


# -- run lengths -----------------------------------------------------------
def rle_from_bits(bits: Column) -> Column:
    """Run lengths of a column-major array of booleans, off run first.

    Intermediate arrays are bound with ``let``: the optimiser may copy this expression
    into filters, and unbound arrays would then be rebuilt for every element.
    """

    def encode(b: Column) -> Column:
        n = F.size(b)
        changes = F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get(b, i) != F.get(b, i - 1))
        starts = F.when(n > 1, changes).otherwise(F.array().cast("array<int>"))
        runs = let(starts, lambda s: F.zip_with(F.concat(s, F.array(n)), F.concat(F.array(F.lit(0)), s), lambda a, c: a - c))
        return F.concat(F.when(F.get(b, F.lit(0)), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), runs)

    return let(bits, encode)


def column_major(grid: Column, h: Column, w: Column) -> Column:
    """Row-major grid to column-major order."""
    return let(grid, lambda g: F.transform(
        F.sequence(F.lit(0), h * w - 1), lambda i: F.get(g, ((i % h) * w + F.floor(i / h)).cast("int"))
    ))


def rle_area(rle: Column) -> Column:
    """Sum of the on runs (odd positions)."""
    on = F.filter(rle, lambda x, i: i % 2 == 1)
    return F.aggregate(on, F.lit(0).cast("bigint"), lambda s, x: s + x)


def rle_from_cuts(cuts: Column, total: Column) -> Column:
    """Run lengths from the places where the mask switches, in any order.

    A place named twice is the end of one run and the start of the next: the two cancel.
    """

    def lengths(c: Column) -> Column:
        alone = F.filter(c, lambda p, i: ((i == 0) | (F.get(c, i - 1) != p)) & ((i == F.size(c) - 1) | (F.get(c, i + 1) != p)))
        edges = F.concat(F.array(F.lit(0)), alone, F.array(total.cast("int")))
        return let(edges, lambda e: F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda i: F.get(e, i) - F.get(e, i - 1)))

    # A mask that ends on its last pixel has no trailing off run.
    return let(let(F.array_sort(cuts), lengths), lambda r: F.when(
        (F.size(r) > 1) & (F.element_at(r, -1) == 0), F.slice(r, 1, F.size(r) - 1)
    ).otherwise(r))


def _cuts(spans: Column) -> Column:
    """Both ends of every (s, e) span that holds a pixel."""
    held = F.filter(spans, lambda r: r["s"] < r["e"])
    return F.flatten(F.transform(held, lambda r: F.array(r["s"].cast("int"), r["e"].cast("int"))))


def _rle_from_switches(switches: DataFrame, frame: DataFrame, keys: list[str]) -> DataFrame:
    """Masks from rows of ``_at``, places (x, y) where they switch; ``frame`` rows without any are empty masks."""
    joined = switches.groupBy(*keys).agg(F.flatten(F.collect_list("_at")).alias("_at"))
    place = F.transform("_at", lambda p: (p["x"] * F.col("h") + p["y"]).cast("int"))
    full = frame.join(joined, keys, "left").withColumn("_at", F.coalesce(place, F.array().cast("array<int>")))
    return full.select(*frame.columns, rle_from_cuts(F.col("_at"), F.col("h") * F.col("w")).alias("rle"))


def _place(x: Column, y: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))


def rle_encode(pixels: DataFrame, frame: DataFrame) -> DataFrame:
    """Pixel table to run lengths.

    ``pixels`` is ``(image_id, seg_id, y, x)`` of the *on* pixels, ``frame`` gives h and w
    of every mask, so empty masks survive. Pixels meet per column of their mask and are
    combined map-side; a mask as a whole gathers only the ends of its runs.
    """
    held = pixels.groupBy(*MASK, "x").agg(F.array_sort(F.collect_set("y")).alias("_on"))
    # A run starts where the predecessor is absent and ends where the successor is.
    starts = F.filter("_on", lambda p, i: (i == 0) | (F.get(F.col("_on"), i - 1) != p - 1))
    ends = F.filter("_on", lambda p, i: (i == F.size("_on") - 1) | (F.get(F.col("_on"), i + 1) != p + 1))
    at = F.concat(F.transform(starts, lambda y: _place(F.col("x"), y)), F.transform(ends, lambda y: _place(F.col("x"), y + 1)))
    return _rle_from_switches(held.select(*MASK, at.alias("_at")), frame.select(*MASK, "h", "w"), MASK)


def run_columns(rle: Column, h: Column) -> Column:
    """Array of vertical on runs ``(x, y0, y1)``, y1 exclusive, cut at column borders."""
    ends = F.aggregate(
        rle,
        F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("at")),
        lambda s, x: F.struct(F.concat(s["ends"], F.array((s["at"] + x).cast("int"))).alias("ends"), (s["at"] + x).cast("int").alias("at")),
        lambda s: s["ends"],
    )

    def cut(e: Column) -> Column:
        odd = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i % 2 == 1) & (F.get(e, i) > F.get(e, i - 1)))
        spans = F.transform(odd, lambda i: F.struct(F.get(e, i - 1).alias("s"), F.get(e, i).alias("e")))
        return F.flatten(F.transform(spans, lambda r: F.transform(
            F.sequence(F.floor(r["s"] / h).cast("int"), F.floor((r["e"] - 1) / h).cast("int")),
            lambda x: F.struct(
                x.alias("x"), F.greatest(r["s"] - x * h, F.lit(0)).alias("y0"), F.least(r["e"] - x * h, h).alias("y1")
            ),
        )))

    return let(ends, cut)


def on_runs(masks: DataFrame) -> DataFrame:
    """One row per vertical on run: ``(…, x, y0, y1)``."""
    keep = [c for c in masks.columns if c != "rle"]
    runs = masks.withColumn("_r", F.explode(run_columns(F.col("rle"), F.col("h"))))
    return runs.select(*keep, "_r.x", "_r.y0", "_r.y1")


def rle_decode(masks: DataFrame) -> DataFrame:
    """On pixels ``(image_id, seg_id, y, x)``; a narrow expansion, nothing is shuffled."""
    runs = on_runs(masks)
    return runs.select(*MASK, F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"), "x")


# -- geometry from runs ----------------------------------------------------
def mask_centroid(masks: DataFrame) -> DataFrame:
    """Mean (x, y) of the on pixels; empty masks give no row. A projection, no shuffle."""
    def total(value) -> Column:
        return F.aggregate(F.transform("_r", value), F.lit(0.0), lambda s, v: s + v)

    # Filtering on the run lengths keeps the optimiser from repeating the geometry.
    filled = masks.where(rle_area(F.col("rle")) > 0)
    runs = filled.select(*MASK, run_columns(F.col("rle"), F.col("h")).alias("_r"))
    sums = runs.select(
        *MASK,
        total(lambda r: r["y1"] - r["y0"]).alias("_n"),
        total(lambda r: r["x"] * (r["y1"] - r["y0"])).alias("_x"),
        total(lambda r: (r["y0"] + r["y1"] - 1) / 2.0 * (r["y1"] - r["y0"])).alias("_y"),
    )
    return sums.select(*MASK, (F.col("_x") / F.col("_n")).alias("cx"), (F.col("_y") / F.col("_n")).alias("cy"))


def mask_box(masks: DataFrame) -> DataFrame:
    """Inclusive pixel box; an empty mask is [0, 0, 0, 0]. A projection, no shuffle."""
    runs = masks.select(*MASK, run_columns(F.col("rle"), F.col("h")).alias("_r"))
    sides = {
        "x0": F.array_min(F.col("_r.x")), "y0": F.array_min(F.col("_r.y0")),
        "x1": F.array_max(F.col("_r.x")), "y1": F.array_max(F.col("_r.y1")) - 1,
    }
    return runs.select(*MASK, *[F.coalesce(c, F.lit(0)).alias(n) for n, c in sides.items()])


def area_covered(masks: DataFrame) -> DataFrame:
    """Share of the frame a mask covers; a pure projection of the run lengths."""
    return masks.select(*MASK, (rle_area(F.col("rle")) / (F.col("h") * F.col("w"))).alias("covered"))


def stability_score(masks: DataFrame, threshold: float = 0.0, offset: float = 1.0, grid: str = "grid") -> DataFrame:
    """Pixels above threshold + offset over pixels above threshold - offset."""
    def above(limit: float) -> Column:
        return F.size(F.filter(grid, lambda v: v > limit))

    return masks.select(*MASK, (above(threshold + offset) / F.nullif(above(threshold - offset), F.lit(0))).alias("stability"))


# -- pixels and patches ----------------------------------------------------
def pixel_to_patch(y: Column, x: Column, h: int, w: int, size: int = 14) -> Column:
    """Patch id of a pixel on the (h // size) x (w // size) grid, clipped at the border."""
    rows, cols = h // size, w // size

    def clip(v: Column, limit: int) -> Column:
        return F.least(F.greatest(F.floor(v / F.lit(size)), F.lit(0)), F.lit(limit - 1))

    return clip(y, rows) * cols + clip(x, cols)


def segment_patch_incidence(masks: DataFrame, h: int, w: int, size: int = 14) -> DataFrame:
    """``(image_id, seg_id, patch_id)`` of the patches a mask touches.

    Works on runs: a vertical run covers a range of patch rows in one patch column, so
    pixels are never expanded.
    """
    rows, cols = h // size, w // size

    def row(v: Column) -> Column:
        return F.least(F.floor(v / F.lit(size)), F.lit(rows - 1))

    runs = on_runs(masks).select(
        *MASK, F.least(F.floor(F.col("x") / F.lit(size)), F.lit(cols - 1)).alias("_c"),
        F.explode(F.sequence(row(F.col("y0")), row(F.col("y1") - 1))).alias("_r"),
    )
    return runs.select(*MASK, (F.col("_r") * cols + F.col("_c")).alias("patch_id")).distinct()


def resize_mask_nearest(masks: DataFrame, height: int, width: int) -> DataFrame:
    """Run lengths at another frame size; target pixel t reads floor(t * source / target).

    Run ends are scaled inside the row: nothing is expanded to pixels and nothing shuffled.
    """
    def scaled(at: Column, size: Column, target: int) -> Column:
        # Targets whose source lies at ``at`` or beyond start at ceil(at * t / s).
        return F.least(F.ceil(at * target / size), F.lit(target)).cast("int")

    def target(r: Column) -> Column:
        y0, y1 = scaled(r["y0"], F.col("h"), height), scaled(r["y1"], F.col("h"), height)
        x0, x1 = scaled(r["x"], F.col("w"), width), scaled(r["x"] + 1, F.col("w"), width)
        columns = F.when(x0 < x1, F.sequence(x0, F.greatest(x1 - 1, x0))).otherwise(F.array().cast("array<int>"))
        return F.transform(columns, lambda x: F.struct((x * height + y0).alias("s"), (x * height + y1).alias("e")))

    spans = F.flatten(F.transform(run_columns(F.col("rle"), F.col("h")), target))
    rle = rle_from_cuts(_cuts(spans), F.lit(height * width))
    return masks.select(*MASK, rle.alias("rle")).select(*MASK, F.lit(height).alias("h"), F.lit(width).alias("w"), "rle")


def union_masks(masks: DataFrame, out_id: int = 0) -> DataFrame:
    """Pixel-wise OR of all masks of an image: a sweep over the ends of their runs.

    Ends are counted per place, map-side first, so however many masks share a pixel column
    the sweep over it meets at most one row per pixel row.
    """
    runs = on_runs(masks).select("image_id", "x", F.explode(F.array(
        F.struct(F.col("y0").alias("y"), F.lit(1).alias("step")), F.struct(F.col("y1").alias("y"), F.lit(-1).alias("step")),
    )).alias("_e"))
    ends = runs.groupBy("image_id", "x", F.col("_e.y").alias("y")).agg(F.sum("_e.step").alias("step")).where("step <> 0")
    column = Window.partitionBy("image_id", "x").orderBy("y")
    swept = ends.withColumn("_after", F.sum("step").over(column)).withColumn("_before", F.col("_after") - F.col("step"))
    switches = swept.where((F.col("_after") > 0) != (F.col("_before") > 0))
    frame = masks.groupBy("image_id").agg(F.max("h").alias("h"), F.max("w").alias("w"))
    found = _rle_from_switches(switches.select("image_id", F.array(_place(F.col("x"), F.col("y"))).alias("_at")), frame, ["image_id"])
    return found.select("image_id", F.lit(out_id).alias("seg_id"), "h", "w", "rle")


def fallback_segments(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Images without a mask get a whole-frame mask and a one-pixel mask.

    ``images`` is ``(image_id, h, w)``. The pixel is drawn from a hash of the image id.
    """
    from ..functions.hashing import draw

    bare = images.join(masks.select("image_id").distinct(), "image_id", "left_anti")
    total = (F.col("h") * F.col("w")).cast("int")
    spot = (draw(F.col("image_id")) % total).cast("int")
    whole = bare.select("image_id", F.lit(0).alias("seg_id"), "h", "w", F.array(F.lit(0), total).alias("rle"))
    tail = total - spot - 1
    dot = bare.select(
        "image_id", F.lit(1).alias("seg_id"), "h", "w",
        F.when(tail > 0, F.array(spot, F.lit(1), tail)).otherwise(F.array(spot, F.lit(1))).alias("rle"),
    )
    return masks.select("image_id", "seg_id", "h", "w", "rle").unionByName(whole).unionByName(dot)


# -- filters ---------------------------------------------------------------
def filter_segments(segments: DataFrame, min_area: float = 0) -> DataFrame:
    """Keep ``area > min_area`` and renumber per image from 0; 0 keeps all (T1).

    Only the ids are sorted and stored; whole rows take part in one join by (image, segment).
    Rows that repeat an id are numbered one after the other.
    """
    kept = segments.where(F.col("area") > min_area) if min_area else segments
    kept = kept.withColumn("_copy", F.row_number().over(Window.partitionBy("image_id", "seg_id").orderBy("area")))
    ids = [F.col(c) for c in ("image_id", "seg_id", "_copy")]
    numbered = dense_position(kept.select(*ids), ids[1:], "new_seg", ["image_id"])
    numbered = numbered.select(*[F.col(c).alias(f"_{c}") for c in ("image_id", "seg_id", "_copy")], "new_seg")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("image_id", "seg_id", "_copy")]
    return kept.join(numbered, same).select(*[F.col(c) for c in segments.columns if c != "new_seg"], numbered["new_seg"])


def filter_mask_quality(masks: DataFrame, iou: float = 0.88, stability: float = 0.95) -> DataFrame:
    """Predicted quality above, stability at or above; a threshold of 0 or less is skipped."""
    if iou > 0:
        masks = masks.where(F.col("predicted_iou") > iou)
    if stability > 0:
        masks = masks.where(F.col("stability_score") >= stability)
    return masks


def uncrop_boxes(masks: DataFrame) -> DataFrame:
    """Boxes from crop to image frame."""
    return masks.withColumns({
        "x0": F.col("x0") + F.col("crop_x0"), "y0": F.col("y0") + F.col("crop_y0"),
        "x1": F.col("x1") + F.col("crop_x0"), "y1": F.col("y1") + F.col("crop_y0"),
    })


def uncrop_points(points: DataFrame, x: str = "px", y: str = "py") -> DataFrame:
    return points.withColumns({x: F.col(x) + F.col("crop_x0"), y: F.col(y) + F.col("crop_y0")})


def uncrop_masks(masks: DataFrame, height: int, width: int) -> DataFrame:
    """Place crop-frame masks (with crop_x0, crop_y0) into the full frame by shifting their runs."""
    def shifted(r: Column) -> Column:
        start = (r["x"] + F.col("crop_x0").cast("int")) * height + F.col("crop_y0").cast("int")
        return F.struct((start + r["y0"]).alias("s"), (start + r["y1"]).alias("e"))

    spans = F.transform(run_columns(F.col("rle"), F.col("h")), shifted)
    rle = rle_from_cuts(_cuts(spans), F.lit(height * width))
    return masks.select(*MASK, rle.alias("rle")).select(*MASK, F.lit(height).alias("h"), F.lit(width).alias("w"), "rle")


def xyxy_to_xywh(masks: DataFrame) -> DataFrame:
    return masks.withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")})


def drop_crop_edge_masks(masks: DataFrame, height: float, width: float, atol: float = 20.0) -> DataFrame:
    """Drop boxes close to a crop edge that is not the image edge."""
    placed = {"x0": "crop_x0", "y0": "crop_y0", "x1": "crop_x0", "y1": "crop_y0"}
    frame = {"x0": 0.0, "y0": 0.0, "x1": float(width), "y1": float(height)}
    touching = F.lit(False)
    for side, shift in placed.items():
        at = F.col(side) + F.col(shift)
        near_crop = F.abs(at - F.col(f"crop_{side}")) <= atol
        near_image = F.abs(at - F.lit(frame[side])) <= atol
        touching = touching | (near_crop & ~near_image)
    return masks.where(~touching)
