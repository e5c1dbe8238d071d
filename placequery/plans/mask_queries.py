"""Mask geometry, filters and suppression queries."""

from pyspark.sql import functions as F

from ..operators import masks, regions, suppression
from .registry import query


def rle_masks(t):
    """Run lengths of the pixel masks (on where the value is positive)."""
    p = t.pixel_masks()
    bits = F.transform(masks.column_major(F.col("grid"), F.col("h"), F.col("w")), lambda v: v > 0)
    return p.withColumn("_bits", bits).select("image_id", "seg_id", "h", "w", masks.rle_from_bits(F.col("_bits")).alias("rle"))


ON = "SELECT image_id, seg_id, y, x FROM pixels WHERE v > 0"
RUNS = """SELECT image_id, seg_id, run, count(*) AS n, min(p) AS start, any_value(bit) AS bit FROM (
    SELECT *, sum(flip) OVER (PARTITION BY image_id, seg_id ORDER BY p) AS run FROM (
      SELECT *, CASE WHEN bit = lag(bit) OVER (PARTITION BY image_id, seg_id ORDER BY p) THEN 0 ELSE 1 END AS flip
      FROM ({bits}) b) f) r GROUP BY image_id, seg_id, run"""


def rle_sql(bits):
    """Run lengths in text form, off run first."""
    return f"""WITH runs AS ({RUNS.format(bits=bits)})
      SELECT image_id, seg_id, CASE WHEN arg_min(bit, start) = 1 THEN '0,' ELSE '' END || string_agg(n, ',' ORDER BY start) AS rle
      FROM runs GROUP BY image_id, seg_id"""


BITS = "SELECT image_id, seg_id, x * 8 + y AS p, CASE WHEN v > 0 THEN 1 ELSE 0 END AS bit FROM pixels"
RLE_COLS = "image_id:l seg_id:l rle:s"


def as_text(df):
    return df.withColumn("rle", F.concat_ws(",", F.col("rle").cast("array<string>")))


@query("rle_from_bits", RLE_COLS, rle_sql(BITS))
def _rle_bits(t):
    return as_text(rle_masks(t))


def pixel_table(t):
    p = t.pixel_masks().select("image_id", "seg_id", F.posexplode("grid").alias("d", "v")).where("v > 0")
    return p.select("image_id", "seg_id", F.floor(F.col("d") / 8).cast("int").alias("y"), (F.col("d") % 8).cast("int").alias("x"))


@query("rle_encode", RLE_COLS, rle_sql(BITS))
def _rle_encode(t):
    return as_text(masks.rle_encode(pixel_table(t), t.pixel_masks().select("image_id", "seg_id", "h", "w")))


@query("rle_decode", "image_id:l seg_id:l y:l x:l", ON)
def _rle_decode(t):
    return masks.rle_decode(rle_masks(t))


@query("rle_area", "image_id:l seg_id:l area:l", "SELECT image_id, seg_id, count_if(v > 0) AS area FROM pixels GROUP BY ALL")
def _rle_area(t):
    return rle_masks(t).select("image_id", "seg_id", masks.rle_area(F.col("rle")).alias("area"))


@query("mask_centroid", "image_id:l seg_id:l cx:d cy:d", f"SELECT image_id, seg_id, avg(x) AS cx, avg(y) AS cy FROM ({ON}) o GROUP BY ALL")
def _centroid(t):
    return masks.mask_centroid(rle_masks(t))


@query("mask_box", "image_id:l seg_id:l x0:l y0:l x1:l y1:l", """
    SELECT image_id, seg_id, coalesce(min(x) FILTER (WHERE v > 0.28), 0) AS x0, coalesce(min(y) FILTER (WHERE v > 0.28), 0) AS y0,
           coalesce(max(x) FILTER (WHERE v > 0.28), 0) AS x1, coalesce(max(y) FILTER (WHERE v > 0.28), 0) AS y1
    FROM pixels GROUP BY ALL""")
def _box(t):
    # A high threshold leaves some masks empty.
    p = t.pixel_masks()
    bits = F.transform(masks.column_major(F.col("grid"), F.col("h"), F.col("w")), lambda v: v > 0.28)
    return masks.mask_box(p.withColumn("_b", bits).select("image_id", "seg_id", "h", "w", masks.rle_from_bits(F.col("_b")).alias("rle")))


@query("area_covered", "image_id:l seg_id:l covered:d", "SELECT image_id, seg_id, count_if(v > 0) / 64.0 AS covered FROM pixels GROUP BY ALL")
def _covered(t):
    return masks.area_covered(rle_masks(t))


@query("stability_score", "image_id:l seg_id:l stability:d", """
    SELECT image_id, seg_id, count_if(v > 0.05) / nullif(count_if(v > -0.05), 0) AS stability FROM pixels GROUP BY ALL""")
def _stability(t):
    return masks.stability_score(t.pixel_masks(), 0.0, 0.05)


@query("pixel_to_patch", "image_id:l seg_id:l y:l x:l patch:l", """
    SELECT image_id, seg_id, y * 6 AS y, x * 6 AS x, least(y * 6 // 14, 2) * 3 + least(x * 6 // 14, 2) AS patch FROM pixels WHERE v > 0""")
def _pixel_patch(t):
    scaled = pixel_table(t).withColumn("y", F.col("y") * 6).withColumn("x", F.col("x") * 6)
    return scaled.withColumn("patch", masks.pixel_to_patch(F.col("y"), F.col("x"), 48, 48))


@query("segment_patch_incidence", "image_id:l seg_id:l patch_id:l", """
    SELECT DISTINCT image_id, seg_id, least(y // 3, 1) * 2 + least(x // 3, 1) AS patch_id FROM pixels WHERE v > 0""")
def _incidence(t):
    return masks.segment_patch_incidence(rle_masks(t), 8, 8, 3)


def _resize_sql(h, w):
    return f"""SELECT p.image_id, p.seg_id, tx.t * {h} + ty.t AS p, CASE WHEN p.v > 0 THEN 1 ELSE 0 END AS bit
      FROM (SELECT unnest(range({h})) AS t) ty, (SELECT unnest(range({w})) AS t) tx, pixels p
      WHERE p.y = ty.t * 8 // {h} AND p.x = tx.t * 8 // {w}"""


@query("resize_mask_nearest", RLE_COLS, rle_sql(_resize_sql(12, 20)))
def _resize(t):
    return as_text(masks.resize_mask_nearest(rle_masks(t), 12, 20))


@query("resize_mask_smaller", RLE_COLS, rle_sql(_resize_sql(5, 3)))
def _resize_small(t):
    return as_text(masks.resize_mask_nearest(rle_masks(t), 5, 3))


@query("union_masks", RLE_COLS, rle_sql("""
    SELECT image_id, 0 AS seg_id, x * 8 + y AS p, max(CASE WHEN v > 0.15 THEN 1 ELSE 0 END) AS bit FROM pixels GROUP BY image_id, x, y"""))
def _union(t):
    p = t.pixel_masks()
    bits = F.transform(masks.column_major(F.col("grid"), F.col("h"), F.col("w")), lambda v: v > 0.15)
    m = p.withColumn("_b", bits).select("image_id", "seg_id", "h", "w", masks.rle_from_bits(F.col("_b")).alias("rle"))
    return as_text(masks.union_masks(m))


@query("fallback_segments", RLE_COLS, f"""
    WITH kept AS ({rle_sql(BITS)}), bare AS (
      SELECT image_id, (image_id * 2654435761 % 4294967296) % 64 AS spot FROM patches GROUP BY image_id HAVING image_id % 4 = 1)
    SELECT * FROM kept WHERE image_id % 4 <> 1
    UNION ALL SELECT image_id, 0, '0,64' FROM bare
    UNION ALL SELECT image_id, 1, spot || ',1' || CASE WHEN spot < 63 THEN ',' || (63 - spot) ELSE '' END FROM bare""")
def _fallback(t):
    frames = t.images().select("image_id", F.lit(8).alias("h"), F.lit(8).alias("w"))
    return as_text(masks.fallback_segments(frames, rle_masks(t).where("image_id % 4 <> 1")))


@query("filter_segments", "image_id:l seg_id:l new_seg:l area:d", """
    SELECT image_id, seg_id, area, row_number() OVER (PARTITION BY image_id ORDER BY seg_id) - 1 AS new_seg FROM boxes WHERE area > 2500""")
def _filter_segments(t):
    return masks.filter_segments(t.boxes(), 2500)


@query("filter_segments_all", "image_id:l seg_id:l new_seg:l", """
    SELECT image_id, seg_id, row_number() OVER (PARTITION BY image_id ORDER BY seg_id) - 1 AS new_seg FROM boxes""")
def _filter_all(t):
    return masks.filter_segments(t.boxes())


BOX_COLS = "image_id:l seg_id:l x0:d y0:d x1:d y1:d"


@query("filter_mask_quality", BOX_COLS, "SELECT * FROM boxes WHERE predicted_iou > 0.88 AND stability_score >= 0.95")
def _quality(t):
    return masks.filter_mask_quality(t.boxes())


@query("drop_crop_edge_masks", BOX_COLS, """
    SELECT * FROM boxes WHERE NOT (
      (abs(x0 + crop_x0 - crop_x0) <= 5 AND NOT abs(x0 + crop_x0 - 0) <= 5)
      OR (abs(y0 + crop_y0 - crop_y0) <= 5 AND NOT abs(y0 + crop_y0 - 0) <= 5)
      OR (abs(x1 + crop_x0 - crop_x1) <= 5 AND NOT abs(x1 + crop_x0 - 120) <= 5)
      OR (abs(y1 + crop_y0 - crop_y1) <= 5 AND NOT abs(y1 + crop_y0 - 110) <= 5))""")
def _edge(t):
    return masks.drop_crop_edge_masks(t.boxes(), 110, 120, 5.0)


@query("uncrop_boxes", BOX_COLS, """
    SELECT image_id, seg_id, x0 + crop_x0 AS x0, y0 + crop_y0 AS y0, x1 + crop_x0 AS x1, y1 + crop_y0 AS y1 FROM boxes""")
def _uncrop(t):
    return masks.uncrop_boxes(t.boxes())


@query("uncrop_points", "image_id:l seg_id:l px:d py:d", """
    SELECT image_id, seg_id, (x0 + x1) / 2 + crop_x0 AS px, (y0 + y1) / 2 + crop_y0 AS py FROM boxes""")
def _uncrop_points(t):
    b = t.boxes().withColumn("px", (F.col("x0") + F.col("x1")) / 2).withColumn("py", (F.col("y0") + F.col("y1")) / 2)
    return masks.uncrop_points(b)


@query("uncrop_masks", RLE_COLS, rle_sql("""
    SELECT f.image_id, f.seg_id, f.fx * 12 + f.fy AS p, CASE WHEN p.v > 0 THEN 1 ELSE 0 END AS bit FROM (
      SELECT DISTINCT q.image_id, q.seg_id, x.t AS fx, y.t AS fy FROM pixels q,
      (SELECT unnest(range(11)) AS t) x, (SELECT unnest(range(12)) AS t) y) f
    LEFT JOIN pixels p ON p.image_id = f.image_id AND p.seg_id = f.seg_id AND p.x = f.fx - f.seg_id % 4 AND p.y = f.fy - 2"""))
def _uncrop_masks(t):
    shifted = rle_masks(t).withColumn("crop_x0", F.col("seg_id") % 4).withColumn("crop_y0", F.lit(2))
    return as_text(masks.uncrop_masks(shifted, 12, 11))


@query("xyxy_to_xywh", "image_id:l seg_id:l x0:d y0:d w:d h:d", "SELECT image_id, seg_id, x0, y0, x1 - x0 AS w, y1 - y0 AS h FROM boxes")
def _xywh(t):
    return masks.xyxy_to_xywh(t.boxes())


def nms_sql(score, threshold, rounds):
    """Greedy suppression written as a fixed number of rounds of the same recursion."""
    iou = """greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"""
    ctes = [f"""sb AS (SELECT *, {score} AS sc FROM boxes),
      e AS MATERIALIZED (SELECT a.image_id, a.seg_id AS hi, b.seg_id AS lo FROM sb a JOIN sb b ON a.image_id = b.image_id
        AND (a.sc > b.sc OR (a.sc = b.sc AND a.seg_id < b.seg_id))
        AND {iou} > {threshold} * (a.area + b.area - {iou})), d0 AS MATERIALIZED (SELECT image_id, lo AS seg FROM e WHERE false)"""]
    for i in range(rounds):
        # Decided losers are beaten by a box that no remaining box beats.
        ctes.append(f"""l{i} AS MATERIALIZED (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM d{i} d WHERE d.image_id = e.image_id AND d.seg = e.lo)
            AND NOT EXISTS (SELECT 1 FROM d{i} d WHERE d.image_id = e.image_id AND d.seg = e.hi)),
          d{i + 1} AS MATERIALIZED (SELECT * FROM d{i} UNION SELECT image_id, lo FROM l{i} w
            WHERE NOT EXISTS (SELECT 1 FROM l{i} x WHERE x.image_id = w.image_id AND x.lo = w.hi))""")
    return f"""WITH {', '.join(ctes)} SELECT image_id, seg_id, x0, y0, x1, y1 FROM sb
      WHERE NOT EXISTS (SELECT 1 FROM d{rounds} d WHERE d.image_id = sb.image_id AND d.seg = sb.seg_id)"""


@query("nms_boxes", BOX_COLS, nms_sql("predicted_iou", 0.5, 6))
def _nms(t):
    return suppression.nms_boxes(t.boxes(), 0.5)


@query("nms_across_crops", BOX_COLS, nms_sql("1 / ((crop_x1 - crop_x0) * (crop_y1 - crop_y0))", 0.6, 6))
def _nms_crops(t):
    return suppression.nms_across_crops(t.boxes(), 0.6)


def _reach(name, source, wanted):
    """Pixels reachable over 8 neighbours from each wanted pixel."""
    return f"""{name}(image_id, seg_id, y, x, ry, rx) AS (
      SELECT image_id, seg_id, y, x, y, x FROM {source} WHERE {wanted} UNION
      SELECT r.image_id, r.seg_id, r.y, r.x, p.y, p.x FROM {name} r JOIN (SELECT * FROM {source} WHERE {wanted}) p
        ON p.image_id = r.image_id AND p.seg_id = r.seg_id AND abs(p.y - r.ry) <= 1 AND abs(p.x - r.rx) <= 1)"""


CLEAN_SQL = f"""WITH RECURSIVE px AS (SELECT image_id, seg_id, y, x, v > 0 AS bit FROM pixels), {_reach('off_reach', 'px', 'NOT bit')},
    holes AS (SELECT image_id, seg_id, y, x, count(*) AS size FROM off_reach GROUP BY ALL),
    filled AS (SELECT px.image_id, px.seg_id, px.y, px.x, bit OR coalesce(size < 4, false) AS bit, coalesce(size < 4, false) AS was_hole
               FROM px LEFT JOIN holes USING (image_id, seg_id, y, x)),
    {_reach('on_reach', 'filled', 'bit')},
    islands AS (SELECT image_id, seg_id, y, x, count(*) AS size, min(ry * 8 + rx) AS label FROM on_reach GROUP BY ALL),
    largest AS (SELECT image_id, seg_id, max(size) AS top, min(size) AS low, arg_min(label, (-size, label)) AS label FROM islands GROUP BY ALL),
    kept AS (SELECT i.image_id, i.seg_id, count(*) AS area FROM islands i JOIN largest l USING (image_id, seg_id)
             WHERE i.size >= 4 OR (l.top < 4 AND i.label = l.label) GROUP BY ALL)
    SELECT f.image_id, f.seg_id, NOT bool_or(f.was_hole) AND any_value(coalesce(l.low, 4)) >= 4 AS unchanged,
           any_value(coalesce(k.area, 0)) AS area
    FROM filled f LEFT JOIN kept k USING (image_id, seg_id) LEFT JOIN largest l USING (image_id, seg_id) GROUP BY f.image_id, f.seg_id"""


@query("clean_masks", "image_id:l seg_id:l unchanged:b area:l", CLEAN_SQL)
def _clean_masks(t):
    return regions.clean_masks(rle_masks(t), 4).withColumn("area", masks.rle_area(F.col("rle")))


@query("clean_small_regions", "image_id:l seg_id:l unchanged:b area:l")
def _clean(t):
    out = regions.clean_small_regions(rle_masks(t), 4, 0.9)
    return out.withColumn("area", masks.rle_area(F.col("rle")))
