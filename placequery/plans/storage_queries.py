"""Sources and sinks: every query writes and reads back, or parses derived text."""

from pyspark.sql import functions as F

from ..functions.ordering import dense_position
from ..functions.storage import scratch_path
from ..functions.vectors import long_form
from ..operators import aggregate, burst, diagnostics, sampling, vocabulary, vote
from ..sources import models, paths, poses, results, tables
from ..streaming import retrieve
from .descriptors import BURST, RESIDUALS, soft_sums_sql, softmax_sql, vlad_sql, vocab
from .evaluation import NEAR_SQL, gt, near, query_images
from .registry import query
from .retrieval import matches, predictions, sides


@query("read_patches", "image_id:l patch_id:l py:l px:l role:s dim:l value:d", """
    SELECT image_id, patch_id, py, px, role, d - 1 AS dim, v AS value FROM patch_long""")
def _read_patches(t):
    """A descriptor map per image, exploded, written by role and read back."""
    maps = t.patches().groupBy("image_id", "role").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("patch_id", "embedding"))), lambda s: s["embedding"]).alias("cells")
    ).withColumn("width", F.lit(5)).withColumn("dataset", F.lit("fixture"))
    rows = tables.explode_descriptor_map(maps).withColumn("embedding", F.col("embedding").cast("array<float>"))
    path = scratch_path(t.spark, "patches")
    tables.write_patches(rows, path)
    back = tables.read_patches(t.spark, path)
    return long_form(back.drop("dataset").withColumn("embedding", F.col("embedding").cast("array<double>")), "embedding")


@query("read_patches_skip_rows", "image_id:l patch_id:l py:l px:l", """
    SELECT image_id, patch_id, py - 1 AS py, px FROM patches WHERE py >= 1""")
def _skip_rows(t):
    path = scratch_path(t.spark, "patches")
    tables.write_patches(t.patches().drop("vec_id", "label").withColumn("dataset", F.lit("fixture")), path)
    return tables.read_patches(t.spark, path, rmin=14)


@query("read_masks", "image_id:l seg_id:l area:l x:d y:d w:d h:d runs:l", """
    SELECT image_id, seg_id, count_if(v > 0) AS area, min(x) FILTER (WHERE v > 0) AS x, min(y) FILTER (WHERE v > 0) AS y,
           max(x) FILTER (WHERE v > 0) - min(x) FILTER (WHERE v > 0) AS w, max(y) FILTER (WHERE v > 0) - min(y) FILTER (WHERE v > 0) AS h,
           any_value(flips) AS runs FROM pixels JOIN (
      SELECT image_id, seg_id, count_if(bit <> coalesce(prev, 0)) + 1 AS flips FROM (
        SELECT image_id, seg_id, v > 0 AS b, CASE WHEN v > 0 THEN 1 ELSE 0 END AS bit,
               lag(CASE WHEN v > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, seg_id ORDER BY x * 8 + y) AS prev
        FROM pixels) s GROUP BY ALL) f USING (image_id, seg_id) GROUP BY image_id, seg_id""")
def _read_masks(t):
    """Mask records with run lengths and box, written and read with the declared schema."""
    from ..operators import masks as geometry
    from .mask_queries import rle_masks

    m = rle_masks(t)
    boxed = geometry.mask_box(m).join(m, ["image_id", "seg_id"])
    number = F.lit(None).cast("double")
    path = scratch_path(t.spark, "masks")
    boxed.select(
        "image_id", F.col("seg_id").cast("long").alias("seg_id"), "rle", F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"),
        geometry.rle_area(F.col("rle")).alias("area"),
        F.struct(*[v.cast("double").alias(n) for n, v in (
            ("x", F.col("x0")), ("y", F.col("y0")), ("w", F.col("x1") - F.col("x0")), ("h", F.col("y1") - F.col("y0")))]).alias("bbox"),
        number.alias("predicted_iou"), number.alias("stability_score"),
    ).write.parquet(path)
    back = tables.read_masks(t.spark, path)
    return back.select("image_id", "seg_id", "area", "bbox.x", "bbox.y", "bbox.w", "bbox.h", F.size("rle").alias("runs"))


@query("count_masks", "image_id:l n_masks:l", """
    SELECT i.image_id, count(b.seg_id) AS n_masks FROM (SELECT o_orderkey AS image_id FROM orders) i
    LEFT JOIN boxes b ON b.image_id = i.image_id AND b.predicted_iou > 0.88 GROUP BY ALL""")
def _count_masks(t):
    kept = t.boxes().where("predicted_iou > 0.88")
    return tables.count_masks(kept, t.table("orders").select(F.col("o_orderkey").alias("image_id")))


CITY_PLACES = """SELECT c_nationkey + 100000 * (dense_rank() OVER (ORDER BY c_mktsegment) - 1) AS place_id,
    c_mktsegment AS city_id, c_custkey AS image_id FROM customer"""


@query("prefix_place_ids", "place_id:l city_id:s image_id:l", CITY_PLACES)
def _prefix(t):
    c = t.table("customer").select(F.col("c_nationkey").cast("long").alias("place_id"), F.col("c_mktsegment").alias("city_id"), F.col("c_custkey").alias("image_id"))
    cities = dense_position(c.select("city_id").distinct(), [F.col("city_id")], "ordinal")
    return tables.prefix_place_ids(c, cities)


@query("read_place_tables", "place_id:l city_id:s panoid:s year:l month:l northdeg:l lat:d lon:d", """
    SELECT place_id + 100000 * (dense_rank() OVER (ORDER BY city_id) - 1) AS place_id, city_id, panoid, year, month, northdeg, lat, lon
    FROM places""")
def _place_tables(t):
    """One CSV table per city, written and read back under one id space."""
    p = t.places().select("place_id", "city_id", "panoid", "year", "month", "northdeg", "lat", "lon")
    base = scratch_path(t.spark, "places")
    p.withColumn("city", F.col("city_id")).write.partitionBy("city").option("header", True).csv(base)
    return tables.read_place_tables(t.spark, [f"{base}/city=*"])


@query("parse_camera_poses", "image_id:l x:d y:d z:d a:d b:d c:d", """
    SELECT image_id, x, y, z, a, b, c FROM poses""")
def _poses(t):
    """Pose text composed from known angles; parsing must give them back."""
    p = t.poses()
    ca, sa, cb, sb, cc, sc = (f(F.radians(k)) for k in "abc" for f in (F.cos, F.sin))
    # Rotation about x by c, then y by b, then z by a, read in the parser's convention.
    rows = [
        (ca * cb, -sa * cb, sb),
        (sa * cc + ca * sb * sc, ca * cc - sa * sb * sc, -cb * sc),
        (sa * sc - ca * sb * cc, ca * sc + sa * sb * cc, cb * cc),
    ]
    text = [F.lit(f"header {i}") for i in range(4)]
    text += [F.concat_ws(" ", *[v.cast("string") for v in row]) for row in rows]
    text += [F.concat_ws(" ", *[F.col(v).cast("string") for v in "xyz"]), F.lit("end")]
    files = p.select("image_id", F.concat(F.concat_ws("\n", *text), F.lit("\n")).alias("value"))
    path = scratch_path(t.spark, "poses")
    files.write.partitionBy("image_id").option("lineSep", "\n\n").text(path)
    back = poses.read_pose_files(t.spark, path).withColumn("value", F.regexp_replace("value", r"\n\n\z", ""))
    return poses.parse_camera_poses(back)


@query("read_match_table", "q_image:l r_image:l", f"SELECT q_image, r_image FROM ({NEAR_SQL}) n")
def _match_table(t):
    wide = near(t).groupBy(F.col("q_image").alias("query_ind")).agg(
        *[F.max(F.when(F.col("n") == i, F.col("r_image"))).alias(f"top_{i}_ref_ind") for i in range(1, 6)]
    )
    path = scratch_path(t.spark, "matches")
    wide.write.option("header", True).csv(path)
    schema = "query_ind BIGINT, " + ", ".join(f"{c} BIGINT" for c in tables.MATCH_COLUMNS)
    return tables.read_match_table(t.spark.read.schema(schema).option("header", True).csv(path))


@query("write_results", "q_image:l q_seg:l rank:l r_image:l r_seg:l sim:d", "SELECT * FROM matches")
def _write_results(t):
    path = scratch_path(t.spark, "results")
    m = matches(t)
    results.write_results(m.where("rank = 1"), path, "baseline")
    results.write_results(m, path, "default")
    return results.read_results(t.spark, path, "default")


@query("write_match_info", "q_image:l seg_id_q:l seg_id_r:l img_id_r:l", """
    WITH votes AS (SELECT q_image, r_image, count(*) AS n FROM matches WHERE rank = 1 GROUP BY ALL),
    top AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY q_image ORDER BY n DESC, r_image) <= 5)
    SELECT m.q_image, m.q_seg AS seg_id_q, m.r_seg AS seg_id_r, m.r_image AS img_id_r
    FROM matches m JOIN top USING (q_image, r_image) WHERE m.rank = 1""")
def _write_match_info(t):
    records = results.match_records(vote.match_info(matches(t)), gt(t), query_images(t))
    path = scratch_path(t.spark, "match-info")
    results.write_match_info(records, path)
    return results.read_match_info(t.spark, path)


@query("match_records", "q_image:l kind:s part:l payload:s", """
    WITH votes AS (SELECT q_image, r_image, count(*) AS n FROM matches WHERE rank = 1 GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY q_image ORDER BY n DESC, r_image) AS pos FROM votes QUALIFY pos <= 5),
    seg AS (SELECT m.q_image, m.q_seg, m.r_seg, m.r_image FROM matches m JOIN top USING (q_image, r_image) WHERE m.rank = 1)
    SELECT q.q_image, 'gt' AS kind, 0 AS part,
           '[' || coalesce((SELECT string_agg(r_image, ',' ORDER BY r_image) FROM gt WHERE gt.q_image = q.q_image), '') || ']' AS payload
    FROM query_images q
    UNION ALL SELECT q_image, 'img_id_r', 0, '[' || string_agg(r_image, ',' ORDER BY pos) || ']' FROM top GROUP BY q_image
    UNION ALL SELECT q_image, 'segments', 0, '[' || string_agg('{"seg_id_q":' || q_seg || ',"seg_id_r":' || r_seg || ',"img_id_r":' || r_image || '}',
      ',' ORDER BY q_seg, r_seg) || ']' FROM seg GROUP BY q_image""")
def _match_records(t):
    return results.match_records(vote.match_info(matches(t)), gt(t), query_images(t))


@query("submission_lines", "line:s", """
    WITH l AS (SELECT p.q_image, string_agg('img' || p.r_image, ' ' ORDER BY p.rank) AS preds FROM predictions p GROUP BY ALL)
    SELECT 'img' || q_image || coalesce(' ' || preds, '') AS line FROM query_images LEFT JOIN l USING (q_image)""")
def _submission(t):
    m = t.manifest()
    q = m.where("role = 'query'").select(F.col("image_id").alias("q_image"), "path")
    r = m.where("role = 'ref'").select(F.col("image_id").alias("r_image"), "path")
    path = scratch_path(t.spark, "submission")
    results.write_submission(results.submission_lines(predictions(t), q, r), path)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


META = " ".join(["image_id:l", "id:l"] + [f"{c}:d" for c in results.MASK_COLUMNS[1:]])


@query("write_mask_metadata", META, """
    SELECT image_id, seg_id AS id, area, x0 AS bbox_x0, y0 AS bbox_y0, x1 - x0 AS bbox_w, y1 - y0 AS bbox_h,
           (x0 + x1) / 2 AS point_input_x, (y0 + y1) / 2 AS point_input_y, predicted_iou, stability_score,
           crop_x0 AS crop_box_x0, crop_y0 AS crop_box_y0, crop_x1 - crop_x0 AS crop_box_w, crop_y1 - crop_y0 AS crop_box_h
    FROM boxes""")
def _mask_metadata(t):
    b = t.boxes().withColumn("px", (F.col("x0") + F.col("x1")) / 2).withColumn("py", (F.col("y0") + F.col("y1")) / 2)
    path = scratch_path(t.spark, "mask-metadata")
    results.write_mask_metadata(b, path)
    schema = "image_id BIGINT, id BIGINT, " + ", ".join(f"{c} DOUBLE" for c in results.MASK_COLUMNS[1:])
    return t.spark.read.schema(schema).option("header", True).csv(path)


@query("write_mask_metadata_json", "image_id:l seg_id:l area:d predicted_iou:d", "SELECT image_id, seg_id, area, predicted_iou FROM boxes")
def _mask_json(t):
    path = scratch_path(t.spark, "mask-json")
    results.write_mask_metadata(t.boxes(), path, "json")
    return t.spark.read.schema("image_id BIGINT, seg_id BIGINT, area DOUBLE, predicted_iou DOUBLE").json(path)


@query("write_assignment_diagnostics", "image_id:l patch_id:l cluster:l soft:d adjusted:d w:d", f"""
    WITH b AS (SELECT image_id, patch_id, sum(1 / (1 + exp(-(8.0 * (-2 + 2 * dd) + 7.0)))) AS w FROM (
      SELECT a.image_id, a.patch_id, list_dot_product(a.e, b.e) AS dd FROM patches a JOIN patches b ON a.image_id = b.image_id) x GROUP BY ALL)
    SELECT s.image_id, s.patch_id, s.cluster, s.w AS soft, s.w / b.w AS adjusted, b.w FROM ({softmax_sql('5.0')}) s JOIN b USING (image_id, patch_id)""")
def _diagnostics(t):
    p = t.patches()
    soft = aggregate.soft_assignment(p.select("image_id", "patch_id", "embedding"), vocab(t), 5.0).drop("embedding")
    out = soft.join(burst.burst_weights(p), ["image_id", "patch_id"])
    path = scratch_path(t.spark, "diagnostics")
    # A second call finds every image stored and adds nothing.
    results.write_assignment_diagnostics(out.where("image_id % 2 = 0"), path)
    results.write_assignment_diagnostics(out, path)
    back = t.spark.read.parquet(path)
    return back.select("image_id", "patch_id", "w", F.posexplode("soft").alias("cluster", "soft")).withColumn("adjusted", F.col("soft") / F.col("w"))


@query("assignment_record", "field:s image_id:l patch_id:l place:l value:d", f"""
    WITH soft AS ({softmax_sql('5.0')}), b AS ({BURST}),
    own AS (SELECT s.image_id, s.vec_id, s.cluster, s.w / b.w AS w FROM soft s JOIN b USING (image_id, patch_id)),
    vlad AS ({vlad_sql(soft_sums_sql('SELECT * FROM own'), 'image_id')})
    SELECT 'soft' AS field, image_id, patch_id, cluster AS place, w AS value FROM soft
    UNION ALL SELECT 'adjusted', s.image_id, s.patch_id, s.cluster, s.w / b.w FROM soft s JOIN b USING (image_id, patch_id)
    UNION ALL SELECT 'burst', image_id, patch_id, 0, w FROM b
    UNION ALL SELECT 'self_distance', a.image_id, a.patch_id, o.patch_id, -2 + 2 * list_dot_product(a.e, o.e)
      FROM patches a JOIN patches o ON a.image_id = o.image_id
    UNION ALL SELECT 'vlad', image_id, cluster, dim, value FROM vlad""")
def _assignment_record(t):
    """All fields of an aggregation, stored by image in two calls and read back."""
    p, path = t.patches(), scratch_path(t.spark, "assignment")
    fields = diagnostics.assignment_fields(p, vocab(t), 5.0)
    images = p.select("image_id").distinct()
    results.cached_fields(images.where("image_id % 2 = 0"), fields, path, "image_id")
    back = results.cached_fields(images, fields, path, "image_id")

    def rows(field, patch, place, value):
        return back[field].select(F.lit(field).alias("field"), "image_id", F.col(patch).alias("patch_id"), place.alias("place"), value.alias("value"))

    def entries(field, patch, vec):
        return long_form(back[field].select(F.lit(field).alias("field"), "image_id", F.col(patch).cast("long").alias("patch_id"), vec), vec, "place")

    return tables.concat_batches([
        entries("soft", "patch_id", "soft"), entries("adjusted", "patch_id", "adjusted"), entries("vlad", "cluster", "residual"),
        rows("burst", "patch_id", F.lit(0), F.col("w")), rows("self_distance", "patch_id", F.col("other_id"), F.col("d")),
    ])


@query("cached_assignments", "cache_id:l cluster:l label:l value:d", f"""
    SELECT s.vec_id AS cache_id, s.cluster, l.cluster AS label, s.w AS value FROM ({softmax_sql('3.0')}) s
    JOIN (SELECT vec_id, cluster FROM ({softmax_sql('1.0')}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, cluster) = 1) l USING (vec_id)""")
def _cached_assignments(t):
    """Labels and soft assignments of every vector, a third of them found in the store."""
    vectors, path = t.patches().select(F.col("vec_id").alias("cache_id"), "embedding"), scratch_path(t.spark, "cache")
    fields = diagnostics.cache_fields(vectors, vocab(t), 3.0)
    wanted = {name: fields[name] for name in ("labels", "soft")}
    results.cached_fields(vectors.select("cache_id").where("cache_id % 3 = 0"), wanted, path)
    back = results.cached_fields(vectors.select("cache_id"), wanted, path)
    labels = back["labels"].withColumnRenamed("cluster", "label")
    return long_form(back["soft"], "soft", "cluster").join(labels, "cache_id")


@query("select_manifest", "image_id:l path:s", """
    SELECT image_id, path FROM manifest WHERE path LIKE '%/cph/%'
      AND 'img' || image_id || '.jpg' IN (SELECT 'img' || (label * 4) || '.jpg' FROM embeddings)""")
def _manifest(t):
    names = t.table("embeddings").select(F.concat(F.lit("img"), (F.col("label") * 4).cast("string"), F.lit(".jpg")).alias("name"))
    return tables.select_manifest(t.manifest(), names, "cph")


@query("verify_counts", "city:s role:s n_found:l n_expected:l matches:b", """
    WITH found AS (SELECT city, role, count(*) AS n FROM manifest GROUP BY ALL),
    expected AS (SELECT CASE WHEN label % 2 = 0 THEN 'cph' ELSE 'oslo' END AS city, 'query' AS role, count(DISTINCT label) AS n
                 FROM embeddings GROUP BY ALL)
    SELECT coalesce(f.city, e.city) AS city, coalesce(f.role, e.role) AS role, coalesce(f.n, 0) AS n_found,
           coalesce(e.n, 0) AS n_expected, coalesce(f.n, 0) = coalesce(e.n, 0) AS matches
    FROM found f FULL OUTER JOIN expected e ON f.city = e.city AND f.role = e.role""")
def _verify(t):
    e = t.table("embeddings").select(F.when(F.col("label") % 2 == 0, "cph").otherwise("oslo").alias("city"), F.lit("query").alias("role"), "label")
    expected = e.groupBy("city", "role").agg(F.count_distinct("label").alias("n_expected"))
    return tables.verify_counts(t.manifest(), expected)


@query("resolve_model", "model_key:s cluster:l dim:l value:d", """
    SELECT 'vocabulary_urban' AS model_key, cluster, d - 1 AS dim, c AS value FROM vocabulary_long""")
def _resolve(t):
    path = scratch_path(t.spark, "models")
    k = t.vocabulary().count()
    models.resolve_model(t.spark, path, "vocabulary", "pitts", t.vocabulary, k)

    def never():
        raise AssertionError("the stored model should have been used")

    # Another dataset of the same domain shares the stored vocabulary.
    return long_form(models.resolve_model(t.spark, path, "vocabulary", "mslsSF", never, k), "centroid")


@query("cached_residuals", "cache_id:l dim:l value:d", f"""
    SELECT vec_id AS cache_id, cluster * 64 + d - 1 AS dim, r AS value FROM ({RESIDUALS}) x""")
def _cached(t):
    v = vocab(t)
    ids = t.patch_list().select(F.col("vec_id").alias("cache_id"))
    vectors = t.patches().select(F.col("vec_id").alias("cache_id"), "embedding")
    path = scratch_path(t.spark, "residuals")

    def compute(missing):
        return vocabulary.residual_vectors(vectors.join(missing, "cache_id"), v).drop("embedding")

    results.cached(ids.where("cache_id % 3 = 0"), compute, path)
    return long_form(results.cached(ids, compute, path), "residuals")


@query("image_name", "image_id:l name:s", """
    SELECT image_id, city_id || '_' || lpad(CAST(place_id % 100000 AS VARCHAR), 7, '0') || '_' || lpad(CAST(year AS VARCHAR), 4, '0')
      || '_' || lpad(CAST(month AS VARCHAR), 2, '0') || '_' || lpad(CAST(northdeg AS VARCHAR), 3, '0') || '_'
      || CAST(round(lat) AS BIGINT) || '_' || CAST(round(lon) AS BIGINT) || '_' || panoid || '.jpg' AS name FROM places""")
def _image_name(t):
    # Whole degrees: engines print other doubles differently.
    whole = t.places().withColumn("lat", F.round("lat").cast("long")).withColumn("lon", F.round("lon").cast("long"))
    return whole.select("image_id", paths.place_image_name().alias("name"))


@query("method_name", "path:s name:s", """
    SELECT path, 'run' || (image_id % 7) || '_img' || image_id AS name FROM (
      SELECT image_id, 'logs/run' || (image_id % 7) || '/img' || image_id || '_predictions.npz' AS path FROM manifest) x""")
def _method_name(t):
    p = t.manifest().select(F.concat(
        F.lit("logs/run"), (F.col("image_id") % 7).cast("string"), F.lit("/img"), F.col("image_id").cast("string"), F.lit("_predictions.npz")
    ).alias("path"))
    return p.select("path", paths.method_name(F.col("path")).alias("name"))


@query("concat_batches", "image_id:l seg_id:l area:d predicted_iou:d", """
    SELECT image_id, seg_id, area, CASE WHEN crop_x0 = 0 THEN NULL ELSE predicted_iou END AS predicted_iou FROM boxes""")
def _concat(t):
    b = t.boxes().select("image_id", "seg_id", "area", "predicted_iou", "crop_x0")
    first = b.where("crop_x0 = 0").drop("predicted_iou")
    return tables.concat_batches([b.where("crop_x0 = 10"), first, b.where("crop_x0 = 20")])


# -- sampling --------------------------------------------------------------
def draw_sql(key, seed=0):
    return f"(({key} % 4294967296) * 2654435761 + {seed}) % 4294967296"


@query("sample_segments", "image_id:l seg_id:l", f"""
    WITH s AS (SELECT image_id, seg_id, image_id * 10 + seg_id AS uid FROM segments),
    q AS (SELECT image_id, CAST(floor(count(*) * least(1.0, 100.0 / (SELECT count(*) FROM s))) AS BIGINT) AS take FROM s GROUP BY ALL),
    o AS (SELECT *, sum(take) OVER (ORDER BY image_id) - take AS before FROM q)
    SELECT image_id, seg_id FROM (SELECT s.*, o.take, o.before,
      row_number() OVER (PARTITION BY s.image_id ORDER BY {draw_sql('uid', 7)}, uid) AS pos FROM s JOIN o USING (image_id)) x
    WHERE pos <= take AND before < 100""")
def _sample_segments(t):
    s = t.segments().select("image_id", "seg_id", (F.col("image_id") * 10 + F.col("seg_id")).alias("uid"))
    return sampling.sample_segments(s, "uid", 100, 7)


def _vocab_sample(threshold):
    return f"""WITH i AS (SELECT image_id, row_number() OVER (ORDER BY {draw_sql('image_id', 42)}, image_id) - 1 AS pos,
        count(*) OVER () AS n FROM (SELECT DISTINCT image_id FROM patches) u)
      SELECT p.vec_id, p.image_id, p.py, p.px FROM patches p JOIN i USING (image_id)
      WHERE n <= {threshold} OR (pos < floor(n * 0.3) AND p.py % 2 = 0 AND p.px % 2 = 0)"""


@query("sample_for_vocabulary", "vec_id:l image_id:l py:l px:l", _vocab_sample(20))
def _sample_vocab(t):
    return sampling.sample_for_vocabulary(t.patch_list(), threshold=20)


@query("sample_for_vocabulary_all", "vec_id:l image_id:l py:l px:l", _vocab_sample(2000))
def _sample_vocab_all(t):
    return sampling.sample_for_vocabulary(t.patch_list(), threshold=2000)


@query("sample_fixed", "vec_id:l image_id:l draw_rank:l", f"""
    WITH i AS (SELECT image_id, row_number() OVER (ORDER BY {draw_sql('image_id', 3)}, image_id) AS pos
               FROM (SELECT DISTINCT image_id FROM patches) u)
    SELECT p.vec_id, p.image_id, row_number() OVER (PARTITION BY p.image_id ORDER BY {draw_sql('p.vec_id', 3)}, p.vec_id) AS draw_rank
    FROM patches p JOIN i USING (image_id) WHERE pos <= 25 QUALIFY draw_rank <= 4""")
def _sample_fixed(t):
    return sampling.sample_fixed(t.patch_list(), "vec_id", n=100, per_image=4, seed=3)


@query("places_with_min_images", "place_id:l image_id:l", """
    SELECT place_id, image_id FROM places WHERE place_id IN (SELECT place_id FROM places GROUP BY place_id HAVING count(*) >= 66)""")
def _min_images(t):
    return sampling.places_with_min_images(t.places(), 66)


@query("images_per_place_random", "place_id:l image_id:l pick:l", f"""
    SELECT place_id, image_id, row_number() OVER (PARTITION BY place_id ORDER BY {draw_sql('image_id', 5)}, image_id) AS pick
    FROM places QUALIFY pick <= 4""")
def _per_place(t):
    return sampling.images_per_place(t.places(), 4, "random", 5)


@query("images_per_place_latest", "place_id:l image_id:l pick:l", """
    SELECT place_id, image_id, row_number() OVER (PARTITION BY place_id ORDER BY year DESC, month DESC, lat DESC, image_id) AS pick
    FROM places QUALIFY pick <= 4""")
def _per_place_latest(t):
    return sampling.images_per_place(t.places(), 4, "latest")


@query("shuffle_places", "city_id:s image_id:l ord:l", f"""
    SELECT city_id, image_id, row_number() OVER (PARTITION BY city_id ORDER BY {draw_sql('image_id', 11)}, image_id) - 1 AS ord FROM places""")
def _shuffle(t):
    return sampling.shuffle(t.places(), 11)


@query("dataset_stats", "data:s value:l", """
    WITH s AS (SELECT count(DISTINCT city_id) AS c, count(DISTINCT place_id) AS p, count(*) AS i FROM places)
    SELECT 'cities' AS data, c AS value FROM s UNION ALL SELECT 'places', p FROM s UNION ALL SELECT 'images', i FROM s
    UNION ALL SELECT 'iterations', p // 10 FROM s""")
def _stats(t):
    return sampling.dataset_stats(t.places(), 10)


# -- streaming -------------------------------------------------------------
@query("retrieve_stream", "q_image:l rank:l r_image:l score:d", "SELECT q_image, rank, r_image, score FROM predictions")
def _stream(t):
    """All queries through a file stream; equal to the batch vote with the same bounds."""
    q, r = sides(t)
    bounds = retrieve.calibrate(matches(t))
    source = scratch_path(t.spark, "stream-in")
    q.select("q_image", "q_seg", "vec").repartition(2, "q_image").write.parquet(source)
    out = scratch_path(t.spark, "stream-out")
    stream = retrieve.read_query_segments(t.spark, source, files_per_batch=1)
    run = retrieve.retrieve_stream(stream, r, bounds, out, scratch_path(t.spark, "stream-state"), k=20, top=20)
    run.awaitTermination()
    return t.spark.read.parquet(out)
