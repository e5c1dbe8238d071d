"""Paths, ground truth and evaluation queries."""

from pyspark.sql import functions as F

from ..functions.storage import scratch_path
from ..functions.vectors import dot, mean_vectors
from ..operators import ground_truth as gtr
from ..operators import metrics, spatial
from ..sources import paths, results
from .registry import query
from .retrieval import predictions

NATURAL = r"""array_to_string(list_transform(regexp_extract_all({0}, '(\d+|\D+)'),
    lambda x: CASE WHEN regexp_full_match(x, '\d+') THEN lpad(x, CAST(greatest(20, length(x)) AS INTEGER), '0') ELSE x END), '')"""


def poses(t):
    p = t.poses()
    return p.where("role = 'query'"), p.where("role = 'ref'")


def gt(t):
    return spatial.radius_join(*poses(t), 5.0)


def query_images(t):
    return t.images().where("role = 'query'").select(F.col("image_id").alias("q_image"))


def ref_images(t):
    return t.images().where("role = 'ref'").select(F.col("image_id").alias("r_image"))


def indexed(t):
    """Both roles numbered in natural path order."""
    q = paths.image_index(t.manifest().where("role = 'query'"), "path").withColumnRenamed("image_pos", "pos")
    r = paths.image_index(t.manifest().where("role = 'ref'"), "path").withColumnRenamed("image_pos", "pos")
    return q, r


INDEXED_SQL = f"""
    SELECT image_id, role, city, path, row_number() OVER (PARTITION BY role ORDER BY {NATURAL.format('path')}, path) - 1 AS pos
    FROM manifest"""


@query("image_index", "image_id:l path:s image_pos:l", f"""
    SELECT image_id, path, (pos - 2) // 3 AS image_pos FROM (
      SELECT *, row_number() OVER (ORDER BY {NATURAL.format('path')}, path) - 1 AS pos FROM manifest) x
    WHERE pos >= 2 AND (pos - 2) % 3 = 0""")
def _image_index(t):
    return paths.image_index(t.manifest(), "path", start=2, step=3)


@query("parse_path_coords", "image_id:l x:d y:d", """
    SELECT image_id, TRY_CAST(split_part(path, '@', 2) AS DOUBLE) AS x, TRY_CAST(split_part(path, '@', 3) AS DOUBLE) AS y
    FROM paths""")
def _coords(t):
    return paths.with_path_coords(t.paths())


@query("path_parts", "image_id:l tail:s base:s stem:s", """
    SELECT image_id, array_to_string(list_slice(str_split(path, '/'), -2, -1), '/') AS tail,
           list_extract(str_split(path, '/'), -1) AS base,
           regexp_replace(list_extract(str_split(path, '/'), -1), '\\.[^.]*$', '') AS stem
    FROM manifest""")
def _path_parts(t):
    p = F.col("path")
    return t.manifest().select(
        "image_id", paths.path_tail(p, 2).alias("tail"), paths.basename(p).alias("base"), paths.stem(p).alias("stem"))


@query("radius_join", "q_image:l r_image:l dist:d", "SELECT * FROM gt")
def _radius(t):
    return gt(t)


ANGLE = "(abs(q.a - r.a) + abs(q.b - r.b) + abs(q.c - r.c)) / 3"
SQ3 = "(q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y) + (q.z - r.z) * (q.z - r.z)"


@query("radius_angle_join", "q_image:l r_image:l dist:d angle:d", f"""
    SELECT q.image_id AS q_image, r.image_id AS r_image, sqrt({SQ3}) AS dist, {ANGLE} AS angle
    FROM poses q, poses r WHERE q.role = 'query' AND r.role = 'ref' AND {SQ3} <= 100 AND {ANGLE} < 5""")
def _radius_angle(t):
    return spatial.radius_angle_join(*poses(t), 10.0, 5.0)


@query("radius_self_join", "q_image:l r_image:l dist:d", f"""
    SELECT q.image_id AS q_image, r.image_id AS r_image, sqrt({SQ3}) AS dist
    FROM poses q, poses r WHERE q.role = 'ref' AND r.role = 'ref' AND {SQ3} <= 100""")
def _radius_self(t):
    return spatial.radius_self_join(poses(t)[1], 10.0)


@query("radius_self_join_angle", "q_image:l r_image:l dist:d angle:d", f"""
    SELECT q.image_id AS q_image, r.image_id AS r_image, sqrt({SQ3}) AS dist, {ANGLE} AS angle
    FROM poses q, poses r WHERE q.role = 'ref' AND r.role = 'ref' AND {SQ3} <= 100 AND {ANGLE} < 5""")
def _radius_self_angle(t):
    return spatial.radius_self_join(poses(t)[1], 10.0, 5.0)


@query("index_band_join", "q_image:l r_image:l", f"""
    WITH i AS ({INDEXED_SQL})
    SELECT q.image_id AS q_image, r.image_id AS r_image FROM i q, i r
    WHERE q.role = 'query' AND r.role = 'ref' AND abs(q.pos - r.pos) <= 15""")
def _band(t):
    return gtr.index_band_join(*indexed(t), 15)


@query("identity_join", "q_image:l r_image:l", f"""
    WITH i AS ({INDEXED_SQL})
    SELECT q.image_id AS q_image, r.image_id AS r_image FROM i q, i r
    WHERE q.role = 'query' AND r.role = 'ref' AND q.pos = r.pos""")
def _identity(t):
    return gtr.identity_join(*indexed(t))


NEAR_SQL = """
    SELECT q.image_id AS q_image, r.image_id AS r_image, row_number() OVER (PARTITION BY q.image_id
      ORDER BY (q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y), r.image_id) AS n
    FROM poses q, poses r WHERE q.role = 'query' AND r.role = 'ref'
      AND (q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y) <= 400 QUALIFY n <= 5"""


def near(t):
    """Up to five nearest references within 20 of each query, ranked."""
    return spatial.nearest_within(*poses(t), 20.0, 5, "n")


@query("listed_ground_truth", "q_image:l r_image:l", f"""
    WITH i AS ({INDEXED_SQL}), near AS ({NEAR_SQL})
    SELECT near.q_image, ix.image_id AS r_image FROM near JOIN i ix ON ix.role = 'ref' AND ix.pos = near.r_image""")
def _listed(t):
    # The listed ids are read as positions, some of which name no image.
    lists = near(t).groupBy("q_image").agg(F.collect_list("r_image").alias("ref_positions"))
    return gtr.listed_ground_truth(lists, indexed(t)[1])


def _dispatch(name, sql):
    @query(f"ground_truth_{name}", "q_image:l r_image:l", sql)
    def run(t):
        if name in ("pitts", "InsideOut", "SFXL"):
            p = t.paths()
            return gtr.ground_truth(name, p.where("role = 'query'"), p.where("role = 'ref'"))
        if name == "baidu":
            return gtr.ground_truth(name, *poses(t))
        lists = near(t).groupBy("q_image").agg(F.collect_list("r_image").alias("ref_positions")) if name == "VPAir" else None
        return gtr.ground_truth(name, *indexed(t), lists)


def _within(radius):
    return f"""WITH spots AS (SELECT image_id, role, CAST(split_part(path, '@', 2) AS DOUBLE) AS x,
        CAST(split_part(path, '@', 3) AS DOUBLE) AS y FROM paths)
        SELECT q.image_id AS q_image, r.image_id AS r_image FROM spots q, spots r WHERE q.role = 'query' AND r.role = 'ref'
        AND (q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y) <= {radius * radius}"""


_dispatch("pitts", _within(25))
_dispatch("SFXL", _within(25))
_dispatch("InsideOut", _within(50))
_dispatch("baidu", f"""SELECT q.image_id AS q_image, r.image_id AS r_image FROM poses q, poses r
    WHERE q.role = 'query' AND r.role = 'ref' AND {SQ3} <= 100 AND {ANGLE} < 20""")
_dispatch("17places", f"""WITH i AS ({INDEXED_SQL}) SELECT q.image_id AS q_image, r.image_id AS r_image FROM i q, i r
    WHERE q.role = 'query' AND r.role = 'ref' AND r.pos BETWEEN q.pos - 15 AND q.pos + 15""")
_dispatch("AmsterTime", f"""WITH i AS ({INDEXED_SQL}) SELECT q.image_id AS q_image, r.image_id AS r_image FROM i q, i r
    WHERE q.role = 'query' AND r.role = 'ref' AND r.pos = q.pos""")
_dispatch("VPAir", f"""WITH i AS ({INDEXED_SQL}), near AS ({NEAR_SQL}) SELECT near.q_image, ix.image_id AS r_image
    FROM near JOIN i ix ON ix.role = 'ref' AND ix.pos = near.r_image""")


@query("remap_ground_truth", "city:s q_pos:l r_pos:l", f"""
    WITH near AS ({NEAR_SQL}), pos AS (
      SELECT image_id, role, city, row_number() OVER (PARTITION BY role, city ORDER BY {NATURAL.format('path')}, image_id) - 1 AS pos
      FROM manifest)
    SELECT q.city, q.pos AS q_pos, r.pos AS r_pos FROM near
    JOIN pos q ON q.role = 'query' AND q.image_id = near.q_image
    JOIN pos r ON r.role = 'ref' AND r.image_id = near.r_image WHERE q.city = r.city""")
def _remap(t):
    m = t.manifest()
    return gtr.remap_ground_truth(near(t).select("q_image", "r_image"), m.where("role = 'query'"), m.where("role = 'ref'"))


@query("subset_by_index", "image_id:l pos:l", f"""
    WITH i AS ({INDEXED_SQL}) SELECT image_id, pos FROM i
    WHERE role = 'ref' AND pos IN (SELECT label * 3 FROM embeddings)""")
def _subset(t):
    positions = t.table("embeddings").select((F.col("label") * 3).cast("long").alias("pos"))
    return gtr.subset_by_index(indexed(t)[1], positions)


@query("union_roles", "image_id:l role:s pos:l", f"""
    SELECT image_id, role, row_number() OVER (ORDER BY CASE role WHEN 'ref' THEN 0 ELSE 1 END, {NATURAL.format('path')}, path) - 1 AS pos
    FROM manifest""")
def _union_roles(t):
    from ..sources.tables import union_roles
    m = t.manifest()
    return union_roles(m.where("role = 'ref'"), m.where("role = 'query'"), [paths.natural_key("path"), F.col("path")])


# -- metrics ---------------------------------------------------------------
HITS = """SELECT p.q_image, min(p.rank) AS first_hit FROM predictions p JOIN gt USING (q_image, r_image) GROUP BY ALL"""


def _recall_sql(judged, ks, scale):
    per_k = ", ".join(f"({k})" for k in ks)
    return f"""WITH hits AS ({HITS}), judged AS ({judged})
      SELECT k, count(CASE WHEN first_hit <= k THEN 1 END) AS hits, count(*) AS evaluated,
             count(CASE WHEN first_hit <= k THEN 1 END) * {scale} / nullif(count(*), 0) AS recall
      FROM judged LEFT JOIN hits USING (q_image), (VALUES {per_k}) ks(k) GROUP BY k"""


WITH_GT = "SELECT q_image FROM query_images WHERE q_image IN (SELECT q_image FROM gt)"
RECALL = "k:l hits:l evaluated:l recall:d"


@query("recall_at_k", RECALL, _recall_sql(WITH_GT, range(1, 6), "1.0"))
def _recall(t):
    return metrics.recall_at_k(predictions(t), gt(t), query_images(t), 5)


@query("recall_at_k_all", RECALL, _recall_sql("SELECT q_image FROM query_images", (1, 5, 10), "100.0"))
def _recall_all(t):
    return metrics.recall_at_k_all(predictions(t), gt(t), query_images(t))


@query("recall_one_percent", "hits:l evaluated:l recall:d", f"""
    WITH hits AS ({HITS}), judged AS ({WITH_GT}),
    lim AS (SELECT least(greatest(round_even(count(*) / 100.0, 0), 1), 5) AS n FROM ref_images)
    SELECT count(CASE WHEN first_hit <= n THEN 1 END) AS hits, count(*) AS evaluated,
           count(CASE WHEN first_hit <= n THEN 1 END) * 100.0 / nullif(count(*), 0) AS recall
    FROM judged LEFT JOIN hits USING (q_image), lim""")
def _one_percent(t):
    return metrics.recall_one_percent(predictions(t), gt(t), query_images(t), ref_images(t))


IMAGE_MEANS = """SELECT image_id, role, list(m ORDER BY d) AS m FROM (
    SELECT image_id, role, d, avg(v) AS m FROM patch_long GROUP BY ALL) x GROUP BY ALL"""


def image_vectors(t):
    return t.patches().groupBy("image_id", "role").agg(mean_vectors(F.col("embedding")).alias("vec"))


def image_sides(t):
    v = image_vectors(t)
    return (v.where("role = 'query'").select(F.col("image_id").alias("q_image"), "vec"),
            v.where("role = 'ref'").select(F.col("image_id").alias("r_image"), "vec"))


@query("top1_similarity", "q_image:l r_image:l sim:d", f"""
    WITH means AS ({IMAGE_MEANS})
    SELECT p.q_image, p.r_image, list_dot_product(q.m, r.m) AS sim FROM predictions p JOIN gt_wide USING (q_image, r_image)
    JOIN means q ON q.image_id = p.q_image JOIN means r ON r.image_id = p.r_image WHERE p.rank = 1""")
def _top1(t):
    return metrics.top1_similarity(predictions(t), spatial.radius_join(*poses(t), 20.0), *image_sides(t), dot)


@query("hit_flags", "q_image:l hit:l", f"""
    WITH hits AS ({HITS}) SELECT q_image, CASE WHEN first_hit IS NULL THEN 0 ELSE 1 END AS hit
    FROM query_images LEFT JOIN hits USING (q_image)""")
def _hit_flags(t):
    return metrics.hit_flags(predictions(t), gt(t), query_images(t))


REL = """SELECT p.q_image, p.rank, p.r_image, CASE WHEN g.r_image IS NULL THEN 0 ELSE 1 END AS relevant
    FROM predictions p LEFT JOIN gt g ON g.q_image = p.q_image AND g.r_image = p.r_image"""
AP = f"""SELECT q_image, coalesce(sum(relevant * seen / rank) / nullif(sum(relevant), 0), 0) AS ap_retrieved FROM (
    SELECT *, sum(relevant) OVER (PARTITION BY q_image ORDER BY rank) AS seen FROM ({REL}) r) s GROUP BY ALL"""


@query("relevance_lists", "q_image:l rank:l r_image:l relevant:l", REL)
def _relevance(t):
    return metrics.relevance_lists(predictions(t), gt(t))


@query("average_precision", "q_image:l ap_retrieved:d", AP)
def _ap(t):
    return metrics.average_precision(metrics.relevance_lists(predictions(t), gt(t)))


@query("mean_ap", "map:d", f"SELECT avg(ap_retrieved) AS map FROM ({AP}) ap")
def _map(t):
    return metrics.mean_ap(metrics.relevance_lists(predictions(t), gt(t)))


IMAGE_KNN = f"""SELECT q.image_id AS q_image, r.image_id AS r_image,
    row_number() OVER (PARTITION BY q.image_id ORDER BY list_distance(q.m, r.m), r.image_id) AS rank
    FROM ({IMAGE_MEANS}) q, ({IMAGE_MEANS}) r WHERE q.role = 'query' AND r.role = 'ref' QUALIFY rank <= 10"""


def image_predictions(t, k=10):
    from ..operators import search
    return search.knn_image(*image_sides(t), k, q_ids=["q_image"], r_ids=["r_image"])


COMPARED = ("baseline:s your_method:s query_index:l baseline_top1:l corrected_by_baseline:b "
            "corrected_by_your_method:b mine_top1:l your_method_r1:d baseline_r1:d ground_truth:s")
COMPARED_SQL = f"""
    WITH knn AS ({IMAGE_KNN}), votes AS (SELECT * FROM predictions),
    top AS (SELECT 'image_mean' AS method, q_image, r_image FROM knn WHERE rank = 1
            UNION ALL SELECT 'runner_up', q_image, r_image FROM knn WHERE rank = 2),
    b AS (SELECT t.*, g.r_image IS NOT NULL AS hit FROM top t LEFT JOIN gt g ON g.q_image = t.q_image AND g.r_image = t.r_image),
    m AS (SELECT v.q_image, v.r_image, g.r_image IS NOT NULL AS hit FROM votes v
          LEFT JOIN gt g ON g.q_image = v.q_image AND g.r_image = v.r_image WHERE v.rank = 1)
    SELECT b.method AS baseline, 'vote' AS your_method, b.q_image AS query_index, b.r_image AS baseline_top1,
           b.hit AS corrected_by_baseline, m.hit AS corrected_by_your_method, m.r_image AS mine_top1,
           (SELECT count_if(hit) FROM m) * 100.0 / (SELECT count(*) FROM query_images) AS your_method_r1,
           (SELECT count_if(hit) FROM b b2 WHERE b2.method = b.method) * 100.0 / (SELECT count(*) FROM query_images) AS baseline_r1,
           (SELECT '[' || string_agg(r_image, ',' ORDER BY r_image) || ']' FROM (SELECT DISTINCT q_image, r_image FROM gt) g
            WHERE g.q_image = b.q_image) AS ground_truth
    FROM b JOIN m USING (q_image) WHERE b.hit <> m.hit"""


@query("compare_methods", COMPARED, COMPARED_SQL)
def _compare(t):
    found = image_predictions(t)
    b = found.where("rank = 1").withColumn("method", F.lit("image_mean"))
    second = found.where("rank = 2").withColumn("method", F.lit("runner_up")).withColumn("rank", F.lit(1))
    return metrics.compare_methods(b.unionByName(second), predictions(t), gt(t), query_images(t), "vote")


@query("write_comparison", COMPARED, COMPARED_SQL)
def _write_comparison(t):
    path = scratch_path(t.spark, "comparison")
    compared = _compare(t)
    results.write_comparison(compared, path)
    return t.spark.read.schema(compared.schema).option("header", True).option("escape", '"').csv(path)


TRIPLETS = f"""SELECT q.q_image AS anchor, x.positive, x.negative FROM query_images q LEFT JOIN (
    SELECT q_image, arg_min(r_image, rank) FILTER (WHERE relevant = 1) AS positive,
           arg_min(r_image, rank) FILTER (WHERE relevant = 0) AS negative
    FROM ({REL}) r WHERE q_image IN (SELECT q_image FROM gt) GROUP BY ALL) x USING (q_image)"""


@query("build_triplets", "anchor:l positive:l negative:l", TRIPLETS)
def _triplets(t):
    return metrics.build_triplets(predictions(t), gt(t), query_images(t))


@query("evaluate", "dataset:s k:l hits:l evaluated:l recall:d", f"""
    WITH knn AS ({IMAGE_KNN}), wide AS (
      SELECT q.image_id AS q_image, r.image_id AS r_image FROM poses q, poses r WHERE q.role = 'query' AND r.role = 'ref'
        AND (q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y) <= 100),
    g AS (SELECT 'strict' AS dataset, q_image, r_image FROM gt UNION ALL SELECT 'loose', q_image, r_image FROM wide),
    hits AS (SELECT dataset, q_image, min(rank) AS first_hit FROM knn JOIN g USING (q_image, r_image) GROUP BY ALL)
    SELECT ds.dataset, k, count(CASE WHEN first_hit <= k THEN 1 END) AS hits, count(*) AS evaluated,
           count(CASE WHEN first_hit <= k THEN 1 END) * 100.0 / count(*) AS recall
    FROM (SELECT DISTINCT dataset FROM g) ds CROSS JOIN query_images qi
    LEFT JOIN hits h ON h.dataset = ds.dataset AND h.q_image = qi.q_image, (VALUES (1), (5), (10)) ks(k) GROUP BY ds.dataset, k""")
def _evaluate(t):
    v = image_vectors(t)
    return metrics.evaluate([("strict", v, gt(t)), ("loose", v, spatial.radius_join(*poses(t), 10.0))])


@query("retrieved_and_true", "q_image:l r_image:l", "SELECT q_image, r_image FROM predictions INTERSECT SELECT q_image, r_image FROM gt")
def _intersect(t):
    return metrics.retrieved_and_true(predictions(t), gt(t))
