"""Margins, mining and projection queries."""

from pyspark.sql import functions as F

from ..functions.storage import cut_lineage
from ..functions.vectors import long_form
from ..operators import aggregate, margins, metrics, mining, reduce, search, spatial, vote, wide_pca
from .descriptors import UNIT_SUMS, vlad_sql, vocab
from .evaluation import IMAGE_MEANS, image_sides, poses, query_images
from .registry import query
from .retrieval import matches

# Triplets from the nearest-neighbour vote, judged within 20 units.
VOTES = """SELECT q_image, r_image, row_number() OVER (PARTITION BY q_image ORDER BY n DESC, r_image) AS rank FROM (
    SELECT q_image, r_image, count(*) AS n FROM matches WHERE rank = 1 GROUP BY ALL) v QUALIFY rank <= 5"""
TRIPLETS = f"""SELECT q_image, arg_min(r_image, rank) FILTER (WHERE good) AS positive, arg_min(r_image, rank) FILTER (WHERE NOT good) AS negative
    FROM (SELECT v.*, g.r_image IS NOT NULL AS good FROM ({VOTES}) v LEFT JOIN gt_wide g ON g.q_image = v.q_image AND g.r_image = v.r_image) j
    GROUP BY q_image HAVING count_if(good) > 0 AND count_if(NOT good) > 0"""


def wide_gt(t):
    return spatial.radius_join(*poses(t), 20.0)


def triplets(t, found=None):
    found = matches(t) if found is None else found
    return metrics.build_triplets(vote.max_seg(found), wide_gt(t), query_images(t))


@query("segment_margins", "q_image:l margin_mean:d margin_sum:d margin_count:l", f"""
    WITH tri AS ({TRIPLETS}), s AS (
      SELECT m.q_image, m.r_image = tri.positive AS pos, list_dot_product(q.e, r.e) AS s
      FROM matches m JOIN tri ON tri.q_image = m.q_image AND m.r_image IN (tri.positive, tri.negative)
      JOIN patches q ON q.image_id = m.q_image AND q.patch_id = m.q_seg JOIN patches r ON r.vec_id = m.r_seg WHERE m.rank = 1)
    SELECT q_image, avg(s) FILTER (WHERE pos) - avg(s) FILTER (WHERE NOT pos) AS margin_mean,
           sum(s) FILTER (WHERE pos) - sum(s) FILTER (WHERE NOT pos) AS margin_sum, count_if(pos) - count_if(NOT pos) AS margin_count
    FROM s GROUP BY ALL""")
def _segment_margins(t):
    p = t.patches()
    q = p.select(F.col("image_id").alias("q_image"), F.col("patch_id").alias("q_seg"), F.col("embedding").alias("vec"))
    r = p.select(F.col("vec_id").alias("r_seg"), F.col("embedding").alias("vec"))
    found = cut_lineage(matches(t))
    return margins.segment_margins(triplets(t, found), vote.match_info(found), q, r)


@query("image_margins", "q_image:l margin:d", f"""
    WITH tri AS ({TRIPLETS}), means AS ({IMAGE_MEANS})
    SELECT tri.q_image, list_dot_product(p.m, q.m) - list_dot_product(n.m, q.m) AS margin FROM tri
    JOIN means q ON q.image_id = tri.q_image JOIN means p ON p.image_id = tri.positive JOIN means n ON n.image_id = tri.negative""")
def _image_margins(t):
    return margins.image_margins(triplets(t), *image_sides(t))


VLAD = f"""SELECT image_id, cluster, list(value ORDER BY dim) AS r FROM ({vlad_sql(UNIT_SUMS, 'image_id')}) h GROUP BY ALL"""
# Clusters of the vocabulary; one that an image does not use is a zero vector.
K = 10
ZEROS = "[CAST(0 AS DOUBLE) FOR x IN (SELECT min(r) FROM {table})]"
TRIPLET_ROWS = f"""SELECT tri.q_image, k.cluster, coalesce(q.r, {ZEROS}) AS q, coalesce(p.r, {ZEROS}) AS p, coalesce(n.r, {ZEROS}) AS n
    FROM tri CROSS JOIN (SELECT unnest(range({K})) AS cluster) k
    LEFT JOIN {{table}} q ON q.image_id = tri.q_image AND q.cluster = k.cluster
    LEFT JOIN {{table}} p ON p.image_id = tri.positive AND p.cluster = k.cluster
    LEFT JOIN {{table}} n ON n.image_id = tri.negative AND n.cluster = k.cluster"""
CLUSTERS = f"""tri AS ({TRIPLETS}), vl AS ({VLAD}), cl AS (
    {TRIPLET_ROWS.format(table="vl")})"""
MARGINS = """SELECT *, row_number() OVER (PARTITION BY q_image ORDER BY round(margin, 9), cluster) AS margin_rank FROM (
    SELECT q_image, cluster, list_distance(q, p) AS dist_pos, list_distance(q, n) AS dist_neg,
           list_distance(q, n) - list_distance(q, p) AS margin FROM cl) x"""


def clusters(t, vlad=None, chosen=None):
    """Each vector table serves three roles, so it is stored once."""
    vlad = cut_lineage(aggregate.image_vlad_hard(t.patches(), vocab(t)) if vlad is None else vlad)
    return cut_lineage(margins.triplet_clusters(triplets(t) if chosen is None else chosen, vlad, vlad, K))


@query("cluster_margins", "q_image:l cluster:l dist_pos:d dist_neg:d margin:d margin_rank:l", f"WITH {CLUSTERS} {MARGINS}")
def _cluster_margins(t):
    return margins.cluster_margins(clusters(t))


# The second method ranks clusters by the un-normalised mean patch per label.
OTHER = f"""ol AS (SELECT image_id, label AS cluster, list(m ORDER BY d) AS r FROM (
    SELECT image_id, label, d, avg(v) AS m FROM patch_long GROUP BY ALL) y GROUP BY ALL), ocl AS (
    {TRIPLET_ROWS.format(table="ol")})"""


@query("cluster_rank_shift", "q_image:l cluster:l shift:l most_shifted:l", f"""
    WITH {CLUSTERS}, {OTHER}, a AS ({MARGINS}), b AS ({MARGINS.replace('FROM cl)', 'FROM ocl)')}),
    s AS (SELECT a.q_image, a.cluster, b.margin_rank - a.margin_rank AS shift, b.margin_rank AS br FROM a JOIN b USING (q_image, cluster))
    SELECT s.q_image, s.cluster, s.shift, m.cluster AS most_shifted FROM s JOIN (
      SELECT q_image, cluster FROM s QUALIFY row_number() OVER (PARTITION BY q_image ORDER BY shift DESC, br) = 1) m USING (q_image)""")
def _rank_shift(t):
    from ..functions.vectors import mean_vectors
    means = t.patches().groupBy("image_id", F.col("label").alias("cluster")).agg(mean_vectors(F.col("embedding")).alias("residual"))
    chosen = cut_lineage(triplets(t))
    return margins.cluster_rank_shift(
        margins.cluster_margins(clusters(t, chosen=chosen)), margins.cluster_margins(clusters(t, means, chosen))
    )


@query("cluster_distance_histogram", "q_image:l side:s bin:l n:l", f"""
    WITH {CLUSTERS}, m AS ({MARGINS}), l AS (SELECT q_image, 'positive' AS side, dist_pos AS d FROM m
      UNION ALL SELECT q_image, 'negative', dist_neg FROM m),
    b AS (SELECT *, min(d) OVER w AS lo, max(d) OVER w AS hi FROM l WINDOW w AS (PARTITION BY q_image, side))
    SELECT q_image, side, least(coalesce(CAST(floor((d - lo) * 30 / nullif(hi - lo, 0)) AS BIGINT), 15), 29) AS bin, count(*) AS n
    FROM b GROUP BY ALL""")
def _histogram(t):
    return margins.cluster_distance_histogram(margins.cluster_margins(clusters(t)))


ROLES = "ro AS (SELECT q_image, cluster, 'q' AS role, q AS v FROM cl UNION ALL SELECT q_image, cluster, 'p', p FROM cl UNION ALL SELECT q_image, cluster, 'n', n FROM cl)"
PAIRWISE = "q_image:l role_a:s cluster_a:l role_b:s cluster_b:l value:d"


@query("cluster_pairwise_distance", PAIRWISE, f"""
    WITH {CLUSTERS}, {ROLES} SELECT a.q_image, a.role AS role_a, a.cluster AS cluster_a, b.role AS role_b, b.cluster AS cluster_b,
      list_distance(a.v, b.v) AS value FROM ro a JOIN ro b USING (q_image)""")
def _pairwise(t):
    return margins.cluster_pairwise(clusters(t))


@query("cluster_pairwise_cosine", PAIRWISE, f"""
    WITH {CLUSTERS}, {ROLES} SELECT a.q_image, a.role AS role_a, a.cluster AS cluster_a, b.role AS role_b, b.cluster AS cluster_b,
      CASE WHEN list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v) = 0 THEN 0 ELSE list_cosine_similarity(a.v, b.v) END AS value FROM ro a JOIN ro b USING (q_image) WHERE a.role = 'q' AND b.role <> 'q'""")
def _pairwise_cosine(t):
    return margins.cluster_pairwise(clusters(t), "cosine")


@query("cluster_groups", "q_image:l cluster:l role:s group:l")
def _groups(t):
    return margins.cluster_groups(clusters(t))


@query("cluster_embedding_2d", "q_image:l cluster:l role:s x:d y:d")
def _embedding(t):
    return margins.cluster_embedding_2d(clusters(t))


# -- mining ----------------------------------------------------------------
def samples(t):
    return t.patches().select(F.expr("vec_id div 100").alias("batch"), F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))


SIMS = """sims AS (SELECT a.vec_id // 100 AS batch, a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same,
    list_cosine_similarity(a.e, b.e) AS sim FROM patches a JOIN patches b ON a.vec_id // 100 = b.vec_id // 100 AND a.vec_id <> b.vec_id)"""
MINED = "batch:l anchor:l other:l same:b sim:d"


@query("mine_pairs", MINED, f"WITH {SIMS} SELECT * FROM sims WHERE CASE WHEN same THEN sim < 0.1 ELSE sim > 0.25 END")
def _mine_pairs(t):
    return mining.mine_pairs(samples(t), 0.1, 0.25)


@query("mine_pairs_sparse", MINED, f"""WITH {SIMS} SELECT batch, anchor * 1000003 AS anchor, other * 1000003 AS other, same, sim
    FROM sims WHERE CASE WHEN same THEN sim < 0.1 ELSE sim > 0.25 END""")
def _mine_pairs_sparse(t):
    """Ids far apart, which are numbered before rows are packed."""
    return mining.mine_pairs(samples(t).withColumn("id", F.col("id") * 1000003), 0.1, 0.25)


@query("mine_multi_similarity", MINED, f"""
    WITH {SIMS}, b AS (SELECT anchor, min(sim) FILTER (WHERE same) AS pmin, max(sim) FILTER (WHERE NOT same) AS nmax FROM sims GROUP BY ALL)
    SELECT s.* FROM sims s JOIN b USING (anchor) WHERE CASE WHEN same THEN sim < nmax + 0.1 ELSE sim > pmin - 0.1 END""")
def _mine_ms(t):
    return mining.mine_multi_similarity(samples(t), 0.1)


TRIPLET_SQL = f"""WITH {SIMS}, d AS (SELECT *, sqrt(greatest(2 - 2 * sim, 0)) AS d FROM sims)
    SELECT p.batch, p.anchor, p.other AS positive, n.other AS negative, n.d - p.d AS gap FROM d p JOIN d n USING (anchor)
    WHERE p.same AND NOT n.same AND n.d - p.d > 0 AND n.d - p.d <= 0.02"""


@query("mine_triplets", "batch:l anchor:l positive:l negative:l gap:d", TRIPLET_SQL)
def _mine_triplets(t):
    return mining.mine_triplets(samples(t), 0.02)


@query("mining_accuracy", "accuracy:d", f"SELECT 1 - count(DISTINCT anchor) * 1.0 / (SELECT count(*) FROM patches) AS accuracy FROM ({TRIPLET_SQL}) m WHERE gap < 0.0001")
def _accuracy(t):
    return margins.mining_accuracy(mining.mine_triplets(samples(t), 0.02).where("gap < 0.0001"), t.patch_list())


# -- projection ------------------------------------------------------------
def axis_model(t):
    """Fixed model: 64 oblique axes of all 64 dimensions, around the mean of the data."""
    import numpy as np
    mean = np.array(reduce.column_moments(t.patches(), "embedding").first()["mean"])
    i, j = np.arange(64)[:, None], np.arange(64)[None, :]
    return reduce.Model(mean, ((7 * i + 13 * j + 3 * i * j) % 17 - 8) / 10 + 3 * (i == j), 1 + np.arange(64) / 64)


Z = """SELECT p.vec_id, a.i AS dim, sum((p.v - m.mu) * (((7 * a.i + 13 * (p.d - 1) + 3 * a.i * (p.d - 1)) % 17 - 8) / 10.0
      + CASE WHEN a.i = p.d - 1 THEN 3 ELSE 0 END)) / sqrt(1 + a.i / 64.0) AS z
    FROM patch_long p JOIN (SELECT d, avg(v) AS mu FROM patch_long GROUP BY d) m USING (d), (SELECT unnest(range(64)) AS i) a
    GROUP BY p.vec_id, a.i"""


@query("apply_pca", "vec_id:l dim:l value:d", f"SELECT vec_id, dim, z AS value FROM ({Z}) z")
def _apply(t):
    model = reduce.load_model(reduce.model_table(t.spark, axis_model(t)))
    return long_form(reduce.apply_pca(t.patches().select("vec_id", "embedding"), model, "embedding").drop("embedding"), "reduced")


@query("apply_pca_blocks", "vec_id:l dim:l value:d", f"SELECT vec_id, dim, z AS value FROM ({Z}) z")
def _apply_blocks(t):
    """The route of models too large to fetch: slices of vectors with tiles of 24 axes by 24 dimensions."""
    table = reduce.model_table(t.spark, axis_model(t))
    found = wide_pca.project_blocks(t.patches().select("vec_id", "embedding"), table, ["vec_id"], "embedding", "reduced", side=24)
    return long_form(found.select("vec_id", "reduced"), "reduced")


@query("project_patches", "vec_id:l dim:l value:d", f"""
    SELECT vec_id, dim, z / sqrt(sum(z * z) OVER (PARTITION BY vec_id)) AS value FROM ({Z}) z""")
def _project(t):
    return long_form(reduce.project_patches(t.patches().select("vec_id", "embedding"), axis_model(t)), "embedding")


def products(z, keys):
    """Inner products and covariances of the columns of long-form (keys, dim, value)."""
    a, b = z.select(*keys, F.col("dim").alias("i"), F.col("value").alias("a")), z.select(*keys, F.col("dim").alias("j"), F.col("value").alias("b"))
    return a.join(b, keys).groupBy("i", "j").agg(F.covar_samp("a", "b").alias("covariance"), F.sum(F.col("a") * F.col("b")).alias("product"))


@query("fit_pca", "i:l j:l product:d residual:d", """
    SELECT a.i, b.j, CASE WHEN a.i = b.j THEN 1.0 ELSE 0.0 END AS product, 0.0 AS residual
    FROM (SELECT unnest(range(16)) AS i) a, (SELECT unnest(range(16)) AS j) b""")
def _fit_pca(t):
    """Axes are orthonormal, and the data along them has the stored variances and no covariance."""
    p = cut_lineage(t.patches().select("vec_id", "embedding"))
    table = cut_lineage(reduce.model_table(t.spark, reduce.fit_pca(p, 16, vec="embedding")))
    axes = table.where("component >= 0").select(F.lit(0).alias("k"), "component", "variance", "axis")
    straight = products(long_form(axes.select("component", "axis"), "axis").select(F.col("dim").alias("at"), F.col("component").alias("dim"), "value"), ["at"])
    turned = table.withColumn("variance", F.lit(1.0))
    along = products(long_form(wide_pca.apply_table(p, turned, ["vec_id"], "embedding").select("vec_id", "reduced"), "reduced"), ["vec_id"])
    own = axes.select(F.col("component").alias("i"), F.col("component").alias("j"), "variance")
    both = straight.select("i", "j", "product").join(along.select("i", "j", "covariance"), ["i", "j"]).join(F.broadcast(own), ["i", "j"], "left")  # 16 rows
    return both.withColumn("residual", F.col("covariance") - F.coalesce("variance", F.lit(0.0)))


def wide_rows(t):
    """Eight descriptors side by side: 512 dimensions, an eighth of the rows; missing ones are zero."""
    one = F.struct((F.col("vec_id") % 8).alias("k"), "embedding")
    held = t.patches().groupBy(F.expr("vec_id div 8").alias("row_id")).agg(F.map_from_entries(F.collect_list(one)).alias("m"))
    part = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint")), lambda k: F.coalesce(F.element_at("m", k), F.array_repeat(F.lit(0.0), 64)))
    return held.select("row_id", F.flatten(part).alias("vec"))


@query("pca_wide_rows", "a:l b:l product:d", """
    WITH long AS (SELECT vec_id // 8 AS r, (vec_id % 8) * 64 + d AS k, v FROM patch_long),
      n AS (SELECT count(DISTINCT r) AS n FROM long), mu AS (SELECT k, sum(v) / any_value(n) AS mu FROM long, n GROUP BY k),
      full_rows AS (SELECT r, k, coalesce(v, 0) - mu AS c FROM (SELECT DISTINCT r FROM long) CROSS JOIN mu LEFT JOIN long USING (r, k))
    SELECT x.r AS a, y.r AS b, sum(x.c * y.c) AS product FROM full_rows x JOIN full_rows y ON x.k = y.k AND x.r <= y.r GROUP BY ALL""")
def _wide_rows(t):
    """With fewer rows than dimensions: all axes that exist keep every inner product of the centred rows."""
    rows = cut_lineage(wide_rows(t))
    axes = min(rows.count() - 1, 512)
    model = cut_lineage(reduce.fit_pca_table(rows, axes, whiten=False))
    z = wide_pca.apply_table(rows, model, ["row_id"]).where(F.size("reduced") > 0)
    return wide_pca.inner_products(cut_lineage(z.select("row_id", "reduced")), "row_id", "reduced", axes)


@query("pca_total_variance", "components:l total:d", """
    SELECT count(*) AS components, sum(var) AS total FROM (SELECT var_samp(v) AS var FROM patch_long GROUP BY d) x""")
def _pca_total(t):
    """All components together carry exactly the variance of the data."""
    model = reduce.model_table(t.spark, reduce.fit_pca(t.patches(), 64, vec="embedding")).where("component >= 0")
    return model.agg(F.count(F.lit(1)).alias("components"), F.sum("variance").alias("total"))


@query("pca_whitened_moments", "i:l j:l covariance:d", """
    SELECT a.d - 1 AS i, b.d - 1 AS j, CASE WHEN a.d = b.d THEN 1.0 ELSE 0.0 END AS covariance
    FROM (SELECT DISTINCT d FROM patch_long WHERE d <= 12) a, (SELECT DISTINCT d FROM patch_long WHERE d <= 12) b""")
def _pca_moments(t):
    """Projected data is uncorrelated with unit variance."""
    p = cut_lineage(t.patches().select("vec_id", "embedding"))
    z = long_form(reduce.apply_pca(p, reduce.fit_pca(p, 12, vec="embedding"), "embedding").drop("embedding"), "reduced")
    a, b = z.select("vec_id", F.col("dim").alias("i"), F.col("value").alias("a")), z.select("vec_id", F.col("dim").alias("j"), F.col("value").alias("b"))
    return a.join(b, "vec_id").groupBy("i", "j").agg(F.covar_samp("a", "b").alias("covariance"))


@query("whiten_pca", "vec_id:l dim:l value:d")
def _whiten(t):
    v = t.patches().select("vec_id", "embedding")
    models = reduce.whiten_pca(v, [4, 8], vec="embedding")
    return long_form(reduce.apply_whitening(v, models[8], "embedding").drop("embedding"), "white")


@query("reduce_pca_mixed", "vec_id:l dim:l value:d")
def _mixed(t):
    p = t.patches().select("vec_id", "role", "embedding")
    _, test = reduce.reduce_pca_mixed(p.where("role = 'ref'"), p.where("role = 'query'"), 8, 0.25, 32, "embedding")
    return long_form(test.select("vec_id", "reduced"), "reduced")


# -- whole retrieval -------------------------------------------------------
@query("segment_retrieval", "q_image:l rank:l r_image:l score:d")
def _segment_retrieval(t):
    """Expanded segment VLAD, PCA, search and vote: the default experiment end to end."""
    from ..operators import graph
    v = vocab(t)
    wide = graph.super_segment_patches(graph.expand_hops(graph.delaunay_edges(t.segments()), 3), t.segment_patches())
    dense = aggregate.densify(aggregate.segment_vlad(t.patches(), wide, v), ["image_id", "seg_id"], v)
    dense = cut_lineage(dense)
    roles = t.images()
    model = reduce.fit_pca(dense.join(roles.where("role = 'ref'"), "image_id", "left_semi"), 32)
    low = cut_lineage(reduce.apply_pca(dense, model, normalize=True).select("image_id", "seg_id", F.col("reduced").alias("vec")))
    low = low.join(roles, "image_id")
    q = low.where("role = 'query'").select(F.col("image_id").alias("q_image"), F.col("seg_id").alias("q_seg"), "vec")
    r = low.where("role = 'ref'").select(F.col("image_id").alias("r_image"), F.col("seg_id").alias("r_seg"), "vec")
    found = search.knn_l2(q, r, 50, q_ids=["q_image", "q_seg"], r_ids=["r_image", "r_seg"])
    return vote.get_matches(search.segment_matches(found, 50))


@query("global_retrieval", "q_image:l rank:l r_image:l dist:d", f"""
    WITH h AS ({vlad_sql(UNIT_SUMS, 'image_id')}), pairs AS (
      SELECT q.image_id AS q_image, r.image_id AS r_image, sum(coalesce(a.value, 0) * coalesce(b.value, 0)) AS ip
      FROM (SELECT DISTINCT image_id FROM patches WHERE role = 'query') q CROSS JOIN (SELECT DISTINCT image_id FROM patches WHERE role = 'ref') r
      JOIN h a ON a.image_id = q.image_id LEFT JOIN h b ON b.image_id = r.image_id AND b.cluster = a.cluster AND b.dim = a.dim GROUP BY ALL)
    SELECT q_image, r_image, sqrt(2 - 2 * ip) AS dist, row_number() OVER (PARTITION BY q_image ORDER BY 2 - 2 * ip, r_image) AS rank
    FROM pairs QUALIFY rank <= 5""")
def _global(t):
    """Whole-image VLAD and Euclidean search."""
    v = vocab(t)
    dense = aggregate.densify(aggregate.image_vlad_hard(t.patches(), v), ["image_id"], v)
    dense = dense.join(t.images(), "image_id")
    q = dense.where("role = 'query'").withColumnRenamed("image_id", "q_image")
    r = dense.where("role = 'ref'").withColumnRenamed("image_id", "r_image")
    return search.knn_image(q, r, 5, q_ids=["q_image"], r_ids=["r_image"])


