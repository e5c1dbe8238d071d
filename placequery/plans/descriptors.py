"""Vocabulary, VLAD, burst, transport, pooling and graph queries."""

import numpy as np
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize, long_form
from ..operators import aggregate, burst, graph, pooling, transport, vocabulary
from .registry import query


def vocab(t):
    return vocabulary.load_vocabulary(t.vocabulary())


def vlad_sql(sums, owner):
    """Normalise long-form sums (owner, cluster, d, s) per cluster, then per owner."""
    return f"""SELECT {owner}, cluster, d - 1 AS dim, u / coalesce(nullif(sqrt(sum(u * u) OVER (PARTITION BY {owner})), 0), 1) AS value
      FROM (SELECT *, s / coalesce(nullif(sqrt(sum(s * s) OVER (PARTITION BY {owner}, cluster)), 0), 1) AS u FROM ({sums}) sums) units"""


def pooled_sql(value, source="patch_long", where="TRUE"):
    return f"SELECT image_id, d - 1 AS dim, {value} AS value FROM {source} src WHERE {where} GROUP BY image_id, d"


def unit_sql(inner, owner="image_id"):
    return f"""SELECT {owner}, dim, value / coalesce(nullif(sqrt(sum(value * value) OVER (PARTITION BY {owner})), 0), 1) AS value
      FROM ({inner}) raw"""


UNIT_LONG = "(SELECT *, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS u FROM patch_long)"
OWN = "image_id:l cluster:l dim:l value:d"
POOL = "image_id:l dim:l value:d"


@query("l2_normalize", "vec_id:l dim:l value:d", """
    SELECT vec_id, d - 1 AS dim, v / coalesce(nullif(sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 0), 1) AS value
    FROM (SELECT vec_id, d, CASE WHEN vec_id % 9 = 0 THEN 0 ELSE v END AS v FROM patch_long) x""")
def _normalize(t):
    zeroed = F.when(F.col("vec_id") % 9 == 0, F.transform("embedding", lambda x: F.lit(0.0))).otherwise(F.col("embedding"))
    return long_form(t.patches().select("vec_id", l2_normalize(zeroed).alias("vec")), "vec")


@query("assign_cluster", "vec_id:l cluster:l", "SELECT vec_id, cluster FROM assigned")
def _assign(t):
    return vocabulary.assign_cluster(t.patches(), vocab(t))


@query("assign_cluster_euclidean", "vec_id:l cluster:l", """
    SELECT vec_id, cluster FROM (SELECT p.vec_id, v.cluster, list_distance(p.e, v.centroid) AS dist FROM patches p, vocabulary v) x
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster) = 1""")
def _assign_euclidean(t):
    return vocabulary.assign_cluster(t.patches(), vocab(t), "euclidean")


RESIDUALS = """SELECT p.vec_id, l.cluster, l.d, p.v - l.c AS r FROM patch_long p JOIN vocabulary_long l USING (d)"""


@query("residual_vectors", "vec_id:l dim:l value:d", f"""
    SELECT vec_id, cluster * 64 + d - 1 AS dim, r AS value FROM ({RESIDUALS}) x""")
def _residuals(t):
    out = vocabulary.residual_vectors(t.patches().select("vec_id", "embedding"), vocab(t)).drop("embedding")
    return long_form(out, "residuals")


@query("residual_vectors_normalised", "vec_id:l dim:l value:d", f"""
    SELECT vec_id, cluster * 64 + d - 1 AS dim, u / sqrt(sum(u * u) OVER (PARTITION BY vec_id)) AS value FROM (
      SELECT *, r / sqrt(sum(r * r) OVER (PARTITION BY vec_id, cluster)) AS u FROM ({RESIDUALS}) x) y""")
def _residuals_norm(t):
    out = vocabulary.residual_vectors(t.patches().select("vec_id", "embedding"), vocab(t), normalize=True).drop("embedding")
    return long_form(out, "residuals")


@query("lloyd_step", "cluster:l n:l dim:l value:d", """
    SELECT a.cluster, count(*) AS n, p.d - 1 AS dim, avg(p.v) AS value
    FROM assigned a JOIN patch_long p USING (vec_id) GROUP BY a.cluster, p.d""")
def _lloyd(t):
    return long_form(vocabulary.lloyd_step(t.patches(), vocab(t)), "centroid")


@query("fit_vocabulary", "cluster:l dim:l gap:d", """
    SELECT c.cluster, d.dim, 0.0 AS gap FROM (SELECT unnest(range(8)) AS cluster) c, (SELECT unnest(range(64)) AS dim) d""")
def _fit(t):
    """After convergence a centroid is the mean of the descriptors that are nearest to it."""
    from ..functions.storage import cut_lineage
    p = cut_lineage(t.patches().select("vec_id", l2_normalize(F.col("embedding")).alias("embedding")))
    table = cut_lineage(vocabulary.fit_vocabulary(p, k=8, iterations=200))
    means = long_form(vocabulary.lloyd_step(p, vocabulary.load_vocabulary(table)).select("cluster", "centroid"), "centroid")
    fitted = long_form(table, "centroid").withColumnRenamed("value", "was")
    return means.join(fitted, ["cluster", "dim"]).withColumn("gap", F.col("value") - F.col("was"))


SEG_SUMS = """SELECT sp.image_id, sp.seg_id, a.cluster, p.d, sum(p.v - l.c) AS s
    FROM assigned a JOIN {incidence} sp ON sp.image_id = a.image_id AND sp.patch_id = a.patch_id
    JOIN patch_long p ON p.vec_id = a.vec_id JOIN vocabulary_long l ON l.cluster = a.cluster AND l.d = p.d
    GROUP BY sp.image_id, sp.seg_id, a.cluster, p.d"""


@query("segment_vlad", "image_id:l seg_id:l cluster:l dim:l value:d",
       vlad_sql(SEG_SUMS.format(incidence="segment_patches"), "image_id, seg_id"))
def _segment_vlad(t):
    return long_form(aggregate.segment_vlad(t.patches(), t.segment_patches(), vocab(t)), "residual")


def edges(t):
    return graph.delaunay_edges(t.segments())


@query("delaunay_edges", "image_id:l seg_a:l seg_b:l small:b", "SELECT * FROM segment_edges")
def _delaunay(t):
    return edges(t)





@query("expand_hops", "image_id:l seg_a:l seg_b:l hops:l", """SELECT * FROM hops3""")
def _hops(t):
    return graph.expand_hops(edges(t), 3)


@query("super_segment_patches", "image_id:l seg_id:l patch_id:l", "SELECT * FROM super_patches")
def _super(t):
    return graph.super_segment_patches(graph.expand_hops(edges(t), 3), t.segment_patches())


@query("segment_vlad_expanded", "image_id:l seg_id:l cluster:l dim:l value:d",
       vlad_sql(SEG_SUMS.format(incidence="super_patches"), "image_id, seg_id"))
def _segment_vlad_expanded(t):
    return long_form(aggregate.super_segment_vlad(t.patches(), graph.expand_hops(edges(t), 3), t.segment_patches(), vocab(t)), "residual")


IMAGE_SUMS = """SELECT a.image_id, a.cluster, p.d, sum({value} - l.c) AS s
    FROM assigned a JOIN {source} p ON p.vec_id = a.vec_id
    JOIN vocabulary_long l ON l.cluster = a.cluster AND l.d = p.d GROUP BY a.image_id, a.cluster, p.d"""
UNIT_SUMS = IMAGE_SUMS.format(value="p.u", source=UNIT_LONG)
RAW_SUMS = IMAGE_SUMS.format(value="p.v", source="patch_long")


@query("image_vlad_hard", OWN, vlad_sql(UNIT_SUMS, "image_id"))
def _hard(t):
    return long_form(aggregate.image_vlad_hard(t.patches(), vocab(t)), "residual")


@query("image_vlad_hard_plain", OWN, f"""
    SELECT image_id, cluster, d - 1 AS dim, s / sqrt(sum(s * s) OVER (PARTITION BY image_id)) AS value FROM ({RAW_SUMS}) x""")
def _hard_plain(t):
    return long_form(aggregate.image_vlad_hard(t.patches(), vocab(t), intra_norm=False, norm_descs=False), "residual")


@query("image_vlad_dense", POOL, f"""
    WITH hard AS ({vlad_sql(UNIT_SUMS, 'image_id')})
    SELECT i.image_id, v.cluster * 64 + x.dim AS dim, coalesce(h.value, 0) AS value
    FROM (SELECT DISTINCT image_id FROM patches) i, vocabulary v, (SELECT unnest(range(64)) AS dim) x
    LEFT JOIN hard h ON h.image_id = i.image_id AND h.cluster = v.cluster AND h.dim = x.dim""")
def _dense(t):
    v = vocab(t)
    return long_form(aggregate.densify(aggregate.image_vlad_hard(t.patches(), v), ["image_id"], v), "vec")


def softmax_sql(factor, s="s"):
    return f"""SELECT image_id, patch_id, vec_id, cluster, w / sum(w) OVER (PARTITION BY vec_id) AS w FROM (
        SELECT *, exp({factor} * ({s} - max({s}) OVER (PARTITION BY vec_id))) AS w FROM cosines) x"""


def soft_sums_sql(weights, residual="p.v - l.c", source="patch_long"):
    return f"""SELECT w.image_id, w.cluster, p.d, sum(w.w * ({residual})) AS s FROM ({weights}) w
        JOIN {source} p ON p.vec_id = w.vec_id JOIN vocabulary_long l ON l.cluster = w.cluster AND l.d = p.d
        GROUP BY w.image_id, w.cluster, p.d"""


@query("image_vlad_soft", OWN, vlad_sql(soft_sums_sql(softmax_sql("4.0", "s / enorm"), "p.u - l.c", UNIT_LONG), "image_id"))
def _soft(t):
    return long_form(aggregate.image_vlad_soft(t.patches(), vocab(t), temp=4.0), "residual")


@query("image_vlad_soft_literal", OWN, vlad_sql(soft_sums_sql(softmax_sql("4.0", "s / enorm"), """
    (SELECT count(*) FROM vocabulary) * p.u - (SELECT sum(l2.c) FROM vocabulary_long l2 WHERE l2.d = p.d)""", UNIT_LONG), "image_id"))
def _soft_literal(t):
    return long_form(aggregate.image_vlad_soft(t.patches(), vocab(t), temp=4.0, mode="literal"), "residual")


ALPHA = """(SELECT -ln(0.01) / avg(gap) FROM (SELECT vec_id, max(s) - max(s) FILTER (WHERE pos = 2) AS gap FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC) AS pos FROM cosines) x GROUP BY vec_id) y)"""


@query("netvlad_alpha", "alpha:d", f"SELECT {ALPHA} AS alpha")
def _alpha(t):
    return aggregate.alpha_table(t.patches(), vocab(t))


@query("netvlad", OWN, vlad_sql(soft_sums_sql(softmax_sql(ALPHA)), "image_id"))
def _netvlad(t):
    v, p = vocab(t), t.patches()
    return long_form(aggregate.netvlad(p, v, aggregate.fit_alpha(p, v)), "residual")


@query("soft_assignment", "vec_id:l cluster:l w:d", softmax_sql("5.0"))
def _soft_assignment(t):
    out = aggregate.soft_assignment(t.patches().select("vec_id", "embedding"), vocab(t), 5.0)
    return out.select("vec_id", F.posexplode("soft").alias("cluster", "w"))


# -- burst -----------------------------------------------------------------
PATCH_W = "image_id:l patch_id:l w:d"


def burst_sql(term, after="sum({0})", source="patches", extra=""):
    return f"""SELECT image_id, patch_id, {after.format(term)} AS w FROM (
        SELECT a.image_id, a.patch_id, -2 + 2 * list_dot_product(a.e, b.e) AS dd {extra} FROM {source} a JOIN patches b ON a.image_id = b.image_id) x
        GROUP BY image_id, patch_id"""


SIGMOID = "1 / (1 + exp(-({0})))"
BURST = burst_sql(SIGMOID.format("8.0 * dd + 7.0"))


@query("burst_weights", PATCH_W, BURST)
def _burst(t):
    return burst.burst_weights(t.patches())


@query("burst_weights_relu_inverse", PATCH_W, burst_sql(SIGMOID.format("greatest(dd / 4.0 + 0.4, 0)"), "pow(sum({0}), 0.5)"))
def _burst_relu(t):
    return burst.burst_weights(t.patches(), w=4.0, b=0.4, p=0.5, relu=True, inv=True)


@query("burst_weights_softmax", PATCH_W, """
    SELECT image_id, patch_id, sum(share) AS w FROM (
      SELECT image_id, patch_id, z / sum(z) OVER (PARTITION BY image_id, patch_id) AS share FROM (
        SELECT a.image_id, a.patch_id, exp(8.0 * (-2 + 2 * list_dot_product(a.e, b.e)) + 7.0) AS z
        FROM patches a JOIN patches b ON a.image_id = b.image_id) x) y GROUP BY image_id, patch_id""")
def _burst_softmax(t):
    return burst.burst_weights(t.patches(), softmax=True)


@query("burst_count", PATCH_W, burst_sql("dd + 1.9 > 0", "count_if({0})"))
def _burst_count(t):
    return burst.burst_count(t.patches(), 1.9)


@query("burst_soft_threshold", PATCH_W, burst_sql(SIGMOID.format("8.0 * greatest(dd + 1.9, 0)")))
def _burst_soft(t):
    return burst.burst_soft_threshold(t.patches(), 1.9)


def cluster_params(v):
    """Each cluster's own (w, b, p), spread around 1."""
    k = np.arange(len(v.clusters))
    return np.stack([4.0 + 0.2 * k, 2.0 + 0.1 * k, 1.0 - 0.01 * k], axis=1)


@query("burst_weights_per_cluster", PATCH_W, f"""
    WITH own AS (SELECT image_id, patch_id, sum(w * (4.0 + 0.2 * cluster)) AS ww, sum(w * (2.0 + 0.1 * cluster)) AS bb,
        sum(w * (1.0 - 0.01 * cluster)) AS pp FROM ({softmax_sql('5.0')}) s GROUP BY ALL)
    SELECT o.image_id, o.patch_id, pow(sum(1 / (1 + exp(-(ww * (-2 + 2 * list_dot_product(a.e, b.e)) + bb)))), any_value(pp)) AS w
    FROM own o JOIN patches a USING (image_id, patch_id) JOIN patches b ON b.image_id = o.image_id GROUP BY o.image_id, o.patch_id""")
def _burst_cluster(t):
    v = vocab(t)
    return burst.burst_weights_per_cluster(t.patches(), v, 5.0, cluster_params(v))


@query("netvlad_burst", OWN, vlad_sql(soft_sums_sql(f"""
    SELECT s.image_id, s.vec_id, s.cluster, s.w / b.w AS w FROM ({softmax_sql('5.0')}) s
    JOIN ({BURST}) b USING (image_id, patch_id)"""), "image_id"))
def _netvlad_burst(t):
    p = t.patches()
    return long_form(aggregate.netvlad(p, vocab(t), 5.0, burst.burst_weights(p)), "residual")


@query("pool_avg_burst", POOL, f"""
    SELECT p.image_id, p.d - 1 AS dim, avg(p.v / b.w) AS value FROM patch_long p JOIN ({BURST}) b USING (image_id, patch_id)
    GROUP BY p.image_id, p.d""")
def _pool_avg_burst(t):
    p = t.patches()
    return long_form(burst.pool_avg_burst(p, burst.burst_weights(p)), "vec")


# -- optimal transport -----------------------------------------------------
def tiles(t):
    """Fifty patches per tile, more than the vocabulary has clusters."""
    p = t.patches()
    return p.select(F.expr("vec_id div 50").alias("image_id"), (F.col("vec_id") % 50).alias("patch_id"), "embedding")


def scores(t, v):
    unit = v.unit
    from ..functions.blocks import map_vectors
    return map_vectors(tiles(t), "embedding", lambda x: [x @ unit.T], "scores ARRAY<DOUBLE>")


def _transport_sql():
    """Three rounds written out; z holds scores with cluster 10 as the dustbin."""
    steps = ["""sc AS (SELECT vec_id // 50 AS image_id, vec_id % 50 AS patch_id, cluster, s FROM cosines),
      n AS (SELECT image_id, count(DISTINCT patch_id) AS n FROM sc GROUP BY ALL),
      z AS (SELECT image_id, patch_id, cluster, s AS z FROM sc UNION ALL SELECT DISTINCT image_id, patch_id, 10, 1.0 FROM sc),
      v0 AS (SELECT DISTINCT image_id, patch_id, 0.0 AS v FROM sc)"""]
    for i in range(3):
        steps.append(f"""u{i} AS (SELECT z.image_id, cluster,
            -ln(any_value(n) + 10) + CASE WHEN cluster = 10 THEN ln(any_value(n) - 10) ELSE 0 END - ln(sum(exp(z + v))) AS u
            FROM z JOIN v{i} USING (image_id, patch_id) JOIN n ON n.image_id = z.image_id GROUP BY z.image_id, cluster),
          v{i + 1} AS (SELECT z.image_id, patch_id, -ln(any_value(n) + 10) - ln(sum(exp(z + u))) AS v
            FROM z JOIN u{i} USING (image_id, cluster) JOIN n ON n.image_id = z.image_id GROUP BY z.image_id, patch_id)""")
    return "WITH " + ", ".join(steps) + """ SELECT z.image_id, patch_id, cluster, exp(z + u + v + ln(n + 10)) AS w
        FROM z JOIN u2 USING (image_id, cluster) JOIN v3 USING (image_id, patch_id) JOIN n ON n.image_id = z.image_id WHERE cluster < 10"""


@query("sinkhorn_assign", "image_id:l patch_id:l cluster:l w:d", _transport_sql())
def _sinkhorn(t):
    v = vocab(t)
    out = transport.sinkhorn_assign(scores(t, v), len(v.clusters))
    return out.select("image_id", "patch_id", F.posexplode("assignment").alias("cluster", "w"))


@query("ot_aggregate", OWN, f"""
    SELECT image_id, cluster, d - 1 AS dim, s / sqrt(sum(s * s) OVER (PARTITION BY image_id, cluster)) AS value FROM (
      SELECT a.image_id, a.cluster, p.d, sum(a.w * p.v) AS s FROM ({_transport_sql()}) a
      JOIN patch_long p ON p.vec_id = a.image_id * 50 + a.patch_id GROUP BY a.image_id, a.cluster, p.d) x""")
def _ot(t):
    v = vocab(t)
    plan = transport.sinkhorn_assign(scores(t, v), len(v.clusters))
    return long_form(transport.ot_aggregate(tiles(t), plan, len(v.clusters)), "residual")


# -- pooling ---------------------------------------------------------------
@query("pool_avg", POOL, pooled_sql("avg(v)"))
def _avg(t):
    return long_form(pooling.pool_avg(t.patches()), "vec")


@query("pool_max", POOL, pooled_sql("max(v)"))
def _max(t):
    return long_form(pooling.pool_max(t.patches()), "vec")


@query("pool_sum", POOL, pooled_sql("sum(v)"))
def _sum(t):
    return long_form(pooling.pool_sum(t.patches()), "vec")


GEM = pooled_sql("pow(avg(pow(greatest(v, 1e-6), 3)), 1.0 / 3)")


@query("pool_gem", POOL, unit_sql(GEM))
def _gem(t):
    return long_form(pooling.pool_gem(t.patches()), "vec")


@query("pool_gem_normalised_input", POOL, unit_sql(pooled_sql(
    "pow(avg(pow(greatest(v, 1e-6), 3)), 1.0 / 3)",
    "(SELECT image_id, d, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS v FROM patch_long)")))
def _gem_norm(t):
    return long_form(pooling.pool_gem(t.patches(), normalize_input=True), "vec")


@query("pool_grid", POOL, """
    SELECT image_id, dim, value / sqrt(sum(value * value) OVER (PARTITION BY image_id)) AS value FROM (
      SELECT p.image_id, (r.i * 2 + c.i) * 64 + p.d - 1 AS dim, avg(p.v) AS value
      FROM patch_long p, (VALUES (0), (1)) r(i), (VALUES (0), (1)) c(i)
      WHERE p.py >= floor(r.i * 2 / 2.0) AND p.py < ceil((r.i + 1) * 2 / 2.0)
        AND p.px >= floor(c.i * 5 / 2.0) AND p.px < ceil((c.i + 1) * 5 / 2.0) GROUP BY p.image_id, r.i, c.i, p.d) x""")
def _grid(t):
    return long_form(pooling.pool_grid(t.patches()), "vec")



@query("segment_mean", "image_id:l seg_id:l dim:l value:d", f"""
    SELECT sp.image_id, sp.seg_id, p.d - 1 AS dim, avg(p.u) AS value
    FROM segment_patches sp JOIN {UNIT_LONG} p USING (image_id, patch_id) GROUP BY sp.image_id, sp.seg_id, p.d""")
def _segment_mean(t):
    return long_form(pooling.segment_mean(t.patches(), t.segment_patches()), "vec")


@query("segments_global_mean", POOL, f"""
    SELECT sp.image_id, p.d - 1 AS dim, avg(p.u) AS value
    FROM segment_patches sp JOIN {UNIT_LONG} p USING (image_id, patch_id) GROUP BY sp.image_id, p.d""")
def _segments_global(t):
    return long_form(pooling.segments_global_mean(t.patches(), t.segment_patches()), "vec")


@query("neighbour_mean", "image_id:l seg_id:l dim:l value:d", """
    SELECT image_id, seg_a AS seg_id, d - 1 AS dim, avg(v) AS value FROM (
      SELECT e.image_id, e.seg_a, e.seg_b, generate_subscripts(s.vec, 1) AS d, unnest(s.vec) AS v
      FROM segment_edges e JOIN segment_vectors s ON s.image_id = e.image_id AND s.seg_id = e.seg_b WHERE NOT e.small) x
    GROUP BY image_id, seg_a, d""")
def _neighbour_mean(t):
    return long_form(pooling.neighbour_mean(t.segment_vectors(), edges(t)), "vec")


@query("log_binned_descriptor", "image_id:l patch_id:l dim:l value:d", """
    WITH offs AS (SELECT row_number() OVER (ORDER BY level, dy, dx) - 1 AS part, level, dy * step AS dy, dx * step AS dx FROM (
        SELECT l.level, CAST(pow(3, l.level) AS BIGINT) AS step, y.dy, x.dx FROM (VALUES (0), (1)) l(level),
        (VALUES (-1), (0), (1)) y(dy), (VALUES (-1), (0), (1)) x(dx) WHERE l.level = 0 OR y.dy <> 0 OR x.dx <> 0) o),
    win AS (SELECT image_id, 0 AS level, py, px, d, v AS m FROM patch_long UNION ALL
      SELECT a.image_id, 1, a.py, a.px, b.d, avg(b.v) FROM patches a JOIN patch_long b
      ON a.image_id = b.image_id AND abs(a.py - b.py) <= 1 AND abs(a.px - b.px) <= 1 GROUP BY a.image_id, a.py, a.px, b.d)
    SELECT p.image_id, p.patch_id, o.part * 64 + w.d - 1 AS dim, w.m AS value FROM patches p, offs o
    JOIN win w ON w.image_id = p.image_id AND w.level = o.level AND w.py = least(greatest(p.py + o.dy, 0), 1)
      AND w.px = least(greatest(p.px + o.dx, 0), 4)""")
def _log_bin(t):
    return long_form(pooling.log_binned_descriptor(t.patches()), "vec")


@query("resample_bilinear", "image_id:l y:l x:l dim:l value:d", """
    SELECT p.image_id, ty.t AS y, tx.t AS x, p.d - 1 AS dim,
           sum(p.v * (1 - abs(ty.t * 1.0 / 3 - p.py)) * (1 - abs(tx.t * 4.0 / 8 - p.px))) AS value
    FROM patch_long p, (SELECT unnest(range(4)) AS t) ty, (SELECT unnest(range(9)) AS t) tx
    WHERE abs(ty.t * 1.0 / 3 - p.py) < 1 AND abs(tx.t * 4.0 / 8 - p.px) < 1 GROUP BY p.image_id, ty.t, tx.t, p.d""")
def _bilinear(t):
    return long_form(pooling.resample_bilinear(t.patches(), 4, 9), "vec")


@query("attention_saliency", "image_id:l patch_id:l saliency:d", """
    SELECT image_id, patch_id, (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) AS saliency FROM (
      SELECT image_id, patch_id, avg(v) AS a FROM patch_long WHERE d - 1 IN (0, 2, 4, 5) GROUP BY ALL) x
    WINDOW w AS (PARTITION BY image_id)""")
def _saliency(t):
    # The entries of a descriptor stand in for attention heads; the default ones are averaged.
    heads = long_form(t.patches().select("image_id", "patch_id", F.col("embedding").alias("v")), "v", "head", "value")
    return pooling.attention_saliency(heads)
