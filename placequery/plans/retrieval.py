"""Search and voting queries."""

from pyspark.sql import functions as F

from ..functions.storage import cut_lineage
from ..operators import search, vote
from .fixtures import Fixtures
from .registry import query

DEPTH = 20


def sides(t: Fixtures):
    p = t.patches()
    q = p.where("role = 'query'").select(F.col("image_id").alias("q_image"), F.col("patch_id").alias("q_seg"), F.col("embedding").alias("vec"))
    r = p.where("role = 'ref'").select(F.col("image_id").alias("r_image"), F.col("patch_id").alias("r_seg"), F.col("embedding").alias("vec"))
    return q, r


def knn_matches(t: Fixtures, k: int = DEPTH):
    q, r = sides(t)
    return search.knn_l2(q, r, k, q_ids=["q_image", "q_seg"], r_ids=["r_image", "r_seg"])


def matches(t: Fixtures, k: int = DEPTH):
    """Voting input; the reference segment gets one id over all images."""
    found = search.segment_matches(knn_matches(t, k), k)
    return found.withColumn("r_seg", F.col("r_image") * 10 + F.col("r_seg"))


def predictions(t: Fixtures, n: int = 5):
    return vote.get_matches(matches(t), n)


KNN_COLS = "q_image:l q_seg:l rank:l r_image:l r_seg:l sq_dist:d"


@query("knn_l2", KNN_COLS, "SELECT * FROM knn_matches")
def _knn_l2(t):
    return knn_matches(t)


@query("knn_l2_deep", KNN_COLS, """
    SELECT *, row_number() OVER (PARTITION BY q_image, q_seg ORDER BY sq_dist, r_image, r_seg) AS rank
    FROM knn_pairs QUALIFY rank <= 200""")
def _knn_l2_deep(t):
    return knn_matches(t, 200)


@query("knn_cosine_segments", "q_image:l q_seg:l rank:l r_image:l r_seg:l sim:d", """
    SELECT q.image_id AS q_image, q.seg_id AS q_seg, r.image_id AS r_image, r.seg_id AS r_seg,
           list_cosine_similarity(q.vec, r.vec) AS sim,
           row_number() OVER (PARTITION BY q.image_id, q.seg_id ORDER BY list_cosine_similarity(q.vec, r.vec) DESC, r.image_id, r.seg_id) AS rank
    FROM segment_vectors q, segment_vectors r WHERE q.role = 'query' AND r.role = 'ref' QUALIFY rank <= 10""")
def _knn_cosine(t):
    v = t.segment_vectors()
    q = v.where("role = 'query'").select(F.col("image_id").alias("q_image"), F.col("seg_id").alias("q_seg"), "vec")
    r = v.where("role = 'ref'").select(F.col("image_id").alias("r_image"), F.col("seg_id").alias("r_seg"), "vec")
    return search.knn_ip(q, r, 10, "cosine", q_ids=["q_image", "q_seg"], r_ids=["r_image", "r_seg"])


@query("knn_inner_product", "q_image:l q_seg:l rank:l r_image:l r_seg:l sim:d", """
    SELECT q.image_id AS q_image, q.seg_id AS q_seg, r.image_id AS r_image, r.seg_id AS r_seg,
           list_dot_product(q.vec, r.vec) AS sim,
           row_number() OVER (PARTITION BY q.image_id, q.seg_id ORDER BY list_dot_product(q.vec, r.vec) DESC, r.image_id, r.seg_id) AS rank
    FROM segment_vectors q, segment_vectors r WHERE q.role = 'query' AND r.role = 'ref' QUALIFY rank <= 10""")
def _knn_ip(t):
    v = t.segment_vectors()
    q = v.where("role = 'query'").select(F.col("image_id").alias("q_image"), F.col("seg_id").alias("q_seg"), "vec")
    r = v.where("role = 'ref'").select(F.col("image_id").alias("r_image"), F.col("seg_id").alias("r_seg"), "vec")
    return search.knn_ip(q, r, 10, "ip", q_ids=["q_image", "q_seg"], r_ids=["r_image", "r_seg"])


@query("knn_image", "q_image:l rank:l r_image:l dist:d", """
    WITH means AS (SELECT image_id, role, list(m ORDER BY d) AS m FROM (
        SELECT image_id, role, d, avg(v) AS m FROM patch_long GROUP BY ALL) x GROUP BY ALL)
    SELECT q.image_id AS q_image, r.image_id AS r_image, list_distance(q.m, r.m) AS dist,
           row_number() OVER (PARTITION BY q.image_id ORDER BY list_distance(q.m, r.m), r.image_id) AS rank
    FROM means q, means r WHERE q.role = 'query' AND r.role = 'ref' QUALIFY rank <= 5""")
def _knn_image(t):
    from ..functions.vectors import mean_vectors
    m = t.patches().groupBy("image_id", "role").agg(mean_vectors(F.col("embedding")).alias("vec"))
    q = m.where("role = 'query'").withColumnRenamed("image_id", "q_image")
    r = m.where("role = 'ref'").withColumnRenamed("image_id", "r_image")
    return search.knn_image(q, r, 5, q_ids=["q_image"], r_ids=["r_image"])


@query("similarity_from_sq_l2", "q_image:l q_seg:l rank:l r_image:l r_seg:l sim:d", "SELECT * FROM matches")
def _similarity(t):
    return matches(t)


@query("minmax_global", "q_image:l q_seg:l rank:l nsim:d", "SELECT * FROM normed_matches")
def _minmax_global(t):
    # Stored once: the bounds and the rows both read it.
    return vote.normalised(cut_lineage(matches(t)))


@query("minmax_per_image", "image_id:l patch_id:l dim:l norm:d", """
    SELECT image_id, patch_id, d - 1 AS dim, (v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0) AS norm
    FROM patch_long WINDOW w AS (PARTITION BY image_id, d)""")
def _minmax_grouped(t):
    from ..functions.vectors import long_form, minmax_grouped
    p = long_form(t.patches().select("image_id", "patch_id", "embedding"), "embedding")
    return minmax_grouped(p, "value", "norm", ["image_id", "dim"])


VOTE_COLS = "q_image:l rank:l r_image:l score:d"


def _ranked(score, order, source="matches", n=5, where="TRUE"):
    return f"""SELECT *, row_number() OVER (PARTITION BY q_image ORDER BY {order}) AS rank FROM (
        SELECT q_image, r_image, {score} AS score, min(rank) AS best_rank, min({{'r': rank, 's': q_seg}}).s AS first_seg
        FROM {source} m WHERE {where} GROUP BY ALL) x QUALIFY rank <= {n}"""


_TIES = "best_rank, first_seg, r_image"
VOTE_SQL = {
    "max_sim": """
        SELECT *, row_number() OVER (PARTITION BY q_image ORDER BY pos) AS rank FROM (
          SELECT q_image, r_image, min(pos) AS pos, max(sim) AS score FROM (
            SELECT *, row_number() OVER (PARTITION BY q_image ORDER BY round(sim, 9) DESC, q_seg, r_seg) AS pos
            FROM matches WHERE rank = 1 QUALIFY pos <= 50) y GROUP BY ALL) x QUALIFY rank <= 5""",
    "max_seg": _ranked("count(*)", "score DESC, r_image", where="rank = 1"),
    "max_seg_sim": """
        SELECT *, row_number() OVER (PARTITION BY q_image ORDER BY round(score, 9) DESC, r_image) AS rank FROM (
          SELECT q_image, r_image, count(*) AS votes, max(sim) AS score FROM matches WHERE rank = 1 GROUP BY q_image, r_image
          QUALIFY row_number() OVER (PARTITION BY q_image ORDER BY count(*) DESC, r_image) <= 6) x QUALIFY rank <= 5""",
    "max_seg_topk": _ranked("count(*)", "score DESC, r_image"),
    "max_seg_topk_borda": _ranked("count(DISTINCT r_seg)", "score DESC, r_image"),
    "max_seg_topk_avg": _ranked("count(DISTINCT r_seg)", "score DESC, r_image"),
    "max_seg_topk_wt_borda": _ranked("count(DISTINCT r_seg)", "score DESC, r_image"),
    "max_seg_topk_avg_sim": _ranked("count(DISTINCT r_seg)", "score DESC, r_image"),
    "max_seg_topk_borda_Im": _ranked("sum(20 - rank + 1)", f"score DESC, {_TIES}"),
    "max_seg_topk_avg_Im": _ranked("avg(rank)", f"round(score, 9), {_TIES}"),
    "max_seg_topk_wt_borda_Im": _ranked("sum(nsim)", f"round(score, 9) DESC, {_TIES}", "normed_matches"),
    "max_seg_topk_avg_sim_Im": _ranked("avg(nsim)", f"round(score, 9) DESC, {_TIES}", "normed_matches"),
}


def _register(method):
    @query(f"vote_{method}", VOTE_COLS, VOTE_SQL[method])
    def run(t):
        return vote.get_matches(matches(t), 5, method)


for _method in VOTE_SQL:
    _register(_method)


def _register_old(method):
    @query(f"vote_old_{method}", VOTE_COLS, VOTE_SQL[method])
    def run(t):
        return vote.get_matches_old(matches(t), 5, method)


for _method in vote.OLD_METHODS:
    _register_old(_method)


@query("first_k_unique", "q_image:l rank:l r_image:l", """
    SELECT q_image, r_image, row_number() OVER (PARTITION BY q_image ORDER BY pos) AS rank FROM (
      SELECT q_image, r_image, min(rank * 1000 + q_seg) AS pos FROM matches GROUP BY ALL) x QUALIFY rank <= 3""")
def _first_k(t):
    m = matches(t).withColumn("pos", F.col("rank") * 1000 + F.col("q_seg"))
    return vote.first_k_unique(m, ["q_image"], "r_image", "pos", 3)


@query("match_pairs", "q_image:l r_image:l pos:l q_seg:l r_seg:l sim:d", """
    SELECT *, row_number() OVER (PARTITION BY q_image, r_image ORDER BY round(sim, 9) DESC, q_seg, r_seg) AS pos
    FROM matches QUALIFY pos <= 50""")
def _match_pairs(t):
    return vote.match_pairs(matches(t))


@query("match_info", "q_image:l r_rank:l r_image:l votes:l q_seg:l r_seg:l sim:d", f"""
    WITH top AS ({VOTE_SQL['max_seg']})
    SELECT t.q_image, t.rank AS r_rank, t.r_image, t.score AS votes, m.q_seg, m.r_seg, m.sim
    FROM top t JOIN matches m ON m.q_image = t.q_image AND m.r_image = t.r_image AND m.rank = 1""")
def _match_info(t):
    return vote.match_info(matches(t))


@query("segments_to_images", "q_image:l q_seg:l rank:l r_image:l", "SELECT * FROM matches")
def _segments_to_images(t):
    found = matches(t).select("q_image", "q_seg", "rank", F.col("r_seg").alias("r_uid"))
    index = t.patch_list().where("role = 'ref'").select(F.col("vec_id").alias("r_uid"), F.col("image_id").alias("r_image"))
    return search.segments_to_images(found, index)
