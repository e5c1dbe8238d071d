"""Why a query was won or lost: margins between its positive and negative image."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import cosine, dot, l2


def segment_margins(triplets: DataFrame, info: DataFrame, q_vecs: DataFrame, r_vecs: DataFrame) -> DataFrame:
    """Mean, sum and count differences of segment similarities, positive minus negative.

    ``info`` comes from ``vote.match_info``; ``q_vecs`` is ``(q_image, q_seg, vec)`` and
    ``r_vecs`` ``(r_seg, vec)``. Queries lacking either image give no row (T18).
    """
    roles = triplets.where("positive IS NOT NULL AND negative IS NOT NULL").select(
        F.col("anchor").alias("q_image"),
        F.explode(F.array(
            F.struct(F.lit("p").alias("side"), F.col("positive").alias("r_image")),
            F.struct(F.lit("n").alias("side"), F.col("negative").alias("r_image")),
        )).alias("_r"),
    ).select("q_image", "_r.side", "_r.r_image")
    sims = (
        info.join(roles, ["q_image", "r_image"])
        .join(q_vecs.select("q_image", "q_seg", F.col("vec").alias("_q")), ["q_image", "q_seg"])
        .join(r_vecs.select("r_seg", F.col("vec").alias("_v")), "r_seg")
        .select("q_image", "side", dot(F.col("_q"), F.col("_v")).alias("s"))
    )

    def of(side: str, agg):
        return agg(F.when(F.col("side") == side, F.col("s")))

    return sims.groupBy("q_image").agg(
        (of("p", F.avg) - of("n", F.avg)).alias("margin_mean"),
        (of("p", F.sum) - of("n", F.sum)).alias("margin_sum"),
        (of("p", F.count) - of("n", F.count)).alias("margin_count"),
    ).where("margin_mean IS NOT NULL")


def image_margins(triplets: DataFrame, q_vecs: DataFrame, r_vecs: DataFrame) -> DataFrame:
    """Similarity to the positive minus similarity to the negative image."""
    complete = triplets.where("positive IS NOT NULL AND negative IS NOT NULL").withColumnRenamed("anchor", "q_image")
    joined = (
        complete.join(q_vecs.select("q_image", F.col("vec").alias("_q")), "q_image")
        .join(r_vecs.select(F.col("r_image").alias("positive"), F.col("vec").alias("_p")), "positive")
        .join(r_vecs.select(F.col("r_image").alias("negative"), F.col("vec").alias("_n")), "negative")
    )
    return joined.select("q_image", (dot(F.col("_p"), F.col("_q")) - dot(F.col("_n"), F.col("_q"))).alias("margin"))


def triplet_clusters(triplets: DataFrame, q_vlad: DataFrame, r_vlad: DataFrame, clusters: int) -> DataFrame:
    """``(q_image, cluster, q, p, n)`` from long-form VLAD rows ``(image_id, cluster, residual)``.

    Each triplet has all ``clusters`` rows; a cluster that an image does not use is a zero vector.
    """
    complete = triplets.where("positive IS NOT NULL AND negative IS NOT NULL").withColumnRenamed("anchor", "q_image")
    q = q_vlad.select(F.col("image_id").alias("q_image"), "cluster", F.col("residual").alias("q"))
    p = r_vlad.select(F.col("image_id").alias("positive"), "cluster", F.col("residual").alias("p"))
    n = r_vlad.select(F.col("image_id").alias("negative"), "cluster", F.col("residual").alias("n"))
    every = complete.withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(clusters - 1))))
    joined = every.join(q, ["q_image", "cluster"], "left").join(p, ["positive", "cluster"], "left").join(n, ["negative", "cluster"], "left")
    width = q_vlad.agg(F.max(F.size("residual"))).scalar()
    zeros = F.array_repeat(F.lit(0.0), width)
    return joined.select("q_image", "cluster", *(F.coalesce(c, zeros).alias(c) for c in ("q", "p", "n")))


def cluster_margins(clusters: DataFrame) -> DataFrame:
    """Per cluster: distance to the negative minus distance to the positive, and its rank.

    Rank 1 is the smallest margin; the window spans the K clusters of one query.
    """
    m = clusters.select("q_image", "cluster", l2(F.col("q"), F.col("p")).alias("dist_pos"), l2(F.col("q"), F.col("n")).alias("dist_neg"))
    m = m.withColumn("margin", F.col("dist_neg") - F.col("dist_pos"))
    order = Window.partitionBy("q_image").orderBy(F.round("margin", 9), "cluster")
    return m.withColumn("margin_rank", F.row_number().over(order))


def cluster_rank_shift(mine: DataFrame, other: DataFrame) -> DataFrame:
    """Rank in ``other`` minus rank in ``mine`` per cluster, and the largest shift per query."""
    shifts = (
        mine.select("q_image", "cluster", F.col("margin_rank").alias("_a"))
        .join(other.select("q_image", "cluster", F.col("margin_rank").alias("_b")), ["q_image", "cluster"])
        .select("q_image", "cluster", (F.col("_b") - F.col("_a")).alias("shift"), "_b")
    )
    # Among equal shifts the cluster listed first by the other method is reported.
    top = shifts.groupBy("q_image").agg(
        F.max_by("cluster", F.struct("shift", -F.col("_b"))).alias("most_shifted")
    )
    return shifts.drop("_b").join(top, "q_image")


def cluster_distance_histogram(margins: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width histograms of the positive and negative distances per query.

    Each side has its own range, from its minimum to its maximum; the last bin is closed.
    """
    long = margins.select("q_image", F.explode(F.array(
        F.struct(F.lit("positive").alias("side"), F.col("dist_pos").alias("d")),
        F.struct(F.lit("negative").alias("side"), F.col("dist_neg").alias("d")),
    )).alias("_v")).select("q_image", "_v.side", "_v.d")
    bounds = long.groupBy("q_image", "side").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    width = F.col("hi") - F.col("lo")
    position = F.floor((F.col("d") - F.col("lo")) * bins / F.nullif(width, F.lit(0.0)))
    return (
        long.join(bounds, ["q_image", "side"])
        .groupBy("q_image", "side", F.least(F.coalesce(position, F.lit(bins // 2)), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _roles(clusters: DataFrame) -> DataFrame:
    return clusters.select("q_image", "cluster", F.explode(F.array(*[
        F.struct(F.lit(r).alias("role"), F.col(r).alias("vec")) for r in ("q", "p", "n")
    ])).alias("_v")).select("q_image", "cluster", "_v.role", "_v.vec")


def cluster_pairwise(clusters: DataFrame, metric: str = "distance") -> DataFrame:
    """Full 3K x 3K distance matrix per query, or cosine of query with positive/negative.

    The matrix is the result; per query it has at most (3K)^2 entries.
    """
    rows = _roles(clusters)
    a = rows.select("q_image", F.col("role").alias("role_a"), F.col("cluster").alias("cluster_a"), F.col("vec").alias("_a"))
    b = rows.select("q_image", F.col("role").alias("role_b"), F.col("cluster").alias("cluster_b"), F.col("vec").alias("_b"))
    if metric == "cosine":
        a, b, value = a.where("role_a = 'q'"), b.where("role_b <> 'q'"), cosine(F.col("_a"), F.col("_b"))
    elif metric == "distance":
        value = l2(F.col("_a"), F.col("_b"))
    else:
        raise ValueError(f"unknown metric: {metric}")
    return a.join(b, "q_image").select("q_image", "role_a", "cluster_a", "role_b", "cluster_b", value.alias("value"))


def cluster_groups(clusters: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """K-means group of every query/positive/negative cluster vector."""
    data = _roles(clusters).withColumn("features", array_to_vector("vec"))
    model = KMeans(k=k, seed=seed).fit(data)
    return model.transform(data).select("q_image", "cluster", "role", F.col("prediction").alias("group"))


def cluster_embedding_2d(clusters: DataFrame) -> DataFrame:
    """Two principal coordinates of every query/positive/negative cluster vector."""
    from .reduce import apply_pca, fit_pca

    rows = _roles(clusters)
    model = fit_pca(rows.select("vec"), 2, whiten=False)
    return apply_pca(rows, model).select("q_image", "cluster", "role", F.col("reduced")[0].alias("x"), F.col("reduced")[1].alias("y"))


def mining_accuracy(mined: DataFrame, samples: DataFrame) -> DataFrame:
    """1 - distinct mined anchors / samples."""
    total = samples.agg(F.count(F.lit(1))).scalar()
    return mined.agg((F.lit(1.0) - F.count_distinct("anchor") / total).alias("accuracy"))
