"""Recall, average precision and method comparison.

``predictions`` rows are ``(q_image, rank, r_image, ...)``, ``gt`` rows are
``(q_image, r_image)``, ``queries`` lists every query image once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .search import knn_l2

PAIR = ["q_image", "r_image"]


def first_hits(predictions: DataFrame, gt: DataFrame) -> DataFrame:
    """Best rank holding a correct reference, for queries that have one."""
    hits = predictions.join(gt.select(*PAIR), PAIR, "left_semi")
    return hits.groupBy("q_image").agg(F.min("rank").alias("first_hit"))


def _recalls(hits: DataFrame, ks: list[int], scale: float) -> DataFrame:
    """One aggregate over all queries gives every k at once."""
    counted = hits.agg(
        F.count(F.lit(1)).alias("evaluated"),
        *[F.count(F.when(F.col("first_hit") <= k, 1)).alias(f"_{k}") for k in ks],
    )
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_{k}").alias("hits")) for k in ks])).alias("_r")
    out = counted.select(rows, "evaluated").select("_r.k", "_r.hits", "evaluated")
    return out.withColumn("recall", F.col("hits") * F.lit(scale) / F.nullif(F.col("evaluated"), F.lit(0)))


def recall_at_k(predictions: DataFrame, gt: DataFrame, queries: DataFrame, n: int = 5, scale: float = 1.0) -> DataFrame:
    """Share of queries *with ground truth* hit at rank <= k, k = 1..n (T8).

    ``scale`` 100 gives percent. Columns ``k, hits, evaluated, recall``.
    """
    judged = queries.join(gt.select("q_image"), "q_image", "left_semi")
    return _recalls(judged.join(first_hits(predictions, gt), "q_image", "left"), list(range(1, n + 1)), scale)


def recall_at_k_all(
    predictions: DataFrame, gt: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 5, 10),
    scale: float = 100.0, sub_q: int = 1, sub_db: int = 1,
) -> DataFrame:
    """The same over *all* queries; ids are multiplied back by sub-sampling steps."""
    step = predictions.select((F.col("q_image") * sub_q).alias("q_image"), "rank", (F.col("r_image") * sub_db).alias("r_image"))
    scaled = queries.select((F.col("q_image") * sub_q).alias("q_image"))
    return _recalls(scaled.join(first_hits(step, gt), "q_image", "left"), list(ks), scale)


def recall_one_percent(predictions: DataFrame, gt: DataFrame, queries: DataFrame, refs: DataFrame, depth: int = 5) -> DataFrame:
    """Hit within the first max(round(n_ref / 100), 1) neighbours, in percent.

    Rounding is half to even; no more than the ``depth`` listed neighbours are seen.
    """
    limit = refs.agg(F.least(F.greatest(F.bround(F.count(F.lit(1)) / 100.0), F.lit(1.0)), F.lit(float(depth)))).scalar()
    judged = queries.join(gt.select("q_image"), "q_image", "left_semi")
    hits = judged.join(first_hits(predictions, gt), "q_image", "left").withColumn("_limit", limit)
    counted = hits.agg(
        F.count(F.lit(1)).alias("evaluated"), F.count(F.when(F.col("first_hit") <= F.col("_limit"), 1)).alias("hits")
    )
    return counted.withColumn("recall", F.col("hits") * 100.0 / F.nullif(F.col("evaluated"), F.lit(0)))


def top1_similarity(predictions: DataFrame, gt: DataFrame, q_vecs: DataFrame, r_vecs: DataFrame, similarity) -> DataFrame:
    """Similarity of query and rank-1 match where that match is correct."""
    right = predictions.where("rank = 1").join(gt.select(*PAIR), PAIR, "left_semi").select(*PAIR)
    return (
        right.join(q_vecs.select("q_image", F.col("vec").alias("_q")), "q_image")
        .join(r_vecs.select("r_image", F.col("vec").alias("_r")), "r_image")
        .select("q_image", "r_image", similarity(F.col("_q"), F.col("_r")).alias("sim"))
    )


def hit_flags(predictions: DataFrame, gt: DataFrame, queries: DataFrame, n: int | None = None) -> DataFrame:
    """1 for queries with a correct prediction among the first ``n``, else 0."""
    seen = predictions if n is None else predictions.where(F.col("rank") <= n)
    return queries.join(first_hits(seen, gt), "q_image", "left").select(
        "q_image", F.when(F.col("first_hit").isNotNull(), 1).otherwise(0).alias("hit")
    )


def relevance_lists(predictions: DataFrame, gt: DataFrame) -> DataFrame:
    """Relevance flag per prediction."""
    marked = predictions.join(gt.select(*PAIR).distinct().withColumn("_g", F.lit(1)), PAIR, "left")
    return marked.select("q_image", "rank", "r_image", F.coalesce(F.col("_g"), F.lit(0)).alias("relevant"))


def average_precision(relevance: DataFrame) -> DataFrame:
    """AP over the relevant items *retrieved* (T9); 0 where there are none.

    The running window spans one query's prediction list, whose length is the search n.
    """
    so_far = Window.partitionBy("q_image").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    steps = relevance.withColumn("_p", F.col("relevant") * F.sum("relevant").over(so_far) / F.col("rank"))
    return steps.groupBy("q_image").agg(
        F.coalesce(F.sum("_p") / F.nullif(F.sum("relevant"), F.lit(0)), F.lit(0.0)).alias("ap_retrieved")
    )


def mean_ap(relevance: DataFrame) -> DataFrame:
    return average_precision(relevance).agg(F.coalesce(F.avg("ap_retrieved"), F.lit(0.0)).alias("map"))


def compare_methods(baselines: DataFrame, mine: DataFrame, gt: DataFrame, queries: DataFrame, name: str = "your_method") -> DataFrame:
    """Queries where exactly one of two methods is right at rank 1.

    ``baselines`` has a ``method`` column and may hold many of them. ``ground_truth`` is the JSON
    list of the query's true references in ascending order.
    """
    def top1(df: DataFrame, cols: list[str], out: str) -> DataFrame:
        flagged = df.where("rank = 1").join(gt.select(*PAIR).distinct().withColumn("_g", F.lit(True)), PAIR, "left")
        return flagged.select(*cols, F.col("r_image").alias(f"{out}_top1"), F.coalesce("_g", F.lit(False)).alias(f"{out}_hit"))

    b = top1(baselines, ["method", "q_image"], "baseline")
    m = top1(mine, ["q_image"], "mine")
    # Percent of all queries right at rank 1, as scalars of one row per method.
    total = queries.agg(F.count(F.lit(1))).scalar()
    mine_r1 = m.agg(F.count_if("mine_hit")).scalar()
    b_r1 = b.groupBy("method").agg(F.count_if("baseline_hit").alias("_hits"))
    truth = gt.select(*PAIR).distinct().groupBy("q_image").agg(F.to_json(F.array_sort(F.collect_list("r_image"))).alias("ground_truth"))
    return (
        b.join(m, "q_image").where(F.col("baseline_hit") != F.col("mine_hit")).join(b_r1, "method").join(truth, "q_image")
        .select(
            F.col("method").alias("baseline"), F.lit(name).alias("your_method"), F.col("q_image").alias("query_index"),
            F.col("baseline_top1"), F.col("baseline_hit").alias("corrected_by_baseline"),
            F.col("mine_hit").alias("corrected_by_your_method"), F.col("mine_top1"),
            (mine_r1 * 100.0 / total).alias("your_method_r1"), (F.col("_hits") * 100.0 / total).alias("baseline_r1"), "ground_truth",
        )
    )


def build_triplets(predictions: DataFrame, gt: DataFrame, queries: DataFrame) -> DataFrame:
    """First correct and first wrong prediction per query, else NULL."""
    marked = relevance_lists(predictions, gt).join(gt.select("q_image"), "q_image", "left_semi")

    def first(flag: int) -> Column:
        return F.min_by(F.col("r_image"), F.when(F.col("relevant") == flag, F.col("rank")))

    found = marked.groupBy("q_image").agg(
        F.when(F.count_if(F.col("relevant") == 1) > 0, first(1)).alias("positive"),
        F.when(F.count_if(F.col("relevant") == 0) > 0, first(0)).alias("negative"),
    )
    return queries.select(F.col("q_image").alias("anchor")).join(found.withColumnRenamed("q_image", "anchor"), "anchor", "left")


def evaluate(datasets: list[tuple[str, DataFrame, DataFrame]], ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Recall table over datasets of ``(name, images, gt)``; images hold role and vec."""
    out = None
    for name, images, gt in datasets:
        q = images.where("role = 'query'").select(F.col("image_id").alias("q_image"), "vec")
        r = images.where("role = 'ref'").select(F.col("image_id").alias("r_image"), "vec")
        found = knn_l2(q, r, max(ks), q_ids=["q_image"], r_ids=["r_image"])
        rows = recall_at_k_all(found, gt, q.select("q_image"), ks).withColumn("dataset", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def retrieved_and_true(predictions: DataFrame, gt: DataFrame) -> DataFrame:
    """Intersection of the retrieved and the true set, per query."""
    return predictions.select(*PAIR).intersect(gt.select(*PAIR))
