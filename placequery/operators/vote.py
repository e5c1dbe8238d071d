"""Voting of matched segments into ranked reference images.

Input rows are ``(q_image, q_seg, rank, r_image, r_seg, sim)``. Every method reduces to
one grouped aggregate on (q_image, r_image) with map-side combine, then a per-query
top-n that Spark trims before the shuffle. Scores that differ only by summation order
(below 1e-9) count as ties, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import top_per_group
from ..functions.storage import cut_lineage
from ..functions.vectors import minmax_between

PAIR = ["q_image", "r_image"]


def _best(scores: DataFrame, n: int, *order: Column) -> DataFrame:
    return top_per_group(scores, ["q_image"], list(order), n, "rank").select("q_image", "rank", "r_image", "score")


def _by_score(scores: DataFrame, n: int) -> DataFrame:
    """Ties keep first-seen order: rank-major, then query segment (T5)."""
    return _best(scores, n, F.round("score", 9).desc(), F.col("best_rank"), F.col("first_seg"), F.col("r_image"))


def _by_count(scores: DataFrame, n: int) -> DataFrame:
    return _best(scores, n, F.col("score").desc(), F.col("r_image"))


def normalised(matches: DataFrame, bounds: tuple | None = None) -> DataFrame:
    """Global min-max of the similarities (T4); given bounds skip the extra pass."""
    if bounds is None:
        row = matches.agg(F.struct(F.min("sim").alias("lo"), F.max("sim").alias("hi"))).scalar()
        lo, hi = row["lo"], row["hi"]
    else:
        lo, hi = F.lit(float(bounds[0])), F.lit(float(bounds[1]))
    return matches.withColumn("nsim", minmax_between(F.col("sim"), lo, hi))


def _seen(matches: DataFrame, **scores: Column) -> DataFrame:
    """Scores per pair, and the first match of the pair (smallest rank, then segment) for ties."""
    seen = matches.groupBy(*PAIR).agg(*[c.alias(n) for n, c in scores.items()], F.min(F.struct("rank", "q_seg")).alias("_first"))
    return seen.withColumns({"best_rank": F.col("_first.rank"), "first_seg": F.col("_first.q_seg")}).drop("_first")


def _pair_similarities(matches: DataFrame, bounds: tuple | None):
    """Per-pair sums plus the global bounds, from one pass over the matches.

    Normalising is linear, so sums and counts per pair are enough. The pair table is far
    smaller than the matches; it is written once, so the search behind it runs once.
    """
    pairs = _seen(
        matches, total=F.sum("sim"), votes=F.count(F.lit(1)), lowest=F.min("sim"), highest=F.max("sim")
    )
    if bounds is not None:
        return pairs, F.lit(float(bounds[0])), F.lit(float(bounds[1]))
    pairs = cut_lineage(pairs)
    row = pairs.agg(F.struct(F.min("lowest").alias("lo"), F.max("highest").alias("hi"))).scalar()
    return pairs, row["lo"], row["hi"]


def max_sim(matches: DataFrame, n: int = 5, segments: int = 50) -> DataFrame:
    """Images of the most similar query segments, first n distinct."""
    nearest = matches.where("rank = 1")
    best = top_per_group(nearest, ["q_image"], [F.round("sim", 9).desc(), F.col("q_seg"), F.col("r_seg")], segments, "_pos")
    return first_k_unique(best, ["q_image"], "r_image", "_pos", n, score=F.max("sim"))


def max_seg(matches: DataFrame, n: int = 5) -> DataFrame:
    return _by_count(matches.where("rank = 1").groupBy(*PAIR).agg(F.count(F.lit(1)).alias("score")), n)


def max_seg_sim(matches: DataFrame, n: int = 5, shortlist: int = 6) -> DataFrame:
    """Most-voted images re-ranked by their best similarity."""
    votes = matches.where("rank = 1").groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_votes"), F.max("sim").alias("score"))
    short = top_per_group(votes, ["q_image"], [F.col("_votes").desc(), F.col("r_image")], shortlist, "_pos")
    return _best(short, n, F.round("score", 9).desc(), F.col("r_image"))


def max_seg_topk(matches: DataFrame, n: int = 5) -> DataFrame:
    return _by_count(matches.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("score")), n)


def distinct_segments(matches: DataFrame, n: int = 5) -> DataFrame:
    """The segment-level Borda family: weights cancel out, distinct segments count (T3)."""
    return _by_count(matches.groupBy(*PAIR).agg(F.count_distinct("r_seg").alias("score")), n)


def borda_images(matches: DataFrame, n: int = 5, k: int | None = None) -> DataFrame:
    """Borda count per image: a match at rank r adds k - r + 1; k defaults to the deepest rank."""
    pairs = _seen(matches, votes=F.count(F.lit(1)), ranks=F.sum("rank"), deepest=F.max("rank"))
    if k is None:
        pairs = cut_lineage(pairs)
        depth = pairs.agg(F.max("deepest")).scalar()
    else:
        depth = F.lit(k)
    return _by_score(pairs.withColumn("score", F.col("votes") * (depth + 1) - F.col("ranks")), n)


def average_rank_images(matches: DataFrame, n: int = 5) -> DataFrame:
    scores = _seen(matches, score=F.avg("rank"))
    return _best(scores, n, F.round("score", 9).asc(), F.col("best_rank"), F.col("first_seg"), F.col("r_image"))


def weighted_borda_images(matches: DataFrame, n: int = 5, bounds: tuple | None = None) -> DataFrame:
    """Sum of globally normalised similarities per image: the default vote."""
    pairs, lo, hi = _pair_similarities(matches, bounds)
    score = (F.col("total") - F.col("votes") * lo) / F.nullif(hi - lo, F.lit(0.0))
    return _by_score(pairs.withColumn("score", score), n)


def average_similarity_images(matches: DataFrame, n: int = 5, bounds: tuple | None = None) -> DataFrame:
    pairs, lo, hi = _pair_similarities(matches, bounds)
    return _by_score(pairs.withColumn("score", minmax_between(F.col("total") / F.col("votes"), lo, hi)), n)


METHODS = {
    "max_sim": max_sim,
    "max_seg": max_seg,
    "max_seg_sim": max_seg_sim,
    "max_seg_topk": max_seg_topk,
    "max_seg_topk_borda": distinct_segments,
    "max_seg_topk_avg": distinct_segments,
    "max_seg_topk_wt_borda": distinct_segments,
    "max_seg_topk_avg_sim": distinct_segments,
    "max_seg_topk_borda_Im": borda_images,
    "max_seg_topk_avg_Im": average_rank_images,
    "max_seg_topk_wt_borda_Im": weighted_borda_images,
    "max_seg_topk_avg_sim_Im": average_similarity_images,
}

OLD_METHODS = ("max_sim", "max_seg", "max_seg_sim")


def get_matches(matches: DataFrame, n: int = 5, method: str = "max_seg_topk_wt_borda_Im", **kwargs) -> DataFrame:
    """``(q_image, rank, r_image, score)`` by the named vote."""
    if method not in METHODS:
        raise ValueError(f"unknown vote method: {method}")
    return METHODS[method](matches, n, **kwargs)


def get_matches_old(matches: DataFrame, n: int = 5, method: str = "max_sim") -> DataFrame:
    """The earlier three-method form."""
    if method not in OLD_METHODS:
        raise ValueError(f"unknown vote method: {method}")
    return get_matches(matches, n, method)


def first_k_unique(df: DataFrame, keys: list[str], item: str, order: str, k: int, score: Column | None = None) -> DataFrame:
    """First ``k`` distinct items per group in list order."""
    aggs = [F.min(order).alias("_first")] + ([score.alias("score")] if score is not None else [])
    firsts = df.groupBy(*keys, item).agg(*aggs)
    return top_per_group(firsts, keys, [F.col("_first")], k, "rank").drop("_first")


def match_pairs(matches: DataFrame, top: int = 50) -> DataFrame:
    """Matched segments of every (query, reference) image pair, most similar first."""
    order = [F.round("sim", 9).desc(), F.col("q_seg"), F.col("r_seg")]
    return top_per_group(matches, PAIR, order, top, "pos")


def match_one_pair(matches: DataFrame, q_image: int, r_image: int, top: int = 50) -> DataFrame:
    """The same for one image pair; the filter reaches the scan."""
    return match_pairs(matches.where((F.col("q_image") == q_image) & (F.col("r_image") == r_image)), top)


def match_info(matches: DataFrame, n: int = 5) -> DataFrame:
    """Nearest-neighbour votes behind each predicted image, one row per voting segment.

    Long form on purpose: a query with very many segments stays many rows. Use
    ``results.match_records`` to nest it for export.
    """
    predicted = max_seg(matches, n).withColumnRenamed("rank", "r_rank").withColumnRenamed("score", "votes")
    voting = matches.where("rank = 1").select("q_image", "r_image", "q_seg", "r_seg", "sim")
    return predicted.join(voting, PAIR)
