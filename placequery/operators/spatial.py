"""Radius joins over positions, rewritten as grid-cell equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import top_per_group
from ..functions.skew import salted_join
from ..functions.storage import cut_lineage

ANGLES = ("a", "b", "c")


def _cell(axis: str, radius: float) -> Column:
    return F.floor(F.col(axis) / F.lit(float(radius))).cast("long")


def _with_neighbour_cells(df: DataFrame, axes: list[str], radius: float) -> DataFrame:
    for axis in axes:
        here = _cell(axis, radius)
        df = df.withColumn(f"_c{axis}", F.explode(F.array(here - 1, here, here + 1)))
    return df


def radius_join(
    queries: DataFrame,
    refs: DataFrame,
    radius: float,
    axes: tuple[str, ...] = ("x", "y"),
    carry: tuple[str, ...] = (),
    most: str | None = None,
) -> DataFrame:
    """``(q_image, r_image, dist)`` for reference positions within ``radius`` (inclusive).

    A reference is stored once, in its own cell; a query visits the 3^d cells around it.
    The exact distance test is part of the join, so candidates that fail are never
    produced, and crowded cells are split over several tasks. ``most`` names a column of
    ``queries`` with a query's own, smaller radius; where it is null, ``radius`` holds.
    """
    axes = list(axes)
    width = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [F.col(most).alias("_most")] if most else []
    q = queries.select(F.col("image_id").alias("q_image"), *[F.col(c).cast("double").alias(f"q_{c}") for c in [*axes, *carry]],
                       *[F.col(c).cast("double").alias(c) for c in axes], *own)
    # Positions are few bytes but make many pairs: spread by number, or they would be put in one task.
    q = _with_neighbour_cells(q.repartition(width, "q_image"), axes, radius).drop(*axes)
    r = refs.select(F.col("image_id").alias("r_image"), *[F.col(c).cast("double").alias(f"r_{c}") for c in [*axes, *carry]],
                    *[_cell(c, radius).alias(f"_c{c}") for c in axes]).repartition(width, "r_image")
    sq = reduce(lambda s, c: s + c, [(F.col(f"q_{c}") - F.col(f"r_{c}")) * (F.col(f"q_{c}") - F.col(f"r_{c}")) for c in axes])
    close = sq <= F.lit(float(radius) ** 2)
    if most:
        close = close & (F.col("_most").isNull() | (F.sqrt(sq) <= F.col("_most")))
    joined = salted_join(q, r, [f"_c{c}" for c in axes], close)
    return joined.select("q_image", "r_image", F.sqrt(sq).alias("dist"), *[f"{s}_{c}" for c in carry for s in "qr"])


def nearest_within(queries: DataFrame, refs: DataFrame, radius: float, k: int, out: str = "n") -> DataFrame:
    """First ``k`` references within ``radius`` of every query by distance and id, ranked from 1.

    The references are dealt into classes, of which the nearest of each is found by a plain
    minimum. The k-th of these minima bounds the distance of the k-th reference, so that only
    pairs up to it are ranked, and not all pairs within the radius.
    """
    queries, refs = cut_lineage(queries), cut_lineage(refs)
    dealt = radius_join(queries, refs, radius).groupBy("q_image", F.pmod(F.xxhash64("r_image"), F.lit(max(16, 4 * k))).alias("_class"))
    bounds = dealt.agg(F.min("dist").alias("_d")).groupBy("q_image").agg(F.get(F.array_sort(F.collect_list("_d")), F.lit(k - 1)).alias("_most"))
    bounded = queries.join(bounds, F.col("image_id").eqNullSafe(F.col("q_image")), "left").drop("q_image")
    return top_per_group(radius_join(bounded, refs, radius, most="_most"), ["q_image"], [F.col("dist"), F.col("r_image")], k, out)


def radius_angle_join(
    queries: DataFrame, refs: DataFrame, dist: float = 10.0, angle: float = 20.0, wrap: bool = False
) -> DataFrame:
    """3-D radius plus mean absolute Euler difference below ``angle`` degrees (T15)."""
    near = radius_join(queries, refs, dist, ("x", "y", "z"), ANGLES)

    def difference(c: str) -> Column:
        d = F.abs(F.col(f"q_{c}") - F.col(f"r_{c}"))
        return F.least(F.pmod(d, F.lit(360.0)), F.lit(360.0) - F.pmod(d, F.lit(360.0))) if wrap else d

    mean = reduce(lambda s, c: s + c, [difference(c) for c in ANGLES]) / len(ANGLES)
    return near.withColumn("angle", mean).where(F.col("angle") < angle).select("q_image", "r_image", "dist", "angle")


def radius_self_join(images: DataFrame, radius: float, angle: float | None = None) -> DataFrame:
    """Neighbours of each image among the same images, itself included."""
    if angle is None:
        return radius_join(images, images, radius, ("x", "y", "z"))
    return radius_angle_join(images, images, radius, angle)
