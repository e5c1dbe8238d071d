"""Repeatable sampling: every draw is an order of an arithmetic hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..functions.ordering import dense_position, running_total, top_per_group


def sample_segments(segments: DataFrame, key: str, max_segments: int | None, seed: int = 0) -> DataFrame:
    """int(n * ratio) segments per image, ratio = min(1, max / total).

    Images are taken in id order until the sample reaches ``max_segments``; the image
    that reaches it still counts in full. None keeps all segments.
    """
    if max_segments is None:
        return segments
    sizes = segments.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    total = segments.agg(F.count(F.lit(1))).scalar()
    ratio = F.least(F.lit(1.0), F.lit(float(max_segments)) / total)
    quota = sizes.withColumn("_take", F.floor(F.col("_n") * ratio).cast("long"))
    taken = running_total(quota, [F.col("image_id")], "_take", "_upto")
    open_images = taken.where((F.col("_upto") - F.col("_take") < max_segments) & (F.col("_take") > 0)).select("image_id", "_take")
    ranked = dense_position(
        segments.join(open_images, "image_id"), [draw(F.col(key), seed), F.col(key)], "_draw", ["image_id"]
    )
    return ranked.where(F.col("_draw") < F.col("_take")).drop("_draw", "_take")


def sample_for_vocabulary(
    patches: DataFrame, threshold: int | None, frac: float = 0.3, stride: int = 2, seed: int = 42
) -> DataFrame:
    """Above ``threshold`` images: a share of them and every second grid row and column.

    The branch is decided inside the plan by the image count, so nothing is collected. None
    keeps all patches.
    """
    if threshold is None:
        return patches
    images = patches.select("image_id").distinct()
    total = images.agg(F.count(F.lit(1))).scalar()
    ranked = dense_position(images, [draw(F.col("image_id"), seed), F.col("image_id")], "_draw")
    chosen = ranked.where((total <= threshold) | (F.col("_draw") < F.floor(total * F.lit(frac)))).select("image_id")
    on_grid = (total <= threshold) | ((F.col("py") % stride == 0) & (F.col("px") % stride == 0))
    return patches.join(chosen, "image_id", "left_semi").where(on_grid)


def sample_fixed(patches: DataFrame, key: str, n: int, per_image: int = 100, seed: int = 0, max_images: int | None = None) -> DataFrame:
    """ceil(n / per_image) images, ``per_image`` patches each, without replacement."""
    wanted = -(-n // per_image) if max_images is None else min(max_images, -(-n // per_image))
    images = patches.select("image_id").distinct()
    chosen = dense_position(images, [draw(F.col("image_id"), seed), F.col("image_id")], "_draw").where(F.col("_draw") < wanted)
    kept = patches.join(chosen.select("image_id"), "image_id", "left_semi")
    return top_per_group(kept, ["image_id"], [draw(F.col(key), seed), F.col(key)], per_image, "draw_rank")


def places_with_min_images(places: DataFrame, m: int) -> DataFrame:
    """Images of places shown at least ``m`` times."""
    enough = places.groupBy("place_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= m)
    return places.join(enough.select("place_id"), "place_id", "left_semi")


def images_per_place(places: DataFrame, k: int, how: str = "random", seed: int = 0) -> DataFrame:
    """k random images per place, or the k latest by (year, month, lat)."""
    if how == "random":
        order = [draw(F.col("image_id"), seed), F.col("image_id")]
    elif how == "latest":
        order = [F.col("year").desc(), F.col("month").desc(), F.col("lat").desc(), F.col("image_id")]
    else:
        raise ValueError(f"unknown choice: {how}")
    return top_per_group(places, ["place_id"], order, k, "pick")


def shuffle(places: DataFrame, seed: int = 0, group: str = "city_id") -> DataFrame:
    """Random order per city as an explicit ``ord`` column."""
    return dense_position(places, [draw(F.col("image_id"), seed), F.col("image_id")], "ord", [group])


def dataset_stats(places: DataFrame, batch_size: int = 100) -> DataFrame:
    """Cities, places, images and iterations per epoch as (data, value) rows."""
    row = places.agg(
        F.count_distinct("city_id").alias("cities"), F.count_distinct("place_id").alias("places"), F.count(F.lit(1)).alias("images")
    ).withColumn("iterations", F.floor(F.col("places") / batch_size).cast("long"))
    return row.unpivot([], ["cities", "places", "images", "iterations"], "data", "value")
