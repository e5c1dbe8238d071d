"""Ground-truth pairs ``(q_image, r_image)`` for the supported benchmark families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import dense_position
from ..sources.paths import natural_key, with_path_coords
from .spatial import radius_angle_join, radius_join


def index_band_join(queries: DataFrame, refs: DataFrame, width: int = 15) -> DataFrame:
    """References whose position is within ``width`` of the query position (T16)."""
    band = queries.select(
        F.col("image_id").alias("q_image"),
        F.explode(F.sequence(F.col("pos") - width, F.col("pos") + width)).alias("pos"),
    )
    return band.join(refs.select(F.col("image_id").alias("r_image"), "pos"), "pos").select("q_image", "r_image")


def identity_join(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """The i-th query shows the place of the i-th reference."""
    q = queries.select(F.col("image_id").alias("q_image"), "pos")
    return q.join(refs.select(F.col("image_id").alias("r_image"), "pos"), "pos").select("q_image", "r_image")


def listed_ground_truth(lists: DataFrame, refs: DataFrame) -> DataFrame:
    """Lists of reference positions per query; positions without an image drop out."""
    pairs = lists.select("q_image", F.explode("ref_positions").alias("pos"))
    return pairs.join(refs.select(F.col("image_id").alias("r_image"), "pos"), "pos").select("q_image", "r_image")


def remap_ground_truth(pairs: DataFrame, queries: DataFrame, refs: DataFrame) -> DataFrame:
    """Renumber both sides per city in natural name order; drop pairs across cities.

    ``queries`` and ``refs`` carry ``(image_id, city, path)``.
    """
    q = dense_position(queries, [natural_key("path"), F.col("image_id")], "q_pos", ["city"])
    r = dense_position(refs, [natural_key("path"), F.col("image_id")], "r_pos", ["city"])
    q = q.select(F.col("image_id").alias("q_image"), "city", "q_pos")
    r = r.select(F.col("image_id").alias("r_image"), F.col("city").alias("r_city"), "r_pos")
    return (
        pairs.join(q, "q_image").join(r, "r_image").where(F.col("city") == F.col("r_city"))
        .select("city", "q_pos", "r_pos")
    )


def subset_by_index(items: DataFrame, positions: DataFrame) -> DataFrame:
    """Items at the listed positions."""
    return items.join(positions.select("pos").distinct(), "pos", "left_semi")


# How each dataset defines a correct match.
RULES = {
    "baidu": ("angle", 10.0, 20.0),
    "pitts": ("radius", 25.0),
    "SFXL": ("radius", 25.0),
    "InsideOut": ("radius", 50.0),
    "17places": ("band", 15),
    "AmsterTime": ("identity",),
    "mslsSF": ("listed",),
    "mslsCPH": ("listed",),
    "VPAir": ("listed",),
}


def ground_truth(dataset: str, queries: DataFrame, refs: DataFrame, lists: DataFrame | None = None) -> DataFrame | None:
    """Pairs for ``dataset``; None for a dataset without ground truth.

    Radius rules read positions from the ``path`` column when x and y are not given.
    """
    rule = RULES.get(dataset)
    if rule is None:
        return None
    kind = rule[0]
    if kind == "radius":
        q, r = (df if "x" in df.columns else with_path_coords(df, "path") for df in (queries, refs))
        return radius_join(q, r, rule[1]).select("q_image", "r_image")
    if kind == "angle":
        return radius_angle_join(queries, refs, rule[1], rule[2]).select("q_image", "r_image")
    if kind == "band":
        return index_band_join(queries, refs, rule[1])
    if kind == "identity":
        return identity_join(queries, refs)
    if lists is None:
        raise ValueError(f"{dataset} needs its list of matches")
    return listed_ground_truth(lists, refs)
