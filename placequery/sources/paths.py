"""Names and paths as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import dense_position

# Width a digit run is padded to, so text order equals number order.
NUMBER_WIDTH = 20


def natural_key(col: str) -> Column:
    """Sort key in which ``img2`` comes before ``img10``.

    Text and digit runs alternate; numbers are zero-padded, text stays as it is.
    """
    runs = F.regexp_extract_all(F.col(col), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(
        F.transform(
            runs,
            lambda x: F.when(x.rlike(r"^\d+$") & (F.length(x) < NUMBER_WIDTH), F.lpad(x, NUMBER_WIDTH, "0")).otherwise(x),
        ),
        "",
    )


def image_index(names: DataFrame, col: str = "name", start: int = 0, end: int | None = None, step: int = 1) -> DataFrame:
    """Natural-sort names, take every ``step``-th in [start, end), number them from 0."""
    placed = dense_position(names, [natural_key(col), F.col(col)], "_pos")
    kept = placed.where((F.col("_pos") >= start) & ((F.col("_pos") - start) % step == 0))
    if end is not None:
        kept = kept.where(F.col("_pos") < end)
    return kept.withColumn("image_pos", F.floor((F.col("_pos") - start) / step).cast("long")).drop("_pos")


def with_path_coords(df: DataFrame, path: str = "path") -> DataFrame:
    """Easting and northing from fields 1 and 2 of an ``@``-separated name, else NULL."""
    parts = F.split(F.col(path), "@")
    return df.withColumn("x", F.get(parts, 1).try_cast("double")).withColumn("y", F.get(parts, 2).try_cast("double"))


def path_tail(path: Column, parts: int = 1) -> Column:
    return F.substring_index(path, "/", -parts)


def basename(path: Column) -> Column:
    return path_tail(path, 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def method_name(path: Column) -> Column:
    """``<folder>_<file prefix>`` of a stored prediction file."""
    folder = F.element_at(F.split(path, "/"), -2)
    return F.concat(folder, F.lit("_"), F.split_part(basename(path), F.lit("_predictions.npz"), F.lit(1)))


def place_image_name() -> Column:
    """City, place, date, heading, position and panorama id, zero-padded 7/4/2/3."""
    def padded(c: Column, width: int) -> Column:
        text = c.cast("string")
        return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))

    return F.concat(
        F.concat_ws(
            "_", "city_id", padded(F.pmod(F.col("place_id"), F.lit(100000)), 7), padded(F.col("year"), 4),
            padded(F.col("month"), 2), padded(F.col("northdeg"), 3),
            F.col("lat").cast("string"), F.col("lon").cast("string"), "panoid",
        ),
        F.lit(".jpg"),
    )
