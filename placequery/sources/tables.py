"""Parquet, CSV and text tables with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import dense_position

PATCHES = (
    "image_id BIGINT, patch_id INT, py INT, px INT, embedding ARRAY<FLOAT>, dataset STRING, role STRING"
)
MASKS = (
    "image_id BIGINT, seg_id BIGINT, rle ARRAY<INT>, h INT, w INT, area BIGINT, "
    "bbox STRUCT<x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>, predicted_iou DOUBLE, stability_score DOUBLE, "
    "point ARRAY<DOUBLE>, crop_box STRUCT<x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>"
)
PLACES = (
    "place_id BIGINT, city_id STRING, panoid STRING, year BIGINT, month BIGINT, northdeg BIGINT, lat DOUBLE, lon DOUBLE"
)
# The column names of the match file.
MATCH_COLUMNS = [f"top_{i}_ref_ind" for i in range(1, 6)]


def write_patches(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by dataset and role, so a query-side read skips the references."""
    df.write.mode(mode).partitionBy("dataset", "role").parquet(path)


def read_patches(spark: SparkSession, path: str, rmin: int = 0, patch_rows: int = 14) -> DataFrame:
    """Patch rows; the first ``rmin`` pixel rows are dropped and rows renumbered."""
    df = spark.read.schema(PATCHES).parquet(path)
    skip = rmin // patch_rows
    return df.where(F.col("py") >= skip).withColumn("py", F.col("py") - skip) if skip else df


def explode_descriptor_map(maps: DataFrame, cells: str = "cells", width: str = "width") -> DataFrame:
    """Row-major descriptor map of an image to one row per patch with grid position."""
    keep = [c for c in maps.columns if c not in (cells, width)]
    long = maps.select(*keep, width, F.posexplode(cells).alias("patch_id", "embedding"))
    return long.select(
        *keep, "patch_id", F.floor(F.col("patch_id") / F.col(width)).cast("int").alias("py"),
        (F.col("patch_id") % F.col(width)).cast("int").alias("px"), "embedding",
    )


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MASKS).parquet(path)


def count_masks(masks: DataFrame, images: DataFrame) -> DataFrame:
    """Masks per listed image; images without any count 0."""
    counts = masks.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    return images.select("image_id").distinct().join(counts, "image_id", "left").select(
        "image_id", F.coalesce("n", F.lit(0)).alias("n_masks")
    )


def read_place_tables(spark: SparkSession, paths: list[str], schema: str = PLACES) -> DataFrame:
    """Per-city CSV tables under one id space: table i adds ``i * 100000`` to place_id.

    Each path is a file, or a folder of files; a pattern stands for its matches in order of name. All tables are read in one scan, and
    a row's table is looked up by the path of its file, so the plan does not grow with their number. A path listed
    twice gives its rows under both numbers, a path that matches nothing is an error.
    """
    tables = [(at, i) for i, at in enumerate(at for path in paths for at in _matching(spark, path))]
    if not tables:
        raise ValueError("no place tables")
    # As long as the caller's list of tables, which is on the driver already.
    listed = F.broadcast(spark.createDataFrame(tables, "_at string, _table long"))
    rows = spark.read.schema(schema).option("header", True).csv(sorted({at for at, _ in tables}))
    columns = rows.columns
    rows = rows.withColumn("_file", _plain_path(F.col("_metadata.file_path"))).withColumn("_folder", F.regexp_replace("_file", "/[^/]*$", ""))
    # A row belongs to the table of its file, or else to that of its folder.
    by_file = listed.select(F.col("_at").alias("_file"), F.col("_table").alias("_of_file"))
    by_folder = listed.select(F.col("_at").alias("_folder"), F.col("_table").alias("_of_folder"))
    unknown = F.raise_error(F.concat(F.lit("no table for "), F.col("_file"))).cast("long")
    found = rows.join(by_file, "_file", "left").join(by_folder, "_folder", "left")
    number = F.coalesce("_of_file", "_of_folder", unknown)
    return found.withColumn("place_id", F.col("place_id") + number * 100000).select(*columns)


def _matching(spark: SparkSession, path: str) -> list[str]:
    """Full paths that a path or pattern stands for, in order of name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at)
    if not found:
        raise FileNotFoundError(path)
    return sorted(status.getPath().toString() for status in found)


def _plain_path(uri: Column) -> Column:
    """A file path as Hadoop writes it, without percent signs for characters of names."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "file:/")


def prefix_place_ids(df: DataFrame, cities: DataFrame) -> DataFrame:
    """The same for one table holding every city: ``cities`` is ``(city_id, ordinal)``."""
    return df.join(cities, "city_id").withColumn("place_id", F.col("place_id") + F.col("ordinal") * 100000).drop("ordinal")


def read_match_table(df: DataFrame, query: str = "query_ind") -> DataFrame:
    """Wide ``top_1_ref_ind … top_5_ref_ind`` ground truth to pair rows."""
    long = df.unpivot([query], MATCH_COLUMNS, "place", "r_image")
    return long.where(F.col("r_image").isNotNull()).select(F.col(query).alias("q_image"), "r_image")


def union_roles(refs: DataFrame, queries: DataFrame, order: list[Column]) -> DataFrame:
    """References, then queries, in one table with ``role`` and position."""
    both = refs.withColumn("role", F.lit("ref")).withColumn("_side", F.lit(0)).unionByName(
        queries.withColumn("role", F.lit("query")).withColumn("_side", F.lit(1))
    )
    return dense_position(both, [F.col("_side"), *order], "pos").drop("_side")


def concat_batches(batches: list[DataFrame]) -> DataFrame:
    """Append batches of mask rows; a field missing from one batch is NULL there."""
    out = batches[0]
    for batch in batches[1:]:
        out = out.unionByName(batch, allowMissingColumns=True)
    return out


def select_manifest(files: DataFrame, names: DataFrame, city: str | None = None) -> DataFrame:
    """Files whose base name is listed and whose path names the city."""
    from .paths import basename

    kept = files if city is None else files.where(F.col("path").contains(f"/{city}/"))
    return kept.withColumn("name", basename(F.col("path"))).join(names.select("name").distinct(), "name", "left_semi").drop("name")


def verify_counts(files: DataFrame, expected: DataFrame) -> DataFrame:
    """File counts by city and role against expected counts."""
    found = files.groupBy("city", "role").agg(F.count(F.lit(1)).alias("n_found"))
    return found.join(expected, ["city", "role"], "full_outer").select(
        "city", "role", F.coalesce("n_found", F.lit(0)).alias("n_found"),
        F.coalesce("n_expected", F.lit(0)).alias("n_expected"),
    ).withColumn("matches", F.col("n_found") == F.col("n_expected"))
