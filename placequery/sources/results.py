"""Persisted search results, nested records, submission lines and diagnostics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import dense_position

RECORD_SCHEMA = "ARRAY<STRUCT<seg_id_q: BIGINT, seg_id_r: BIGINT, img_id_r: BIGINT>>"

# The column names of the metadata file.
MASK_COLUMNS = [
    "id", "area", "bbox_x0", "bbox_y0", "bbox_w", "bbox_h", "point_input_x", "point_input_y",
    "predicted_iou", "stability_score", "crop_box_x0", "crop_box_y0", "crop_box_w", "crop_box_h",
]


def write_results(df: DataFrame, path: str, experiment: str, mode: str = "overwrite") -> None:
    """One folder per experiment; other experiments under ``path`` stay untouched."""
    writer = df.withColumn("experiment", F.lit(experiment)).write.mode(mode).partitionBy("experiment")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def read_results(spark: SparkSession, path: str, experiment: str) -> DataFrame:
    """The partition filter prunes all other experiments."""
    return spark.read.parquet(path).where(F.col("experiment") == experiment)


# Entries one stored record holds; longer lists continue in the next part.
PART_ENTRIES = 10_000


def match_records(info: DataFrame, gt: DataFrame, queries: DataFrame) -> DataFrame:
    """``(q_image, kind, part, payload)``: JSON lists per query.

    Kinds are ``gt`` (true references), ``img_id_r`` (predicted images by rank) and
    ``segments`` (what each voting segment matched). A list is cut into parts of
    ``PART_ENTRIES`` by position, so that no row holds an unbounded list and a long one is
    numbered in several tasks; part 0 is the first. ``info`` is the long form of
    ``vote.match_info``.
    """

    def parts(df: DataFrame, kind: str, entry) -> DataFrame:
        entries = dense_position(df.select("q_image", entry.alias("_x")).distinct(), [F.col("_x")], "_place", ["q_image"])
        parted = entries.withColumn("part", F.floor(F.col("_place") / PART_ENTRIES).cast("long"))
        listed = parted.groupBy("q_image", "part").agg(F.array_sort(F.collect_list("_x")).alias("_e"))
        payload = F.to_json("_e" if kind != "img_id_r" else F.col("_e.r_image"))
        return listed.select("q_image", F.lit(kind).alias("kind"), "part", payload.alias("payload"))

    truth = parts(gt, "gt", F.col("r_image"))
    without = queries.join(gt.select("q_image"), "q_image", "left_anti").select(
        "q_image", F.lit("gt").alias("kind"), F.lit(0).cast("long").alias("part"), F.lit("[]").alias("payload")
    )
    predicted = parts(info, "img_id_r", F.struct("r_rank", "r_image"))
    local = parts(info, "segments", F.struct(
        F.col("q_seg").alias("seg_id_q"), F.col("r_seg").alias("seg_id_r"), F.col("r_image").alias("img_id_r")
    ))
    return truth.unionByName(without).unionByName(predicted).unionByName(local)


def write_match_info(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").partitionBy("kind").parquet(path)


def read_match_info(spark: SparkSession, path: str) -> DataFrame:
    """Back to long form: one row per voting segment; other kinds are not read."""
    df = spark.read.parquet(path).where("kind = 'segments'")
    return df.select("q_image", F.explode(F.from_json("payload", RECORD_SCHEMA)).alias("_s")).select(
        "q_image", "_s.seg_id_q", "_s.seg_id_r", "_s.img_id_r"
    )


def submission_lines(predictions: DataFrame, q_names: DataFrame, r_names: DataFrame) -> DataFrame:
    """``<query stem> <predicted stems by rank>`` per query; names are ``(image, path)``."""
    from .paths import stem

    named = predictions.join(r_names.select("r_image", stem(F.col("path")).alias("_r")), "r_image")
    ordered = named.groupBy("q_image").agg(F.array_sort(F.collect_list(F.struct("rank", "_r"))).alias("_l"))
    # A query without predictions keeps its line.
    joined = q_names.join(ordered, "q_image", "left")
    return joined.select("q_image", F.concat_ws(" ", stem(F.col("path")), F.col("_l._r")).alias("line"))


def write_submission(lines: DataFrame, path: str) -> None:
    lines.sort("q_image").select("line").write.mode("overwrite").text(path)


def mask_metadata(masks: DataFrame) -> DataFrame:
    """Flat 14-column form of mask records with x0..y1 boxes."""
    return masks.select(
        "image_id", F.col("seg_id").alias("id"), "area",
        F.col("x0").alias("bbox_x0"), F.col("y0").alias("bbox_y0"),
        (F.col("x1") - F.col("x0")).alias("bbox_w"), (F.col("y1") - F.col("y0")).alias("bbox_h"),
        F.col("px").alias("point_input_x"), F.col("py").alias("point_input_y"),
        "predicted_iou", "stability_score",
        F.col("crop_x0").alias("crop_box_x0"), F.col("crop_y0").alias("crop_box_y0"),
        (F.col("crop_x1") - F.col("crop_x0")).alias("crop_box_w"), (F.col("crop_y1") - F.col("crop_y0")).alias("crop_box_h"),
    )


def write_mask_metadata(masks: DataFrame, path: str, form: str = "csv") -> None:
    """Flat CSV with header, or JSON lines (which keep run lengths when present)."""
    if form == "csv":
        mask_metadata(masks).write.mode("overwrite").option("header", True).csv(path)
    elif form == "json":
        masks.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown form: {form}")


def write_assignment_diagnostics(df: DataFrame, path: str) -> None:
    """Append the images that have no diagnostics yet."""
    append_missing(df, path, ["image_id"])


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def append_missing(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys are not stored under ``path``."""
    stored = _stored(df.sparkSession, path)
    if stored is not None:
        df = df.join(stored.select(*keys).distinct(), keys, "left_anti")
    df.write.mode("append").parquet(path)


def cached(keys: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, key: str = "cache_id") -> DataFrame:
    """Rows for ``keys`` from the store; only the missing ids are computed and added.

    Where nothing is missing, ``compute`` is not called.
    """
    spark = keys.sparkSession
    stored = _stored(spark, path)
    missing = keys if stored is None else keys.join(stored.select(key).distinct(), key, "left_anti")
    if stored is None or not missing.isEmpty():
        compute(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(keys.select(key).distinct(), key, "left_semi")


def cached_fields(
    keys: DataFrame, compute: dict[str, Callable[[DataFrame], DataFrame]], path: str, key: str = "cache_id"
) -> dict[str, DataFrame]:
    """Several fields of ``keys`` from one store, by name.

    A field has a folder of its own, so fields of different shapes live side by side, one that
    is added later is computed alone, and an interrupted call leaves only whole fields.
    """
    return {name: cached(keys, make, f"{path}/{name}", key) for name, make in compute.items()}


def write_comparison(compared: DataFrame, path: str) -> None:
    """``metrics.compare_methods`` as CSV with a header, sorted by baseline and query."""
    compared.sort("baseline", "query_index").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
