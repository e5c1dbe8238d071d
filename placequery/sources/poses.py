"""Text pose files: rotation rows and camera position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: rotation matrix on lines 4-6 (from 0), position on the
# second-last line, fields separated by spaces.
ROTATION_LINE = 4


def read_pose_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``path`` and whole ``value``."""
    return spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))


def _numbers(line: Column) -> Column:
    return F.transform(F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))


def parse_camera_poses(files: DataFrame, text: str = "value") -> DataFrame:
    """Position x, y, z and extrinsic zyx Euler angles a, b, c in degrees."""
    lines = F.split(F.regexp_replace(F.col(text), r"\n$", ""), "\n")
    parsed = files.withColumn("_l", lines)
    parsed = parsed.withColumns({
        "_p": _numbers(F.element_at("_l", -2)),
        **{f"_r{i}": _numbers(F.get(F.col("_l"), ROTATION_LINE + i)) for i in range(3)},
    })

    def r(i: int, j: int) -> Column:
        return F.get(F.col(f"_r{i}"), j)

    clipped = F.least(F.greatest(r(0, 2), F.lit(-1.0)), F.lit(1.0))
    return parsed.withColumns({
        "x": F.get("_p", 0), "y": F.get("_p", 1), "z": F.get("_p", 2),
        "a": F.degrees(F.atan2(-r(0, 1), r(0, 0))), "b": F.degrees(F.asin(clipped)), "c": F.degrees(F.atan2(-r(1, 2), r(2, 2))),
    }).drop("_l", "_p", "_r0", "_r1", "_r2")
