"""Session defaults for local runs; a cluster's own settings are left alone."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .functions.storage import shared_dir


def local_session(cpus: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("placequery")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark
