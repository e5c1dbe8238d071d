"""Queries that arrive as files are searched and voted against a static reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import reduce, search, vote

SEGMENTS = "q_image BIGINT, q_seg BIGINT, vec ARRAY<DOUBLE>"


def calibrate(matches: DataFrame) -> tuple[float, float]:
    """Similarity bounds of a calibration run, stored because a stream never ends (T4)."""
    row = matches.agg(F.min("sim"), F.max("sim")).first()
    return float(row[0]), float(row[1])


def read_query_segments(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SEGMENTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def retrieve_batch(
    queries: DataFrame, refs: DataFrame, bounds: tuple[float, float], k: int = 200, top: int = 50, n: int = 5,
    model: reduce.Model | None = None,
) -> DataFrame:
    """Project, search and vote one set of query segments.

    ``refs`` is ``(r_image, r_seg, vec)``, already projected when ``model`` is given.
    """
    if model is not None:
        queries = reduce.apply_pca(queries, model, "vec", "_r", normalize=True).withColumn("vec", F.col("_r")).drop("_r")
    found = search.knn_l2(queries, refs, k, q_ids=["q_image", "q_seg"], r_ids=["r_image", "r_seg"])
    return vote.weighted_borda_images(search.segment_matches(found, top), n, bounds)


def retrieve_stream(
    stream: DataFrame, refs: DataFrame, bounds: tuple[float, float], out_path: str, checkpoint: str,
    k: int = 200, top: int = 50, n: int = 5, model: reduce.Model | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Append the votes of every micro-batch to ``out_path``.

    All segments of an image must arrive in one file. Each batch writes its own
    ``batch_id`` folder in overwrite mode, so a batch replayed after a failure replaces
    its output instead of repeating it.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        voted = retrieve_batch(batch, refs, bounds, k, top, n, model)
        voted.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
