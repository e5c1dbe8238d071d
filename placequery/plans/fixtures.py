"""The retrieval tables, derived from the driver's tables with Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import doubles, mean_vectors, sum_vectors


class Fixtures:
    """Lazy derivations; every method returns a fresh plan over the parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- descriptors -------------------------------------------------------
    def patches(self) -> DataFrame:
        """One row per patch on a 2 x 5 grid, ten patches per image."""
        e = self.table("embeddings")
        image = F.expr("vec_id div 10")
        patch = F.col("vec_id") % 10
        return e.select(
            "vec_id",
            image.alias("image_id"),
            patch.cast("int").alias("patch_id"),
            F.floor(patch / 5).cast("int").alias("py"),
            (patch % 5).cast("int").alias("px"),
            doubles("embedding").alias("embedding"),
            "label",
            F.when(image % 5 == 0, "query").otherwise("ref").alias("role"),
        )

    def patch_list(self) -> DataFrame:
        """Patches without their vectors; column pruning keeps the vectors unread."""
        return self.patches().drop("embedding")

    def segment_patches(self) -> DataFrame:
        """Segment s covers columns s and s+1 (mod 5); every seventh image is small."""
        p = self.patch_list()
        segs = F.explode(F.array(F.col("px"), (F.col("px") + 4) % 5))
        return p.select("image_id", segs.alias("seg_id"), "patch_id").where(
            (F.col("image_id") % 7 != 3) | (F.col("seg_id") <= 2)
        )

    def segments(self) -> DataFrame:
        joined = self.segment_patches().join(
            self.patches().select("image_id", "patch_id", F.col("embedding")[0].alias("e1"), F.col("embedding")[1].alias("e2")),
            ["image_id", "patch_id"],
        )
        return joined.groupBy("image_id", "seg_id").agg(
            F.count(F.lit(1)).alias("n_patch"),
            (F.avg("e1") * 1000).alias("cx"),
            (F.avg("e2") * 1000).alias("cy"),
        )

    def vocabulary(self) -> DataFrame:
        return (
            self.patches().where("role = 'ref'")
            .groupBy(F.col("label").alias("cluster"))
            .agg(mean_vectors(F.col("embedding")).alias("centroid"))
        )

    def segment_vectors(self) -> DataFrame:
        """Plain (unnormalised) sum of the patches of a segment, as a search descriptor."""
        return (
            self.segment_patches().join(self.patches(), ["image_id", "patch_id"])
            .groupBy("image_id", "seg_id", "role")
            .agg(sum_vectors(F.col("embedding")).alias("vec"))
        )

    # -- poses -------------------------------------------------------------
    def poses(self) -> DataFrame:
        e = F.col("embedding")
        scales = {"x": (0, 250), "y": (1, 250), "z": (2, 250), "a": (3, 180), "b": (4, 180), "c": (5, 180)}
        return self.patches().groupBy("image_id", "role").agg(
            *[(F.avg(e[i]) * k).alias(n) for n, (i, k) in scales.items()]
        )

    def images(self) -> DataFrame:
        return self.patch_list().select("image_id", "role").distinct()

    def paths(self) -> DataFrame:
        return self.poses().select(
            "image_id", "role",
            F.concat(
                F.lit("db/@"), F.round("x", 3).cast("decimal(18,3)").cast("string"),
                F.lit("@"), F.round("y", 3).cast("decimal(18,3)").cast("string"),
                F.lit("@"), F.col("image_id").cast("string"), F.lit(".jpg"),
            ).alias("path"),
        )

    def manifest(self) -> DataFrame:
        city = F.when(F.col("image_id") % 2 == 0, "cph").otherwise("sf")
        return self.images().select(
            "image_id", "role", city.alias("city"),
            F.concat(
                F.lit("train_val/"), city, F.lit("/"), F.col("role"),
                F.lit("/images/img"), F.col("image_id").cast("string"), F.lit(".jpg"),
            ).alias("path"),
        )

    # -- masks -------------------------------------------------------------
    def pixel_masks(self) -> DataFrame:
        """8 x 8 value grid per vector; a pixel is on where the value is positive."""
        return self.patches().select(
            "image_id", F.col("patch_id").alias("seg_id"), F.lit(8).alias("h"), F.lit(8).alias("w"),
            F.col("embedding").alias("grid"),
        )

    def boxes(self) -> DataFrame:
        li = self.table("lineitem")
        x0, y0 = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 40).cast("double")
        side = F.lit(20.0) + F.col("l_quantity")
        flag = F.col("l_returnflag")
        return li.select(
            # Line numbers repeat within an order; part and supplier make the id unique.
            F.col("l_orderkey").alias("image_id"),
            (F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("seg_id"),
            x0.alias("x0"), y0.alias("y0"), (x0 + side).alias("x1"), (y0 + side).alias("y1"),
            (side * side).alias("area"),
            (F.lit(0.80) + 2 * F.col("l_discount")).alias("predicted_iou"),
            (F.lit(0.91) + F.col("l_tax")).alias("stability_score"),
            F.when(flag == "A", 0.0).when(flag == "N", 10.0).otherwise(20.0).alias("crop_x0"),
            F.when(flag == "A", 0.0).when(flag == "N", 10.0).otherwise(20.0).alias("crop_y0"),
            F.when(flag == "A", 100.0).when(flag == "N", 80.0).otherwise(120.0).alias("crop_x1"),
            F.when(flag == "A", 100.0).when(flag == "N", 90.0).otherwise(120.0).alias("crop_y1"),
        )

    # -- places ------------------------------------------------------------
    def places(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("place_id"), F.col("event_id").alias("image_id"),
            F.col("event_type").alias("city_id"), F.year("ts").cast("long").alias("year"),
            F.month("ts").cast("long").alias("month"), (F.col("event_id") % 360).alias("northdeg"),
            F.col("value").alias("lat"), (F.col("value") / 2).alias("lon"),
            F.concat(F.lit("pano"), F.col("event_id").cast("string")).alias("panoid"),
        )
