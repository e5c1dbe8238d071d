"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of ``links`` (a, b); component is the smallest id reachable.

    Labels take the minimum over links, then jump to the label of their label, so the rounds grow
    with the logarithm of a component's diameter. Only labels are aggregated, map-side first; a
    node with a third of all links is split by the skew join. Links with a null end and loops count
    for nothing; without links the result is empty.
    """
    pairs = links.select("a", "b").where(F.col("a") != F.col("b"))
    edges = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("_n")).select("id", F.least("id", "_n").alias("component")))
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("_n"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("_was"), F.least("component", "_n").alias("component"))
        lower = stored(lower)
        jumped = lower.join(lower.select(F.col("id").alias("component"), F.col("component").alias("_next")), "component")
        after = stored(jumped.select("id", "_was", F.col("_next").alias("component")))
        for table in (labels, lower):
            discard(table)
        labels = after.select("id", "component")
        if after.where(F.col("_was") != F.col("component")).isEmpty():
            discard(edges)
            return labels
