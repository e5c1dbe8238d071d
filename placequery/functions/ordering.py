"""Dense positions and running totals without pulling a table into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import cut_lineage

# monotonically_increasing_id keeps the partition number above bit 33.
_ROW_BITS = 33
_SLOT = "_slot"


def _sorted_slots(df: DataFrame, order: list[Column]) -> DataFrame:
    """Range-sort and stamp each row with (partition, row) so both can be read back."""
    return cut_lineage(df.orderBy(*order).withColumn(_SLOT, F.monotonically_increasing_id()))


def _partition() -> Column:
    return F.shiftright(F.col(_SLOT), _ROW_BITS)


def dense_position(
    df: DataFrame, order: list[Column], out: str, keys: list[str] | None = None, start: int = 0
) -> DataFrame:
    """Number rows in a total order from ``start``, per group when ``keys`` are given.

    One distributed sort; only per-partition counts (and per-group first positions) are
    exchanged afterwards, so a group holding a third of all rows is no hot spot.
    """
    keys = keys or []
    slots = _sorted_slots(df, [F.col(k).asc() for k in keys] + order)
    counts = slots.groupBy(_partition().alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per sort partition: bounded by the shuffle width, never by the data.
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = (
        slots.withColumn("_part", _partition())
        .join(F.broadcast(offsets), "_part")
        .withColumn("_dense", F.col("_before") + F.col(_SLOT).bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    )
    if not keys:
        return placed.withColumn(out, F.col("_dense") + F.lit(start)).drop(_SLOT, "_part", "_before", "_dense")
    # First position of every group, looked up per (partition, group): a large group is
    # spread over its sort partitions here too. Null keys form a group of their own.
    spans = placed.groupBy("_part", *keys).agg(F.min("_dense").alias("_lo"))
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    first = spans.groupBy(*keys).agg(F.min("_lo").alias("_first")).select(*named, "_first")

    def same_group() -> Column:
        return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])

    starts = spans.join(first, same_group()).select(F.col("_part").alias("_p"), *named, "_first")
    return (
        placed.join(starts, (F.col("_part") == F.col("_p")) & same_group())
        .withColumn(out, F.col("_dense") - F.col("_first") + F.lit(start))
        .select(*[c for c in df.columns if c != out], out)
    )


def running_total(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """Inclusive running sum over the whole table in a total order."""
    slots = _sorted_slots(df, order).withColumn("_part", _partition())
    totals = slots.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, 0)
    return (
        slots.withColumn("_in", F.sum(value).over(inside))
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_before") + F.col("_in"))
        .drop(_SLOT, "_part", "_in", "_before")
    )


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str) -> DataFrame:
    """First ``k`` rows per group, ranked from 1.

    Spark trims each group map-side (WindowGroupLimit), so at most k rows per group and
    map task are shuffled.
    """
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
        F.col(out) <= k
    )
