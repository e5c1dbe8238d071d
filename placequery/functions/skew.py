"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut_lineage

# Rows of one key that one task meets from each side.
SPLIT_ROWS = 20_000
# Heavy-key lists up to this many rows are broadcast; longer ones are joined by shuffle.
BROADCAST_KEYS = 100_000


def _counts(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], condition: Column | None = None,
    split_rows: int | None = None, self_join: bool = False,
) -> DataFrame:
    """Inner join on ``keys`` with heavy keys cut into pieces on both sides.

    Key sizes are counted first (key columns only, combined map-side). A key with more than
    split_rows rows on either side is divided: each side's rows get one of ceil(n / split_rows)
    salts and are repeated over the other side's salts, so no task meets more than about
    split_rows rows of a key from either side. Without heavy keys this is a plain join.
    ``self_join`` says that both sides hold the same rows, which then are counted once.
    """
    split = split_rows or SPLIT_ROWS

    def plain() -> DataFrame:
        joined = left.join(right, keys)
        return joined if condition is None else joined.where(condition)

    def largest(df: DataFrame) -> int:
        return _counts(df, keys, "_n").agg(F.max("_n")).first()[0] or 0

    if largest(right) <= split and (self_join or largest(left) <= split):
        return plain()
    sizes = _counts(left, keys, "_nl").join(_counts(right, keys, "_nr"), keys)
    heavy = cut_lineage(
        sizes.where(F.greatest("_nl", "_nr") > split).select(
            *keys, F.ceil(F.col("_nl") / F.lit(split)).alias("_pl"), F.ceil(F.col("_nr") / F.lit(split)).alias("_pr")
        )
    )
    n_heavy = heavy.limit(BROADCAST_KEYS + 1).count()
    if n_heavy == 0:
        return plain()
    listed = F.broadcast(heavy) if n_heavy <= BROADCAST_KEYS else heavy

    def salted(df: DataFrame, own: str, other: str, own_salt: str, other_salt: str) -> DataFrame:
        pieces = [F.coalesce(F.col(c), F.lit(1)) for c in (own, other)]
        return (
            df.join(listed, keys, "left")
            .withColumn(own_salt, F.pmod(F.xxhash64(*df.columns), pieces[0]))
            .withColumn(other_salt, F.explode(F.sequence(F.lit(0).cast("bigint"), pieces[1] - 1)))
            .drop("_pl", "_pr")
        )

    joined = salted(left, "_pl", "_pr", "_sl", "_sr").join(salted(right, "_pr", "_pl", "_sr", "_sl"), [*keys, "_sl", "_sr"])
    return (joined if condition is None else joined.where(condition)).drop("_sl", "_sr")
