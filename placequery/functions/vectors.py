"""Vector arithmetic on ``ARRAY<DOUBLE>`` columns, all JVM-side."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(vec) -> Column:
    """Cast a float vector to double before any arithmetic."""
    return F.col(vec).cast("array<double>") if isinstance(vec, str) else vec.cast("array<double>")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A plain outer column used inside ``F.transform`` is recomputed per element; binding
    it as the element of a one-item array makes it a lambda variable instead.
    """
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def sq_l2(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(sq_l2(a, b))


def cosine(a: Column, b: Column) -> Column:
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def scale(a: Column, factor: Column) -> Column:
    return let(factor, lambda f: F.transform(a, lambda x: x * f))


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays zero (T14)."""
    return let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))


def similarity_from_sq_l2(sq_dist: Column) -> Column:
    """``2 - d^2``: twice the cosine for unit vectors."""
    return F.lit(2.0) - sq_dist


def sum_vectors(vec: Column) -> Column:
    """Element-wise sum as a grouped aggregate with map-side combine."""
    return vector_to_array(Summarizer.sum(array_to_vector(vec)))


def mean_vectors(vec: Column) -> Column:
    return vector_to_array(Summarizer.mean(array_to_vector(vec)))


def max_vectors(vec: Column) -> Column:
    return vector_to_array(Summarizer.max(array_to_vector(vec)))


def long_form(df: DataFrame, vec: str, dim: str = "dim", value: str = "value") -> DataFrame:
    """One row per vector entry, entries numbered from 0."""
    keep = [c for c in df.columns if c != vec]
    return df.select(*keep, F.posexplode(vec).alias(dim, value))


def minmax_global(df: DataFrame, value: str, out: str) -> DataFrame:
    """``(x - min) / (max - min)`` with bounds over the whole table (T4).

    The bounds are a one-row scalar subquery, so nothing is joined or shuffled.
    """
    bounds = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    return df.withColumn(out, minmax_between(F.col(value), bounds["lo"], bounds["hi"]))


def minmax_between(value: Column, lo: Column, hi: Column) -> Column:
    return (value - lo) / F.nullif(hi - lo, F.lit(0.0))


def minmax_grouped(df: DataFrame, value: str, out: str, keys: list[str]) -> DataFrame:
    """Min-max per group: partial aggregate, then a join back on the group key."""
    bounds = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return (
        df.join(bounds, keys)
        .withColumn(out, minmax_between(F.col(value), F.col("_lo"), F.col("_hi")))
        .drop("_lo", "_hi")
    )
