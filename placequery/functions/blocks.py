"""Rows packed into matrix blocks so that tasks can use matrix products.

A block row carries its ids as one array per id column (``<id>_ids``) and its vectors as
one flat array (``flat``). Blocks are bounded in bytes, so a key with any number of rows
becomes many blocks rather than one large group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import dense_position

BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 2048


def list_matrix(array: pa.Array) -> np.ndarray:
    """Arrow list column of equal-length vectors to an [n, d] float64 matrix."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    n = len(array)
    flat = np.asarray(array.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def scalar_matrix(value: pa.ListScalar, rows: int) -> np.ndarray:
    return np.asarray(value.values.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(rows, -1)


def matrix_lists(matrix: np.ndarray) -> pa.Array:
    """[n, d] matrix to an Arrow list<double> column without a Python loop."""
    n, d = matrix.shape
    offsets = np.arange(0, (n + 1) * d, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def pack_rows(df: DataFrame, ids: list[str], vec: str, tag: str | None = None) -> DataFrame:
    """Cut each partition into blocks of at most ``BLOCK_BYTES``; nothing is shuffled.

    With ``tag``, rows of different tags go to different blocks.
    """
    out = T.StructType(
        ([T.StructField(tag, T.LongType())] if tag else [])
        + [T.StructField(f"{i}_ids", T.ArrayType(T.LongType())) for i in ids]
        + [T.StructField("flat", T.ArrayType(T.DoubleType()))]
    )
    cols = [*ids, vec] + ([tag] if tag else [])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = list_matrix(batch.column(len(ids)))
            keys = [np.asarray(batch.column(i)) for i in range(len(ids))]
            tags = np.asarray(batch.column(len(ids) + 1)) if tag else np.zeros(len(x), np.int64)
            rows = max(1, BLOCK_BYTES // (8 * max(1, x.shape[1])))
            for t in np.unique(tags):
                where = np.flatnonzero(tags == t)
                for start in range(0, len(where), rows):
                    take = where[start : start + rows]
                    data = ([pa.array([int(t)])] if tag else []) + [pa.array([k[take]]) for k in keys]
                    data.append(pa.array([x[take].ravel()]))
                    yield pa.RecordBatch.from_arrays(data, names=out.names)

    typed = df.select(*[F.col(i).cast("long").alias(i) for i in ids], F.col(vec).cast("array<double>").alias(vec),
                      *([F.col(tag).cast("long").alias(tag)] if tag else []))
    return typed.select(*cols).mapInArrow(pack, out)


def scattered(df: DataFrame, keys: list[str], row_id: str, rows: int) -> bool:
    """Whether cutting by ``row_id div rows`` would make far more blocks than the rows of some group need."""
    at = F.floor(F.col(row_id) / F.lit(rows))
    cut = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.approx_count_distinct(at).alias("_cuts"))
    return not cut.where(F.col("_cuts") > 2 * F.ceil(F.col("_n") / F.lit(rows)) + 1).limit(1).isEmpty()


def group_blocks(
    df: DataFrame, keys: list[str], row_id: str, vec: str, extra: list[str] | None = None, rows: int | None = None, any_ids: bool = False
) -> DataFrame:
    """Blocks per group, split by ``row_id div rows`` so that no block outgrows ``rows``.

    ``row_id`` must be unique inside a group. ``extra`` numeric columns come along as
    ``<name>_values`` arrays in the same order. With ``any_ids`` the ids are looked at first;
    where they lie far apart, rows are numbered inside their group (ids only, one sort) and
    cut by that number, so that blocks stay full.
    """
    extra, rows = extra or [], rows or BLOCK_ROWS
    at = F.col(row_id)
    if any_ids and scattered(df, keys, row_id, rows):
        numbered = dense_position(df.select(*keys, row_id), [F.col(row_id)], "_at", keys)
        df, at = df.join(numbered, [*keys, row_id]), F.col("_at")
    item = F.struct(F.col(row_id).cast("long").alias("id"), F.col(vec).alias("v"), *[F.col(c).cast("double").alias(c) for c in extra])
    packed = df.groupBy(*keys, F.floor(at / F.lit(rows)).cast("long").alias("chunk")).agg(
        F.array_sort(F.collect_list(item)).alias("_rows")
    )
    return packed.select(
        *keys, "chunk",
        F.col("_rows.id").alias("ids"), F.flatten(F.col("_rows.v")).alias("flat"),
        *[F.col(f"_rows.{c}").alias(f"{c}_values") for c in extra],
    )


def pair_blocks(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every left block with every right block of the same group.

    Left blocks are addressed to the chunks of their group first, so the join key is
    (group, chunk) and a many-chunk group spreads over many tasks.
    """
    chunks = right.groupBy(*keys).agg(F.collect_set("chunk").alias("_chunks"))
    addressed = left.join(chunks, keys).withColumn("r_chunk", F.explode("_chunks")).drop("_chunks")
    renamed = right.select(*keys, F.col("chunk").alias("r_chunk"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in (*keys, "chunk")])
    return addressed.join(renamed, [*keys, "r_chunk"])


def map_block_rows(df: DataFrame, kernel: Callable[[dict], list[tuple]], schema: str, keep: list[str]) -> DataFrame:
    """Apply ``kernel`` to each block row; it returns column arrays of equal length.

    The kept columns of the block row are repeated in front of every output row.
    """
    kept = T.StructType([df.schema[c] for c in keep])
    produced = T.StructType.fromDDL(schema)
    out = T.StructType(kept.fields + produced.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i] for j, n in enumerate(names)}
                cols = kernel(row)
                n = len(cols[0])
                if not n:
                    continue
                arrays = [pa.array([row[c].as_py()] * n, type=batch.schema.field(c).type) for c in keep]
                arrays += [matrix_lists(c) if isinstance(c, np.ndarray) and c.ndim == 2 else pa.array(c) for c in cols]
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return df.mapInArrow(run, out)


def map_vectors(df: DataFrame, vec: str, kernel: Callable[[np.ndarray], list[np.ndarray]], schema: str) -> DataFrame:
    """Append columns computed from the vector column, one Arrow batch at a time.

    ``kernel`` maps an [n, d] matrix to one array per column of ``schema`` (2-D arrays
    become list columns). Rows stay where they are.
    """
    produced = T.StructType.fromDDL(schema).fields
    out = T.StructType(df.schema.fields + produced)
    position = df.columns.index(vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = kernel(list_matrix(batch.column(position)))
            arrays = list(batch.columns) + [matrix_lists(c) if c.ndim == 2 else pa.array(c) for c in cols]
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return df.mapInArrow(run, out)
