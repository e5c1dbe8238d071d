"""Principal components of data with few, wide rows, and projection by models of any size.

Vectors are cut into slices of their dimensions. The Gram matrix of the rows is a sum over slices,
and so is the product of vectors with axes; neither the rows nor the axes ever have to fit one task
whole. A model stays a table (see ``reduce``) that is never fetched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import BLOCK_BYTES, group_blocks, map_block_rows, scalar_matrix
from ..functions.storage import cut_lineage
from ..functions.vectors import doubles, l2_normalize, let, sum_vectors


def _slices(v: Column, side: int) -> Column:
    """Consecutive slices of at most ``side`` entries."""
    count = F.ceil(F.size(v) / F.lit(side)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda d: F.slice(v, d * side + 1, F.lit(side)))


def _joined_slices(parts: DataFrame, keys: list[str], slot: str, part: str, out: str) -> DataFrame:
    """Slices of a row put together again in the order of ``slot``."""
    found = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(slot).alias("s"), F.col(part).alias("p")))).alias("_all"))
    return found.select(*keys, F.flatten(F.col("_all.p")).alias(out))


def _row_blocks(df: DataFrame, vec: str, side: int) -> DataFrame:
    """One block per slice with that slice of every row, rows in the same order in all blocks."""
    rows = cut_lineage(df.select(doubles(vec).alias("_v")).withColumn("_row", F.monotonically_increasing_id()))
    parts = rows.select("_row", F.posexplode(_slices(F.col("_v"), side)).alias("d", "_part"))
    packed = parts.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("_row", "_part"))).alias("_rows"))
    return packed.select("d", F.size("_rows").alias("n"), F.flatten(F.col("_rows._part")).alias("flat"))


def _centred(row: dict) -> tuple[np.ndarray, np.ndarray]:
    x = scalar_matrix(row["flat"], row["n"].as_py())
    mean = x.mean(axis=0)
    return mean, x - mean


def signed(axis: Column) -> Column:
    """Axis whose first entry of largest magnitude is positive."""
    def turn(a: Column) -> Column:
        peak = F.array_max(F.transform(a, lambda x: F.abs(x)))
        return let(peak, lambda p: F.when(
            F.get(F.filter(a, lambda x: F.abs(x) == p), F.lit(0)) < 0, F.transform(a, lambda x: -x)
        ).otherwise(a))

    return let(axis, turn)


def gram_axes(df: DataFrame, n: int, rows: int, vec: str = "vec") -> tuple[DataFrame, np.ndarray]:
    """(component, axis) table with the mean as component -1, and the variances of the ``n`` leading axes.

    For fewer rows than dimensions: eigenvectors of the rows x rows Gram matrix, turned into axes
    slice by slice. The driver holds that matrix only, so ``rows`` must be bounded by the caller.
    Variances at rounding level are returned as 0 and their axes left out.
    """
    side = max(1, BLOCK_BYTES // (8 * max(1, rows)))
    blocks = cut_lineage(_row_blocks(df, vec, side))

    def gram(row):
        _, x = _centred(row)
        return [np.arange(len(x), dtype=np.int32), x @ x.T]

    parts = map_block_rows(blocks, gram, "i INT, g ARRAY<DOUBLE>", [])
    total = np.array([r["g"] for r in sorted(parts.groupBy("i").agg(sum_vectors(F.col("g")).alias("g")).collect())])
    values, vectors = np.linalg.eigh(total)
    values, vectors = values[::-1][:n], vectors[:, ::-1][:, :n]
    real = values > noise(values, rows)
    weights = (vectors[:, real] / np.sqrt(values[real])).T

    def axes(row):
        mean, x = _centred(row)
        return [np.arange(-1, len(weights), dtype=np.int32), np.vstack([mean, weights @ x])]

    found = _joined_slices(map_block_rows(blocks, axes, "component INT, part ARRAY<DOUBLE>", ["d"]), ["component"], "d", "part", "axis")
    table = found.withColumn("axis", F.when(F.col("component") < 0, F.col("axis")).otherwise(signed(F.col("axis"))))
    return table, np.where(real, values, 0) / (rows - 1)


# Rows of a block whose products with another block are held at once.
PRODUCT_ROWS = 1024


def inner_products(df: DataFrame, row_id: str, vec: str, width: int) -> DataFrame:
    """``(a, b, product)`` of all rows ``a <= b`` with unique ids, as products of blocks.

    Every pair is made once, in the task that meets its two blocks; only blocks are shuffled.
    """
    rows = max(1, min(PRODUCT_ROWS, BLOCK_BYTES // (8 * max(1, width))))
    blocks = cut_lineage(group_blocks(df.where(F.col(row_id).isNotNull()), [], row_id, vec, rows=rows, any_ids=True))
    # One number per block.
    others = F.broadcast(blocks.select(F.col("chunk").alias("r_chunk")))
    right = blocks.select(F.col("chunk").alias("r_chunk"), F.col("ids").alias("r_ids"), F.col("flat").alias("r_flat"))
    pairs = blocks.join(others, F.col("chunk") <= F.col("r_chunk")).join(right, "r_chunk")

    def multiply(row):
        a, b = (np.asarray(row[c].values) for c in ("ids", "r_ids"))
        product = scalar_matrix(row["flat"], len(a)) @ scalar_matrix(row["r_flat"], len(b)).T
        x, y = np.nonzero(a[:, None] <= b[None, :])
        return [a[x], b[y], product[x, y]]

    return map_block_rows(pairs.drop("chunk", "r_chunk"), multiply, "a BIGINT, b BIGINT, product DOUBLE", [])


def noise(values: np.ndarray, size: int) -> float:
    """Eigenvalues up to this are rounding."""
    return float(max(values.max(initial=0), 0) * size * np.finfo(float).eps * 8)


def project_blocks(df: DataFrame, table: DataFrame, keys: list[str], vec: str, out: str, side: int | None = None) -> DataFrame:
    """Add ``out``, ``(x - mean) . axes / sqrt(variance)``, from products of blocks that Spark sums.

    ``keys`` are integers that identify a row. Vectors are cut into slices and packed into blocks,
    axes into tiles of ``side`` components and ``side`` dimensions; every block meets the tiles of
    its slice. Tiles are repeated over as many salts as the shuffle is wide, vectors never.
    """
    side = side or int((4 * BLOCK_BYTES / 8) ** 0.5)
    spark = df.sparkSession
    rows, width = df.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    if not rows:
        return df.withColumn(out, F.lit(None).cast("array<double>"))
    chunks = max(1, -(-rows * side * 8 // BLOCK_BYTES))
    salts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // -(-width // side)))
    ids = [F.col(k).cast("long").alias(k) for k in keys]
    parts = df.select(*ids, F.posexplode(_slices(doubles(vec), side)).alias("d", "_part")).withColumn("chunk", F.pmod(F.xxhash64(*keys), F.lit(chunks)))
    item = F.struct(*keys, F.col("_part").alias("p"))
    packed = parts.groupBy("chunk", "d").agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    blocks = packed.select("d", F.pmod("chunk", F.lit(salts)).alias("salt"), *[F.col(f"_rows.{k}").alias(f"{k}_ids") for k in keys], F.flatten(F.col("_rows.p")).alias("flat"))

    scale = F.when(F.col("variance") > 0, F.sqrt("variance")).otherwise(F.lit(1.0))
    scaled = F.when(F.col("component") < 0, doubles("axis")).otherwise(let(scale, lambda s: F.transform(doubles("axis"), lambda x: x / s)))
    cut = table.select("component", scaled.alias("_axis")).select("component", F.posexplode(_slices(F.col("_axis"), side)).alias("d", "_part"))
    mean = cut.where("component < 0").select("d", F.col("_part").alias("mean"))
    tile = cut.where("component >= 0").groupBy("d", F.floor(F.col("component") / F.lit(side)).cast("int").alias("c"))
    tiles = tile.agg(F.array_sort(F.collect_list(F.struct("component", "_part"))).alias("_axes")).join(mean, "d")
    tiles = tiles.select("d", "c", "mean", F.size("_axes").alias("k"), F.flatten(F.col("_axes._part")).alias("axes"))
    tiles = tiles.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))

    def kernel(row):
        x = scalar_matrix(row["flat"], len(row[f"{keys[0]}_ids"])) - np.asarray(row["mean"].values)
        return [*(np.asarray(row[f"{k}_ids"].values) for k in keys), x @ scalar_matrix(row["axes"], row["k"].as_py()).T]

    schema = ", ".join(f"{k} BIGINT" for k in keys) + ", part ARRAY<DOUBLE>"
    products = map_block_rows(blocks.join(tiles, ["d", "salt"]), kernel, schema, ["c"])
    sums = products.groupBy(*keys, "c").agg(sum_vectors(F.col("part")).alias("part"))
    return df.join(_joined_slices(sums, keys, "c", "part", out), keys)


def apply_table(
    df: DataFrame, table: DataFrame, keys: list[str], vec: str = "vec", out: str = "reduced", normalize: bool = False, max_bytes: int | None = None
) -> DataFrame:
    """Project by a stored model of any size: fetched where it is small, else joined in blocks."""
    from . import reduce

    rows, width = table.agg(F.count(F.lit(1)), F.max(F.size("axis"))).first()
    if rows and rows * width * 8 <= (reduce.MAX_MODEL_BYTES if max_bytes is None else max_bytes):
        return reduce.apply_pca(df, reduce.load_model(table), vec, out, normalize)
    if table.where("component = -1").isEmpty():
        raise ValueError("the model has no mean row")
    found = project_blocks(df, table, keys, vec, out)
    return found.withColumn(out, l2_normalize(F.col(out))) if normalize else found
