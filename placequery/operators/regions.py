"""Filling small holes and dropping small islands in masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .masks import mask_box
from .suppression import nms_boxes


def _runs(rle: np.ndarray, h: int, on: bool) -> np.ndarray:
    """Vertical runs (x, y0, y1) of the on (or off) pixels of one mask, column order."""
    ends = np.cumsum(rle)
    starts = ends - rle
    pick = np.arange(len(rle)) % 2 == (1 if on else 0)
    out = []
    for s, e in zip(starts[pick & (rle > 0)], ends[pick & (rle > 0)]):
        for x in range(s // h, (e - 1) // h + 1):
            out.append((x, max(s - x * h, 0), min(e - x * h, h)))
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def _labels(runs: np.ndarray) -> np.ndarray:
    """Component of each run under 8-connectivity (runs touch in adjacent columns)."""
    parent = np.arange(len(runs))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(runs[:, 0], runs[:, 0] - 1)
    last = np.searchsorted(runs[:, 0], runs[:, 0])
    for i in range(len(runs)):
        before = np.arange(first[i], last[i])
        before = before[(runs[before, 0] == runs[i, 0] - 1) & (runs[before, 1] <= runs[i, 2]) & (runs[before, 2] >= runs[i, 1])]
        for j in before:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(runs))], dtype=np.int64)


def _to_rle(runs: np.ndarray, h: int, w: int) -> np.ndarray:
    flat = np.zeros(h * w + 1, dtype=np.int8)
    for x, y0, y1 in runs:
        flat[x * h + y0 : x * h + y1] = 1
    change = np.flatnonzero(np.diff(np.r_[0, flat[:-1]])) if h * w else np.array([], int)
    return np.diff(np.r_[0, change, h * w])


def clean_one(rle: np.ndarray, h: int, w: int, min_area: float, mode: str) -> tuple[np.ndarray, bool]:
    """One mask; the flag tells whether it changed."""
    holes = mode == "holes"
    runs = _runs(rle, h, on=not holes)
    if not len(runs):
        return rle, False
    labels = _labels(runs)
    size = np.bincount(labels, weights=runs[:, 2] - runs[:, 1], minlength=len(runs))
    small = size[labels] < min_area
    if not small.any():
        return rle, False
    if holes:
        return _to_rle(np.concatenate([_runs(rle, h, on=True), runs[small]]), h, w), True
    keep = ~small
    if not keep.any():
        # All are small: the largest stays, the first in reading order among equals.
        tied = np.unique(labels[size[labels] == size.max()])
        firsts = [min((int(r[1]), int(r[0])) for r in runs[labels == t]) for t in tied]
        keep = labels == tied[min(range(len(tied)), key=lambda i: firsts[i])]
    return _to_rle(runs[keep], h, w), True


def clean_masks(masks: DataFrame, min_area: float) -> DataFrame:
    """Holes, then islands, per mask row; adds ``unchanged``. Nothing is shuffled.

    A mask is one row of run lengths bounded by its frame, so this is map-only.
    """

    fields = [f for f in masks.schema.fields if f.name not in ("rle", "unchanged")]
    out = T.StructType(fields + [T.StructField("rle", T.ArrayType(T.IntegerType())), T.StructField("unchanged", T.BooleanType())])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            runs, unchanged = [], []
            for r, h, w in zip(column["rle"], column["h"].to_pylist(), column["w"].to_pylist()):
                r, filled = clean_one(np.asarray(r.values, dtype=np.int64), h, w, min_area, "holes")
                r, cut = clean_one(r, h, w, min_area, "islands")
                runs.append(r.astype(np.int32))
                unchanged.append(not (filled or cut))
            arrays = [column[f.name] for f in fields] + [pa.array(runs, pa.list_(pa.int32())), pa.array(unchanged, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return masks.mapInArrow(clean, out)


def clean_small_regions(masks: DataFrame, min_area: float, iou: float = 0.7) -> DataFrame:
    """Clean every mask, then suppress overlapping boxes, preferring unchanged masks."""
    from ..functions.storage import cut_lineage

    cleaned = cut_lineage(clean_masks(masks, min_area))
    boxed = mask_box(cleaned).join(cleaned, ["image_id", "seg_id"])
    kept = nms_boxes(boxed.withColumn("_s", F.col("unchanged").cast("double")), iou, "_s")
    return kept.drop("_s")
