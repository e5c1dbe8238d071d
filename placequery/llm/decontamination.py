"""Benchmark decontamination by q-gram lemma filtering.

A passage of m characters with at most k edits still shares m + 1 - q - kq of its q-grams with
the text, and they lie within k + 1 diagonals (place in the text less place in the passage).
Shared q-grams are counted in overlapping bands of diagonals; a band that reaches the bound is
verified by banded alignment of the whole passage.

Texts are compared in lower case, with every run of characters that are neither letters nor
digits as one space. Benchmark items are taken in blocks of bounded size, each block against all
documents, row by row and without a shuffle.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_held, held, whole

Q = 10
# Edits per character of a passage.
EDIT_RATE = 0.08
# Characters of benchmark text that are sent to the tasks at a time.
BLOCK_CHARS = 8 << 20
MATCH = "array<struct<item_id:bigint,start:int,end:int,edits:int>>"

_GAP = re.compile(r"[\W_]+")
_GROUP_CHARS = 1 << 21
_PRIME = np.uint64(0x100000001B3)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


def normal(text: str) -> str:
    """Lower case, other runs than letters and digits as one space, without such runs at the ends."""
    return _GAP.sub(" ", text.lower()).strip(" ")


def original_places(text: str) -> list[int]:
    """For each character of the normal form, the place of its source in the text."""
    lowered, places = [], []
    for i, c in enumerate(text):
        for x in c.lower():
            lowered.append(x)
            places.append(i)
    joined, out, at = "".join(lowered), [], 0
    for m in _GAP.finditer(joined):
        out += places[at : m.start()]
        if m.start() > 0 and m.end() < len(joined):
            out.append(places[m.start()])
        at = m.end()
    return out + places[at:]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(c: np.ndarray) -> np.ndarray:
    """Hash of the q-gram at each place."""
    n = max(len(c) - Q + 1, 0)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(Q):
            h = h * _PRIME + c[k : k + n]
        return (h ^ (h >> np.uint64(29))) * _SPREAD


class Passages:
    """Index of the q-grams of a block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str | None]], rate: float = EDIT_RATE):
        found = [(i, normal(t or "")) for i, t in items]
        self.short = [(i, t) for i, t in found if 0 < len(t) < Q]
        found = [(i, t) for i, t in found if len(t) >= Q]
        self.ids, self.codes = [i for i, _ in found], [codes(t) for _, t in found]
        sizes = np.array([len(c) for c in self.codes], np.int64)
        # The budget leaves at least one shared q-gram.
        self.edits = np.minimum((rate * sizes).astype(np.int64), (sizes - Q) // Q)
        self.least = sizes + 1 - Q - self.edits * Q
        grams = [gram_hashes(c) for c in self.codes]
        hashes = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else np.empty(0, np.int64)
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def candidates(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """(text, item, first diagonal of a band) of every band that reaches its item's bound."""
        flat = np.concatenate(texts) if texts else np.empty(0, np.uint32)
        begins = np.cumsum([0, *map(len, texts)])
        h = gram_hashes(flat)
        at = np.flatnonzero(self.maybe[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        low = np.searchsorted(self.hashes, h[at], "left")
        n = np.searchsorted(self.hashes, h[at], "right") - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        if not len(at):
            return
        text = np.searchsorted(begins, at, "right") - 1
        inside = at + Q <= begins[text + 1]
        at, low, n, text = at[inside], low[inside], n[inside], text[inside]
        # Every occurrence of the q-gram in the items.
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        entry = np.repeat(low, n) + step
        item, text = self.item[entry], np.repeat(text, n)
        diagonal = np.repeat(at, n) - begins[text] - self.place[entry]
        width = self.edits[item] + 1
        band = np.floor_divide(diagonal, width)
        keys = np.stack([np.tile(text, 2), np.tile(item, 2), np.concatenate([band, band - 1])])
        order = np.lexsort(keys[::-1])
        keys = keys[:, order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(keys, axis=1) != 0).any(axis=0)]))
        count = np.diff(np.append(first, keys.shape[1]))
        keys = keys[:, first]
        good = count >= self.least[keys[1]]
        for t, i, b in keys[:, good].T.tolist():
            yield t, i, b * int(self.edits[i] + 1)

    def matches(self, texts: list[str]) -> list[list[tuple[int | None, int, int, int]]]:
        """(item_id, start, end, edits) in normal characters of the best match of each item, per normal text."""
        coded = [codes(t) for t in texts]
        bands: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, i, low in self.candidates(coded):
            bands[i].append((t, low))
        best: list[dict] = [{} for _ in texts]
        for i, found in bands.items():
            for (t, _), hit in zip(found, aligned(self.codes[i], [coded[t] for t, _ in found], [low for _, low in found], int(self.edits[i])), strict=True):
                if hit and (i not in best[t] or hit < best[t][i]):
                    best[t][i] = hit
        out = [[(self.ids[i], start, end, edits) for i, (edits, start, end) in sorted(b.items())] for b in best]
        for k, text in enumerate(texts if self.short else ()):
            for i, t in self.short:
                at = f" {text} ".find(f" {t} ")
                if at >= 0:
                    out[k].append((i, at, at + len(t), 0))
        return out


def aligned(passage: np.ndarray, texts: list[np.ndarray], lows: list[int], edits: int) -> list[tuple[int, int, int] | None]:
    """(edits, start, end) of the passage in each text, within the band of 2(edits + 1) diagonals from ``lows``.

    One row of the alignment at a time, for all texts together; ``edits`` diagonals on either side
    leave room for the path. None where it takes more edits.
    """
    m, width = len(passage), 2 * (edits + 1) + 2 * edits
    out: list[tuple[int, int, int] | None] = []
    for k in range(0, len(texts), 512):
        part, first = texts[k : k + 512], [low - edits for low in lows[k : k + 512]]
        window = np.stack([_window(t, f, m + width) for t, f in zip(part, first, strict=True)])
        inside = np.stack([_inside(len(t), f, width) for t, f in zip(part, first, strict=True)])
        cost = np.where(inside, 0, m + 1)
        cost = _rows(passage, window, cost)
        ends = cost.argmin(axis=1)
        for r, (t, f) in enumerate(zip(part, first, strict=True)):
            least = int(cost[r, ends[r]])
            end = f + m + int(ends[r])
            if least > edits or end > len(t) or end <= 0:
                out.append(None)
                continue
            # Backwards from the end, which is fixed, for the start.
            tail = t[max(end - m - edits, 0) : end][::-1]
            back = _rows(passage[::-1], _window(tail, -edits, m + 2 * edits + 1)[None], np.where(np.arange(2 * edits + 1) >= edits, np.arange(2 * edits + 1) - edits, m + 1)[None])[0]
            out.append((least, max(end - (m - edits + int(back.argmin())), 0), end))
    return out


def _window(text: np.ndarray, first: int, n: int) -> np.ndarray:
    """``n`` characters from place ``first``; -1 outside the text."""
    out = np.full(n, -1, np.int64)
    low, high = max(first, 0), min(first + n, len(text))
    if low < high:
        out[low - first : high - first] = text[low:high]
    return out


def _inside(length: int, first: int, width: int) -> np.ndarray:
    place = first + np.arange(width)
    return (place >= 0) & (place <= length)


def _rows(passage: np.ndarray, window: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Cost at the last row: column d of row i stands for window place i + d."""
    width = cost.shape[1]
    step = np.arange(width)
    for i, c in enumerate(passage):
        over = cost + (window[:, i : i + width] != c)
        over[:, :-1] = np.minimum(over[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(over - step, axis=1) + step
    return cost


def _column(text: str, items: list[tuple], rate: float, spark) -> Column:
    shared, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def found(texts: pa.Array) -> pa.Array:
        passages = _loaded(name, shared, rate)
        out, group, held = [], [], 0

        def flush() -> None:
            for raw, hits in zip(group, passages.matches([normal(t) for t in group]), strict=True):
                places = original_places(raw) if hits else []
                out.append([{"item_id": i, "start": places[s], "end": places[e - 1] + 1, "edits": k} for i, s, e, k in hits])
            group.clear()

        for t in texts:
            group.append(t.as_py())
            held += len(group[-1])
            if held >= _GROUP_CHARS:
                flush()
                held = 0
        flush()
        kind = pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])
        return pa.array(out, pa.list_(kind))

    found.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(found, MATCH).asNondeterministic()(whole(text))


def _loaded(name: str, shared, rate: float) -> Passages:
    """The index of a broadcast block of items; a worker keeps the latest one."""

    def make() -> Passages:
        drop_held("decontamination")
        return Passages(shared.value, rate)

    return held("decontamination", name, make)


def find(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, text: str = "text", out: str = "matches", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Add ``out``: item_id, start, end (in the text) and edits of each benchmark item found in each whole text.

    An item counts once per text, with the fewest edits and then the first place. Null and empty
    texts and items match nothing; items of fewer than Q characters only as whole words and
    without edits; repeated items count each. A column named ``out`` is replaced, others stay.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), whole("text").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = chars // block_chars + 1
    columns = []
    for k in range(blocks):
        # A block holds about block_chars characters: its size does not grow with the benchmark.
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        columns.append(_column(text, [(r["item_id"], r["text"]) for r in rows], rate, docs.sparkSession))
    parts = docs.withColumns({f"_block{k}": c for k, c in enumerate(columns)})
    names = [f"_block{k}" for k in range(blocks)]
    return parts.withColumn(out, F.concat(*names) if blocks > 1 else F.col(names[0])).drop(*names)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """Rows whose text holds no benchmark item; their columns stay as they are."""
    return find(docs, benchmark, rate, out="_matches").where(F.size("_matches") == 0).drop("_matches")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end and edits of every match."""
    found = find(docs.select("doc_id", "text"), benchmark).select("doc_id", F.explode("matches").alias("_m"))
    return found.select("doc_id", "_m.item_id", "_m.start", "_m.end", "_m.edits")
