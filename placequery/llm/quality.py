"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every word has a fixed sparse index vector. The context vector of a word is the sum of the index
vectors of its neighbours over the whole corpus; words are hashed into a fixed number of rows, so
the table is bounded. A document is the mean of its words' normalised context vectors and of the
index vectors of their shapes (letter case, digits, punctuation, repetition). A two-layer network
scores it, and one temperature, fitted on rows the network has not seen, calibrates the score.

Counting and scoring cover every whole text. Only the network is fitted on a sample of labelled
rows, bounded by ``sample``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import Memo, drop_held, held, whole

# Rows of the word table, dimensions of a vector, non-zeros of an index vector, neighbours on either side.
ROWS, DIMS, NONZERO, REACH = 1 << 13, 48, 4, 1
SHAPE_ROWS = 1 << 10
# Labelled rows that the network is fitted on at most.
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, SEED = 24, 40, 256, 0.01, 11
THRESHOLD = 0.3
FOLDS = 5
_BANDS = 32



class _Letters(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = mark = "U" if c.isupper() else "l" if c.isalpha() else "9" if c.isdigit() else c
        return mark


_LETTERS = _Letters()
_RUN = re.compile(r"(.)\1+", re.S)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def shape(word: str) -> str:
    """Letters as U (upper case) or l, digits as 9, other characters as they are; runs of one mark as one."""
    return _RUN.sub(r"\1", word.translate(_LETTERS))[:12]


def _index_vector(key: str) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"))
    places = np.random.default_rng(seed).choice(DIMS, NONZERO, replace=False)
    out = np.zeros(DIMS, np.int8)
    out[places] = np.where(np.arange(NONZERO) % 2, 1, -1)
    return out


def _row(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % ROWS


@lru_cache(4)
def _index_table(name: str = "row", n: int = ROWS) -> np.ndarray:
    return np.stack([_index_vector(f"{name} {k}") for k in range(n)])


def _rows_of(texts: list[str], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Row of every word, and words per text."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    return np.fromiter(map(memo.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum())), sizes


def _groups(texts: pa.Array, chars: int = 1 << 21) -> Iterator[list[str]]:
    group, held = [], 0
    for t in texts:
        group.append(t.as_py() or "")
        held += len(group[-1])
        if held >= chars:
            yield group
            group, held = [], 0
    if group:
        yield group


def context_table(docs: DataFrame, text: str = "text") -> np.ndarray:
    """[ROWS, DIMS] sums of the index vectors of neighbours, over all texts.

    Each task adds its part up and emits it in bands of rows, which are summed by band; what
    reaches the driver is the table, whose size is fixed.
    """
    index = _index_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, total = held("quality", "rows", lambda: Memo(_row)), np.zeros(ROWS * DIMS, np.int64)
        signs = [(np.argsort(-np.abs(index), axis=1, kind="stable")[:, k]) for k in range(NONZERO)]
        values = [index[np.arange(ROWS), s].astype(np.float64) for s in signs]
        for batch in batches:
            for group in _groups(batch.column(0)):
                rows, sizes = _rows_of(group, memo)
                text_of = np.repeat(np.arange(len(sizes)), sizes)
                for step in range(1, REACH + 1):
                    same = text_of[step:] == text_of[:-step]
                    a, b = rows[:-step][same], rows[step:][same]
                    for word, near in ((a, b), (b, a)):
                        for place, value in zip(signs, values, strict=True):
                            total += np.bincount(word * DIMS + place[near], value[near], ROWS * DIMS).astype(np.int64)
        if total.any():
            for band, part in enumerate(np.split(total, _BANDS)):
                yield pa.RecordBatch.from_pydict({"band": pa.array([band], pa.int64()), "part": pa.array([part.tobytes()], pa.binary())})

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ROWS * DIMS // _BANDS, np.int64)
        for batch in parts:
            for part in batch.column("part"):
                total += np.frombuffer(part.as_py(), np.int64)
        yield pa.RecordBatch.from_pydict({"band": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select(whole(text).alias("_text")).mapInArrow(run, "band bigint, part binary")
    table = np.zeros((_BANDS, ROWS * DIMS // _BANDS), np.int64)
    for row in parts.groupBy("band").applyInArrow(add, "band bigint, part binary").collect():
        table[row["band"]] = np.frombuffer(row["part"], np.int64)
    return table.reshape(ROWS, DIMS)


class Pooling:
    """Document vectors from a table of context vectors."""

    def __init__(self, context: np.ndarray):
        norm = np.sqrt((context.astype(np.float64) ** 2).sum(axis=1))
        self.words = (context / np.maximum(norm, 1)[:, None]).astype(np.float32)
        shapes = Memo(lambda s: _row(s) % SHAPE_ROWS)
        self.codes = Memo(lambda w: _row(w) * SHAPE_ROWS + shapes[shape(w)])
        self.shape_table = _index_table("shape", SHAPE_ROWS).astype(np.float32)

    def vectors(self, texts: list[str]) -> np.ndarray:
        """[texts, 2 DIMS + 4]: mean word vector, mean index vector of shapes, log length, share of distinct and of repeated words, words per line."""
        out = np.zeros((len(texts), 2 * DIMS + 4), np.float32)
        for k, text in enumerate(texts):
            split = text.split()
            if not split:
                continue
            n, distinct = len(split), set(split)
            rows, shapes = np.divmod(np.fromiter(map(self.codes.__getitem__, split), np.int64, n), SHAPE_ROWS)
            for at, found, table in ((0, rows, self.words), (DIMS, shapes, self.shape_table)):
                counts = np.bincount(found)
                used = np.flatnonzero(counts)
                out[k, at : at + DIMS] = counts[used].astype(np.float32) @ table[used] / n
            again = int((rows[1:] == rows[:-1]).sum())
            out[k, 2 * DIMS :] = np.log1p(n), len(distinct) / n, again / n, np.log1p(n / (1 + text.count("\n")))
        return out


class Network:
    """One hidden layer of rectified units, trained by Adam, with a temperature for its logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        order = rng.permutation(len(x))
        tune, fit = order[: len(x) // 5], order[len(x) // 5 :]
        z = (x - self.mean) / self.scale
        self.w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.w]
        step = 0
        for _ in range(EPOCHS):
            for low in range(0, len(fit), BATCH):
                rows = rng.permutation(fit)[:BATCH] if len(fit) <= BATCH else fit[low : low + BATCH]
                step += 1
                for w, g, (m, v) in zip(self.w, self._gradients(z[rows], y[rows]), moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            rng.shuffle(fit)
        self.temperature = 1.0
        rows = tune if len(tune) else fit
        logits = self.logits(x[rows])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        losses = [np.logaddexp(0, np.where(y[rows] > 0, -logits, logits) / t).mean() if len(rows) else 0 for t in grid]
        self.temperature = float(grid[int(np.argmin(losses))])

    def _gradients(self, z: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w1, b1, w2, b2 = self.w
        hidden = np.maximum(z @ w1 + b1, 0)
        error = (_sigmoid(hidden @ w2 + b2) - y) / len(y)
        back = np.outer(error, w2) * (hidden > 0)
        return [z.T @ back + 1e-4 * w1, back.sum(axis=0), hidden.T @ error + 1e-4 * w2, error.sum(keepdims=True)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.w
        return (np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2) / self.temperature

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x))


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, text: str = "text") -> tuple[Pooling, Network | float]:
    """Word vectors of all texts and a network for the labelled rows outside the held-out fold.

    At most ``sample`` rows are taken, those of the lowest hash of doc_id. Rows without a label of 0 or 1 are
    left out, of several labels of a document the least counts. Without labels the score is a
    constant 0.5; with labels of one kind the network says so.
    """
    pooling = Pooling(context_table(docs, text))
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(label).alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.concatenate([pooling.vectors(g) for g in _groups(batch.column(2))]) if batch.num_rows else np.zeros((0, 1), np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([v.tobytes() for v in vectors], pa.binary())], ["doc_id", "label", "vector"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(text).alias("_text"))
    rows = rows.join(F.broadcast(known.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")  # at most ``sample`` rows
    taken = rows.select("doc_id", F.col("_label").cast("long"), "_text").mapInArrow(run, "doc_id bigint, label bigint, vector binary")
    # Repeated rows of a document count once, so that no more than ``sample`` vectors reach the driver.
    found = taken.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("vector").alias("vector")).orderBy("doc_id").toArrow()
    if not found.num_rows:
        return pooling, 0.5
    x = np.stack([np.frombuffer(v.as_py(), np.float32) for v in found.column("vector")]).astype(np.float64)
    return pooling, Network(x, found.column("label").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: tuple[Pooling, Network | float], text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, the calibrated probability of label 1 of each whole text.

    Row by row, without a shuffle. Null and empty texts have a zero vector and a score like any
    other. A column named ``out`` is replaced, others stay. The model's size is fixed.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast((model[0].words, model[1])), uuid.uuid4().hex

    @F.arrow_udf(DoubleType())
    def scores(texts: pa.Array) -> pa.Array:
        pooling, network = _loaded(name, shared)
        if isinstance(network, float):
            return pa.array(np.full(len(texts), network))
        parts = [network.scores(pooling.vectors(g).astype(np.float64)) for g in _groups(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    # Spark would otherwise score anew for each use.
    return docs.withColumn(out, scores.asNondeterministic()(whole(text)))


def _loaded(name: str, shared) -> tuple[Pooling, Network | float]:
    """The broadcast model with this worker's memos; a worker keeps the latest one."""

    def make() -> tuple[Pooling, Network | float]:
        drop_held("quality")
        words, network = shared.value
        pooling = Pooling(np.zeros((1, DIMS)))
        pooling.words = words
        return pooling, network

    return held("quality", name, make)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    found = score(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
