"""Fill-in-middle transformation by secondary sort.

A text is cut into units (lines) and, at two places drawn from a hash of its id, into prefix,
middle and suffix. The parts are emitted as chunks of whole units, keyed by document and place in
the output; Spark deals the chunks out by document and sorts them by place inside the partition.
A task then streams the chunks and needs one of them at a time, whatever the length of a text:
output digests are incremental, and for restoration the chunks are sorted once more, by the place
in the text that the marks of the output stream tell, without a second shuffle.

A document is known by its id and a digest of its text, so rows that repeat an id keep apart.
Rows equal in both share one set of chunks and a count, and come out as often as they went in.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole

# Fixed values of the format: the marks in front of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
CHUNK_BYTES = 64 << 10
_ROWS_OUT = 2048
_BYTES_OUT = 4 << 20

_DOC = "doc_id bigint, digest binary, copies bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint"
_PIECE = f"{_DOC}, place bigint, last boolean, mark binary, chunk binary"
_IN_STREAM = f"{_DOC}, part int, place bigint, last boolean, chunk binary, output_sha256 string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def unit_ends(text: bytes) -> np.ndarray:
    """Byte offsets at which the lines of ``text`` end; a line holds its line feed."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if not text or text.endswith(b"\n") else np.append(ends, len(text))


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four repeatable numbers below 2^32 of a document; a null id counts as an empty string."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[k : k + 8], 16) for k in range(0, 32, 8))


def _chars(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def split(text: bytes, doc_id: int | None, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> tuple[int, str, list[tuple[bytes, int, int]]]:
    """Units, form and the parts in output order, each as mark, first and last byte."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", [(b"", 0, len(text))]
    starts = np.concatenate([[0], ends])
    low, high = sorted((int(starts[h1 % (n + 1)]), int(starts[h2 % (n + 1)])))
    prefix, middle, suffix = (PREFIX, 0, low), (MIDDLE, low, high), (SUFFIX, high, len(text))
    return (n, "spm", [suffix, prefix, middle]) if h4 % 100 < spm_rate else (n, "psm", [prefix, suffix, middle])


def _cuts(text: bytes, ends: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Chunks of whole units between two unit ends; a unit above CHUNK_BYTES is cut."""
    if low == high:
        yield low, low
    while low < high:
        to = high
        if high - low > CHUNK_BYTES:
            k = int(np.searchsorted(ends, low + CHUNK_BYTES, "right"))
            to = int(ends[k - 1]) if k and ends[k - 1] > low else low + CHUNK_BYTES
        yield low, to
        low = to


class _Out:
    """Rows gathered into Arrow batches of bounded size."""

    def __init__(self, schema: str):
        self.names, self.rows, self.held = _names(schema), [], 0
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
        self.schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def add(self, row: tuple, size: int = 0) -> bool:
        self.rows.append(row)
        self.held += size
        return self.held >= _BYTES_OUT or len(self.rows) >= _ROWS_OUT

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)]
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)


def pieces(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """The chunks of every text in output order, numbered by ``place`` from 0.

    Null and empty texts are one empty chunk of the plain form. Only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(_PIECE)
        for batch in batches:
            keys = [(i.as_py(), hashlib.blake2b(memoryview(t.as_buffer()), digest_size=16).digest()) for i, t in zip(batch.column(0), batch.column(1), strict=True)]
            copies = Counter(keys)
            for key, value in zip(keys, batch.column(1), strict=True):
                if key not in copies:
                    continue
                doc_id, text = key[0], value.as_py()
                n, form, parts = split(text, doc_id, seed, rate, spm_rate)
                ends = unit_ends(text)
                of = {mark: _chars(text[low:high]) for mark, low, high in parts} if form != "plain" else {}
                head = (doc_id, key[1], copies.pop(key), n, form, of.get(PREFIX), of.get(MIDDLE))
                cuts = [(mark if k == 0 else b"", a, b) for mark, low, high in parts for k, (a, b) in enumerate(_cuts(text, ends, low, high))]
                for place, (mark, a, b) in enumerate(cuts):
                    if out.add((*head, place, place == len(cuts) - 1, mark, text[a:b]), b - a):
                        yield out.batch()
        if out.rows:
            yield out.batch()

    return docs.select(F.col("doc_id").cast("long"), whole("text").cast("binary").alias("text")).mapInArrow(run, _PIECE)


def in_output_order(found: DataFrame) -> DataFrame:
    """Chunks dealt out by document and sorted by place inside each partition."""
    return found.repartition("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "place")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of a sorted stream, document by document."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return itertools.groupby(rows, key=lambda row: row[:2])


def _once(rows: Iterator[tuple], at: slice) -> Iterator[tuple[tuple, int]]:
    """Of rows equal in ``at`` (copies met in several tasks) the first, with the sum of their copies."""
    for _, same in itertools.groupby(rows, key=lambda row: row[at]):
        first = next(same)
        yield first, first[2] + sum(row[2] for row in same)


_PLACE = len(_names(_DOC))


def outputs(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the transformed text as ``output``, one row per input row."""
    schema = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(schema)
        for _, rows in _documents(batches):
            held, copies, row = [], 0, ()
            for row, copies in _once(rows, slice(_PLACE, _PLACE + 1)):
                held += row[-2:]
            text = b"".join(held)
            for _ in range(copies):
                if out.add((row[0], *row[3:_PLACE], text), len(text)):
                    yield out.batch()
        if out.rows:
            yield out.batch()

    found = in_output_order(pieces(docs, seed, rate, spm_rate)).mapInArrow(run, schema)
    return found.withColumn("output", F.col("output").cast("string"))


def restored(output: str, form: str) -> str:
    """The text of a transformed text."""
    if form == "plain":
        return output
    marks = [m.decode() for m in ((PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE))]
    first, rest = output[len(marks[0]) :].split(marks[1])
    second, middle = rest.split(marks[2])
    return first + middle + second if form == "psm" else second + middle + first


_PART = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}


def _to_text_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest each output as it streams by and tell every chunk its part of the text, by the mark that came last."""
    out = _Out(_IN_STREAM)
    for _, rows in _documents(batches):
        digest, part = hashlib.sha256(), 0
        for row, copies in _once(rows, slice(_PLACE, _PLACE + 1)):
            place, last, mark, chunk = row[_PLACE:]
            digest.update(mark)
            digest.update(chunk)
            part = _PART.get(mark, part)
            if out.add((*row[:2], copies, *row[3:_PLACE], part, place, last, chunk, digest.hexdigest() if last else None), len(chunk)):
                yield out.batch()
    if out.rows:
        yield out.batch()


_RESULT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Out(_RESULT)
    for _, rows in _documents(batches):
        digest, sealed, row = hashlib.sha256(), None, ()
        for row in rows:
            digest.update(row[-2])
            sealed = row[-1] or sealed
        for _ in range(row[2]):
            if out.add((row[0], *row[3:_PLACE], sealed, digest.hexdigest())):
                yield out.batch()
    if out.rows:
        yield out.batch()


def digests(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """doc_id, n, form, lengths and the SHA-256 of output and restored text, one row per input row.

    No text is held whole after its chunks are emitted. Null and empty texts are plain with no
    units; a null doc_id draws as an empty string; repeated rows come out as often; an empty table
    has no row; other columns are not read.
    """
    streamed = in_output_order(pieces(docs, seed, rate, spm_rate)).mapInArrow(_to_text_order, _IN_STREAM)
    return streamed.sortWithinPartitions("doc_id", "digest", "part", "place").mapInArrow(_restore, _RESULT)
