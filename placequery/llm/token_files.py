"""Token ids on disk: frequency-ranked, byte-aligned, with control bytes apart.

Every id is replaced by its rank in the corpus (0: most frequent). A rank takes one to four
bytes; two control bits give its length, four lengths to a control byte, and control and data
bytes lie apart. Reading looks four lengths up per control byte and scatters the data bytes at
once.

A file is a row of blocks: header (documents, ids, control bytes, data bytes), document ids,
their null marks, ids per document, control bytes, data bytes. Spark tasks write and read
their own files in a shared folder and hand on a manifest row for each; what a lost or doubled
attempt has written is in no manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut_lineage, scratch_path
from . import words
from .bpe import default_path
from .common import file_system, held, spread_files, whole

END_ID = 1
_ID = attrgetter("id")
# Entries of a generation of the memos of pieces and of runs without white space.
_MEMO = 250_000
# Ids in a batch of a task that reads.
_BATCH_IDS = 1 << 20
_HEADER = struct.Struct("<4sqqqq")
_MAGIC = b"RIDS"
_LENGTHS = np.array([[1 + (c >> s & 3) for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)
_BYTE = np.arange(4, dtype=np.uint8)
# Plain ids by their bytes. They lie beside the ranked ones until those are written, hence compressed.
_PLAIN, _CODEC = {2: np.dtype("<u2"), 4: np.dtype("<u4")}, "zstd"


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = more
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[more[:, None] >= _BYTE]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of control and data bytes."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[lengths[:, None] > _BYTE] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def _library(path: str) -> words.TextCoder:
    return held("token_files", path, lambda: _coder(path))


def _coder(path: str) -> words.TextCoder:
    """Ids of a text by the tokenizers library, which is asked once for a piece in the memo."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenize, plain = tokenizer.model.tokenize, _PLAIN[_width(path)]

    def codes(pieces: list[str]) -> list[bytes]:
        flat, ends = [], [0]
        for letters in words.all_letters(pieces):
            flat.extend(map(_ID, tokenize(letters)))
            ends.append(plain.itemsize * len(flat))
        data = np.array(flat, plain).tobytes()
        return [data[begin:end] for begin, end in pairwise(ends)]

    return words.TextCoder(codes, lambda special: plain.type(tokenizer.token_to_id(special)).tobytes(), _MEMO)


def _open_new(folder: str):
    files, at = file_system(folder)
    files.create_dir(at, recursive=True)
    name = uuid.uuid4().hex
    return files.open_output_stream(f"{at}/{name}"), f"{folder}/{name}"


def _manifest(path: str, docs: list, n_docs: int, n_tokens: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"path": pa.array([path]), "first_doc": pa.array(docs[:1], pa.int64()),
         "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())}
    )


_MANIFEST = "path string, first_doc bigint, n_docs bigint, n_tokens bigint"


def _write_block(out, docs: list, counts: list[int], control: bytes, data: bytes) -> None:
    out.write(_HEADER.pack(_MAGIC, len(docs), sum(counts), len(control), len(data)))
    out.write(np.array([d or 0 for d in docs], "<i8").tobytes())
    out.write(np.array([d is None for d in docs], np.uint8).tobytes())
    out.write(np.array(counts, "<i8").tobytes())
    out.write(control)
    out.write(data)


def _blocks(path: str) -> Iterator[tuple[list, np.ndarray, bytes, bytes]]:
    files, at = file_system(path)
    with files.open_input_stream(at) as f:
        while head := f.read(_HEADER.size):
            magic, n_docs, _, n_control, n_data = _HEADER.unpack(head)
            if magic != _MAGIC:
                raise ValueError(f"{path}: not a file of token ids")
            docs = np.frombuffer(f.read(8 * n_docs), "<i8").tolist()
            nulls = f.read(n_docs)
            counts = np.frombuffer(f.read(8 * n_docs), "<i8")
            yield [None if z else d for d, z in zip(docs, nulls, strict=True)], counts, f.read(n_control), f.read(n_data)


def _write_plain(folder: str, path: str):
    """Ids as they are (no control bytes), compressed, in the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, first, n_docs, n_tokens, coder = None, [], 0, 0, _library(path)
        width = _width(path)
        end = np.array([END_ID], _PLAIN[width]).tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out, name = _open_new(folder)
            docs = batch.column(0).to_pylist()
            coded = [c + end for c in coder.codes(t.as_py() for t in batch.column(1))]
            counts = [len(c) // width for c in coded]
            _write_block(out, docs, counts, b"", pa.compress(b"".join(coded), _CODEC, asbytes=True))
            first, n_docs, n_tokens = first or docs[:1], n_docs + len(docs), n_tokens + sum(counts)
        if out is not None:
            out.close()
            yield _manifest(name, first, n_docs, n_tokens)

    return run


@lru_cache(2)
def _width(path: str) -> int:
    """Bytes of an id as it is."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def _plain_ids(counts: np.ndarray, data: bytes, path: str) -> np.ndarray:
    width = _width(path)
    return np.frombuffer(pa.decompress(data, int(counts.sum()) * width, _CODEC), _PLAIN[width])


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                total = np.zeros(0, np.int64)
                for _, counts, _, data in _blocks(name):
                    found = np.bincount(_plain_ids(counts, data, path))
                    if len(found) > len(total):
                        total, found = found, total
                    total[: len(found)] += found
                ids = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "n": pa.array(total[ids], pa.int64())})

    return run


def _write_ranked(folder: str, path: str, rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, first, n_docs, n_tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out, name = _open_new(folder)
                with out:
                    for docs, counts, _, data in _blocks(source):
                        _write_block(out, docs, counts.tolist(), *pack(rank[_plain_ids(counts, data, path)]))
                yield _manifest(name, [first], n_docs, n_tokens)

    return run


def write(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Write the ids of all texts, each followed by END_ID, in ascending doc_id order.

    Returns the manifest: one row per file (path, first_doc, n_docs, n_tokens), the files in the
    order of first_doc. Texts are dealt out by ranges of doc_id and encoded once; the counts of
    ids are at most one row per vocabulary entry. Null and empty texts are just END_ID; rows with
    a null doc_id come first; an empty table has no file. Other columns are not read.
    """
    path = path or default_path()
    ordered = docs.select(F.col("doc_id").cast("long"), whole("text").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    plain = cut_lineage(ordered.mapInArrow(_write_plain(f"{folder}/plain", path), _MANIFEST))
    counts = plain.select("path").mapInArrow(_count(path), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    # One row per id of the vocabulary at most.
    ranked = [r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()]
    rank = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank[ranked] = np.arange(len(ranked))
    files, at = file_system(folder)
    files.create_dir(at, recursive=True)
    with files.open_output_stream(f"{at}/ranks") as f:
        f.write(np.array(ranked, "<u4").tobytes())
    return cut_lineage(plain.mapInArrow(_write_ranked(f"{folder}/ranked", path, rank), _MANIFEST))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids and their ids_crc32 of every document in the files.

    ids_crc32 is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers. A task
    hands on batches of about ``_BATCH_IDS`` ids, so only single documents make larger ones. A manifest without rows
    gives no rows.
    """
    before = Window.orderBy(F.asc_nulls_first("first_doc"), "path").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file.
    placed = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _ranks(folder)
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for docs, counts, control, data in _blocks(name):
                    ids = ids_of[unpack(control, data, int(counts.sum()))]
                    ends = np.concatenate([[0], np.cumsum(counts)])
                    cuts = np.flatnonzero(np.diff(ends[:-1] // _BATCH_IDS)) + 1
                    for a, b in zip([0, *cuts], [*cuts, len(docs)], strict=True):
                        own, part = ids[ends[a] : ends[b]], ends[a : b + 1]
                        sums = [zlib.crc32(ids[s:e]) for s, e in zip(part[:-1], part[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(docs[a:b], pa.int64()), pa.array(start + part[:-1], pa.int64()),
                             pa.ListArray.from_arrays(pa.array(part - part[0], pa.int32()), pa.array(own.view(np.int32))),
                             pa.array(sums, pa.int64())],
                            ["doc_id", "start", "ids", "ids_crc32"],
                        )
                    start += int(ends[-1])

    spread = spread_files(placed)
    return spread.mapInArrow(run, "doc_id bigint, start bigint, ids array<int>, ids_crc32 bigint")


def _ranks(folder: str) -> np.ndarray:
    """Ids by rank; asking for them also drops the encoder of a worker that has written."""

    def load() -> np.ndarray:
        files, at = file_system(f"{folder}/ranks")
        with files.open_input_stream(at) as f:
            return np.frombuffer(f.read(), "<u4")

    return held("token_ranks", folder, load)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write all ids and read the files back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    found = read(write(docs, folder, path), folder)
    return found.select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32")
