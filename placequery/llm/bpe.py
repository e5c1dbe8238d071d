"""BPE encoding and decoding.

Encoding merges the leftmost pair of lowest rank until none is left. The ranks of adjacent
pairs are the leaves of a segment tree whose root holds the smallest (rank, place); a merge
changes at most three leaves, so a word of n symbols takes O(n log n) however long it is.
Nodes have sixteen children, as their minimum is one call.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from . import words
from .common import held, whole

DEFAULT_VOCABULARY = "word_bpe_49k.json"
WORD_END = "</w>"
# Children of a node of the segment tree; a node is the smallest of them.
_FAN = 16
_NONE = 1 << 62
_PLACE_BITS = 31
_PLACE_MASK = (1 << _PLACE_BITS) - 1
# Words of up to _WIDEST bytes are merged _TOGETHER; their trees are rows of one array.
_WIDEST, _FEW, _TOGETHER = 32, 16, 4096
_NO_RANK = 1 << 40


def default_path() -> str:
    return public_tokenizers.path(DEFAULT_VOCABULARY)


class WordBpe:
    """A BPE vocabulary with word ends, read from its public file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[self.vocab[left], self.vocab[right]] = (rank, self.vocab[left + right])
        letters = words.byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.final = [self.vocab[x + WORD_END] for x in letters]
        self.tokens = {i: t for t, i in self.vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        keyed = sorted((a << 17 | b, rank, new) for (a, b), (rank, new) in self.pairs.items())
        self.pair_keys = np.array([k for k, _, _ in keyed], np.int64)
        self.pair_ranks = np.array([r for _, r, _ in keyed], np.int64)
        self.merged_ids = np.zeros(len(keyed), np.int32)
        self.merged_ids[self.pair_ranks] = [n for _, _, n in keyed]
        self.inner_ids, self.final_ids = np.array(self.inner, np.int32), np.array(self.final, np.int32)
        self.coder = words.TextCoder(self.piece_codes, lambda special: np.array([words.SPECIAL[special]], "<u4").tobytes())

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        return self.merged([*(self.inner[b] for b in raw[:-1]), self.final[raw[-1]]])

    def merged(self, symbols: list[int]) -> list[int]:
        """Ids left after all merges; ``symbols`` is used up."""
        n = len(symbols)
        if n < 2:
            return symbols
        pairs = self.pairs
        leaves = []
        for i, pair in enumerate(pairwise(symbols)):
            found = pairs.get(pair)
            leaves.append(found[0] << _PLACE_BITS | i if found else _NONE)
        tree = [leaves]
        while len(tree[-1]) > 1:
            low = tree[-1]
            tree.append([min(low[k : k + _FAN]) for k in range(0, len(low), _FAN)])
        root, levels = tree[-1], list(pairwise(tree))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := root[0]) != _NONE:
            i = best & _PLACE_MASK
            j = after[i]
            new = symbols[i] = pairs[symbols[i], symbols[j]][1]
            symbols[j] = -1
            k = after[i] = after[j]
            changed = [i]
            if k < n:
                before[k] = i
                leaves[j] = _NONE
                found = pairs.get((new, symbols[k]))
                leaves[i] = found[0] << _PLACE_BITS | i if found else _NONE
                changed.append(j)
            else:
                leaves[i] = _NONE
            h = before[i]
            if h >= 0:
                found = pairs.get((symbols[h], new))
                leaves[h] = found[0] << _PLACE_BITS | h if found else _NONE
                changed.append(h)
            for low, high in levels:
                changed = {c // _FAN for c in changed}
                for c in changed:
                    high[c] = min(low[c * _FAN : c * _FAN + _FAN])
        return [s for s in symbols if s >= 0]

    def piece_codes(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers; pieces of like length are merged together."""
        raws = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out: list[bytes] = [b""] * len(raws)
        by_size: dict[int, list[int]] = {}
        for k, raw in enumerate(raws):
            by_size.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append(k)
        for size, members in by_size.items():
            if size > _WIDEST or len(members) < _FEW:
                for k in members:
                    out[k] = np.array(self.piece(pieces[k]), "<u4").tobytes()
                continue
            for low in range(0, len(members), _TOGETHER):
                part = members[low : low + _TOGETHER]
                ids, counts = self._merged_together([raws[k] for k in part], size)
                data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                begin = 0
                for k, end in zip(part, ends, strict=True):
                    out[k], begin = data[begin:end], end
        return out

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NO_RANK where it never merges (also next to a gap, -1)."""
        keys = left.astype(np.int64) << 17 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], _NO_RANK)

    def _merged_together(self, raws: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """``merged`` for many words at once, one segment tree of ``size`` leaves per row."""
        n = np.array([len(r) for r in raws])
        letters = np.frombuffer(b"".join(r.ljust(size, b"\0") for r in raws), np.uint8).reshape(-1, size)
        place = np.arange(size)
        symbols = np.where(place < (n - 1)[:, None], self.inner_ids[letters], np.where(place == (n - 1)[:, None], self.final_ids[letters], -1))
        # One more column stands for the end of the word, and for the beginning as column -1.
        symbols = np.concatenate([symbols, np.full((len(raws), 1), -1)], axis=1).astype(np.int32)
        after = np.tile(np.arange(1, size + 2, dtype=np.int16), (len(raws), 1))
        before = np.tile(np.arange(-1, size, dtype=np.int16), (len(raws), 1))
        tree = np.full((len(raws), 2 * size), _NO_RANK * size, np.int64)
        tree[:, size:] = self._ranks_of(symbols[:, :-1], symbols[:, 1:]) * size + place
        half = size
        while half > 1:
            half //= 2
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        row = np.flatnonzero(tree[:, 1] < _NO_RANK * size)
        while len(row):
            rank, i = np.divmod(tree[row, 1], size)
            j = after[row, i]
            k = after[row, j]
            h = before[row, i]
            new = self.merged_ids[rank]
            symbols[row, i], symbols[row, j] = new, -1
            after[row, i], before[row, k] = k, i
            begin = h < 0
            to_left = np.where(begin, _NO_RANK, self._ranks_of(np.where(begin, -1, symbols[row, h]), new))
            tree[row, size + j] = _NO_RANK * size
            tree[row, size + i] = self._ranks_of(new, symbols[row, k]) * size + i
            h = np.where(begin, i, h)
            tree[row, size + h] = np.where(begin, tree[row, size + i], to_left * size + h)
            nodes = [size + j, size + i, size + h]
            for _ in range(size.bit_length() - 1):
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree[row, x] = np.minimum(tree[row, 2 * x], tree[row, 2 * x + 1])
            row = row[tree[row, 1] < _NO_RANK * size]
        left = symbols >= 0
        return symbols[left], left.sum(axis=1)

    def text_ids(self, text: str) -> bytes:
        return next(self.coder.codes([text]))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.text_ids(text), "<u4")

    def text(self, ids: list[int]) -> str:
        """Token strings joined by a space; ids outside the vocabulary are skipped."""
        tokens = self.tokens
        try:
            return " ".join([tokens[i] for i in ids])
        except KeyError:
            return " ".join([tokens[i] for i in ids if i in tokens])


def vocabulary(path: str) -> WordBpe:
    return held("bpe", path, lambda: WordBpe(path))


def parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The texts in order, about ``GROUP_CHARS`` bytes at a time: what is made of a batch is handed on bit by bit."""
    for texts in batches:
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // words.GROUP_CHARS)) + 1
        for begin, end in pairwise([0, *cuts.tolist(), len(texts)]):
            yield texts[begin:end]


def _id_lists(coded: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(c) // 4 for c in coded)])
    flat = np.frombuffer(b"".join(coded), "<i4")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _texts(bpe: WordBpe, coded: list[bytes]) -> pa.Array:
    return pa.array((bpe.text(np.frombuffer(c, "<u4").tolist()) for c in coded), pa.string(), size=len(coded))


def encode_column(text: Column, path: str) -> Column:
    """array<int> of ids of a string column; null and empty texts give an empty array."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts(batches):
            yield _id_lists(list(vocabulary(path).coder.codes(t.as_py() for t in part)))

    # Spark would otherwise encode anew for each use of the ids.
    return encode.asNondeterministic()(text)


def decode_column(ids: Column, path: str) -> Column:
    """Text of an array<int> column of ids; null and empty arrays give an empty text."""

    @F.arrow_udf(StringType())
    def decode(arrays: pa.Array) -> pa.Array:
        bpe = vocabulary(path)
        return pa.array([bpe.text(x.values.to_numpy().tolist()) if x.is_valid else "" for x in arrays], pa.string())

    return decode(ids)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``, the ids of each whole text.

    Row by row, without a shuffle. Null and empty texts give an empty array; special strings
    inside a text give their special ids. A column named ``out`` is replaced, others stay.
    """
    return docs.withColumn(out, encode_column(whole(text), path or default_path()))


def decode(coded: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the text of each id array. Null arrays give an empty text."""
    return coded.withColumn(out, decode_column(F.col(ids), path or default_path()))


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Add ``packed`` (ids as little-endian unsigned 32-bit integers) and ``decoded`` in one pass over the texts.

    Null and empty texts give empty values. Columns of these names are replaced, others stay.
    """
    where = path or default_path()

    @F.arrow_udf(StructType([StructField("packed", BinaryType()), StructField("decoded", StringType())]))
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = vocabulary(where)
        for part in parts(batches):
            packed = list(bpe.coder.codes(t.as_py() for t in part))
            yield pa.StructArray.from_arrays([pa.array(packed, pa.binary()), _texts(bpe, packed)], ["packed", "decoded"])

    # Spark would otherwise run it anew for each field.
    found = docs.withColumn("_both", both.asNondeterministic()(whole(text)))
    return found.withColumns({"packed": F.col("_both.packed"), "decoded": F.col("_both.decoded")}).drop("_both")


def encode_and_decode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Add ``ids`` and ``decoded`` of each whole text, in one pass of one Python worker a task.

    Null and empty texts give an empty array and an empty text. Columns of these names are
    replaced, others stay.
    """
    where = path or default_path()

    @F.arrow_udf(StructType([StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())]))
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = vocabulary(where)
        for part in parts(batches):
            coded = list(bpe.coder.codes(t.as_py() for t in part))
            yield pa.StructArray.from_arrays([_id_lists(coded), _texts(bpe, coded)], ["ids", "decoded"])

    # Spark would otherwise run it anew for each field.
    found = docs.withColumn("_both", both.asNondeterministic()(whole(text)))
    return found.withColumns({"ids": F.col("_both.ids"), "decoded": F.col("_both.decoded")}).drop("_both")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, token count and digests of ids and decoded text of every document."""
    return round_trip(docs.select("doc_id", "text"), path).select(
        "doc_id",
        (F.octet_length("packed") / 4).cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
