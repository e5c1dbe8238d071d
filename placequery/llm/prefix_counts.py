"""Exact token counts of every prefix of a text.

A sequence of BPE tokens is the encoding of its text exactly if each adjacent pair of them is
the encoding of its own text. So the encoding of a prefix ends in the one token that is
compatible with the last token of the prefix before it, and one pass over a word gives the
count of each of its prefixes. A text's table keeps, for every character, how much its prefix
count differs from that of the prefix before; the counts are the running sum.

Characters are those of the text in its normal form (NFC, lower case), of which every prefix
is in normal form again.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterable, Iterator
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from . import words
from .bpe import WORD_END, default_path, vocabulary
from .common import Memo, held, whole


_NEVER = 1 << 62
# Pieces and runs without white space in a generation of their memos, and prefixes of words kept at a time.
_PIECES = 200_000
_CHUNKS = 250_000
_PREFIXES = 1_000_000
# Pairs of tokens judged before.
_FITTING = 400_000


class PrefixCounts:
    def __init__(self, path: str):
        self.bpe = vocabulary(path)
        self.inner, self.final = {}, {}
        for token, i in self.bpe.vocab.items():
            if token.endswith(WORD_END) and len(token) > len(WORD_END):
                self.final[token[: -len(WORD_END)]] = i
            else:
                self.inner[token] = i
        self.parts = {new: (pair, rank) for pair, (rank, new) in self.bpe.pairs.items()}
        self.fitting: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.ends = _backwards(self.inner, self.final)
        self.pieces = Memo(self.piece_steps, _PIECES)
        self.chunks = Memo(self.chunk_steps, _CHUNKS)
        self._forget()

    def _forget(self) -> None:
        # Prefixes met before, as a tree: child by (node, byte), then per node its last token, count and count as a word.
        self.child: dict[int, int] = {}
        self.last, self.count, self.as_word = [-1], [0], [0]

    def _symbols(self, token: int) -> list[int]:
        return [x for part in self.parts[token][0] for x in self._symbols(part)] if token in self.parts else [token]

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at the first (0) or last (1) place while ``token`` is built, each with the rank that ends it."""
        known = self.spines.get((token, side))
        if known is None:
            known, until = [], _NEVER
            while True:
                known.append((token, until))
                if token not in self.parts:
                    break
                pair, until = self.parts[token]
                token = pair[side]
            known.reverse()
            self.spines[known[-1][0], side] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens in a row are the encoding of their text; left -1: the word begins.

        While both are built, the tokens at either side of the border change. The border holds if
        no pair across it has a rank before the next change (at equal rank the place further left
        goes first).
        """
        if left < 0:
            return self.bpe.merged(self._symbols(right)) == [right]
        pairs, spines = self.bpe.pairs, self.spines
        a, b = spines.get((left, 1)) or self._spine(left, 1), spines.get((right, 0)) or self._spine(right, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            across = pairs.get((x, y))
            if across and across[0] < x_until and across[0] <= y_until:
                return False
            if x_until <= y_until:
                if x_until == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _fits(self, left: int, right: int) -> bool:
        if len(self.fitting) > _FITTING:
            self.fitting.clear()
        # Whether a token is the encoding of its own text: one entry per token of the vocabulary at most.
        alone = self.alone.get(right)
        if alone is None:
            alone = self.alone[right] = self.fits(-1, right)
        known = self.fitting[left, right] = alone and (left < 0 or self.fits(left, right))
        return known

    def piece_counts(self, piece: str) -> list[int]:
        """Token count of each prefix of a piece, by character; each prefix is a word of its own.

        Words share prefixes, so only prefixes not met before are worked out.
        """
        raw = piece.encode("utf-8", "surrogatepass")
        if len(self.last) + len(raw) > _PREFIXES:
            self._forget()
        child, last, count, as_word, known = self.child, self.last, self.count, self.as_word, self.fitting.get
        letters, node, way = "", 0, [0]
        for i, byte in enumerate(raw, 1):
            found = child.get(node << 8 | byte)
            if found is None:
                letters = letters or words.as_letters(piece)
                found = child[node << 8 | byte] = len(last)
                # One way back finds the last token of the prefix inside a word (inner) and as a word (final).
                at, token, ends, j = self.ends, -1, 0, i
                while token < 0 or not ends:
                    j -= 1
                    step = at.get(letters[j]) if j >= 0 else None
                    if step is None:
                        raise ValueError("a prefix without an encoding")
                    inner, final, at = step
                    back = way[j]
                    before = last[back]
                    if final >= 0 and not ends:
                        fits = known((before, final))
                        if fits or fits is None and self._fits(before, final):
                            ends = count[back] + 1
                    if inner >= 0 and token < 0:
                        fits = known((before, inner))
                        if fits or fits is None and self._fits(before, inner):
                            token, tokens = inner, count[back] + 1
                as_word.append(ends)
                last.append(token)
                count.append(tokens)
            node = found
            way.append(node)
        if len(piece) == len(raw):
            counts = [as_word[k] for k in way[1:]]
        else:
            ends, at = [], 0
            for c in piece:
                at += len(c.encode("utf-8", "surrogatepass"))
                ends.append(at)
            counts = [as_word[way[k]] for k in ends]
        if piece in ("'re", "'ve", "'ll"):  # cut after two characters, these are two pieces
            counts[1] = sum(len(self.bpe.piece(c)) for c in piece[:2])
        return counts

    def piece_steps(self, piece: str) -> bytes:
        """Steps of the counts of a piece, as little-endian 32-bit integers."""
        counts = self.piece_counts(piece)
        steps = array("i", map(sub, counts, [0, *counts]))
        if sys.byteorder == "big":
            steps.byteswap()
        return steps.tobytes()

    def chunk_steps(self, chunk: str) -> bytes:
        """The same of a run without white space."""
        return b"".join(map(self.pieces.__getitem__, words.pieces(chunk)))

    def _steps_of(self, distinct: list[str]) -> list[bytes]:
        self.chunks.fresh(distinct)
        return list(map(self.chunks.__getitem__, distinct))

    def all_steps(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """``text_steps`` of each text; the runs of about ``GROUP_CHARS`` characters are looked up together."""
        group, held = [], 0
        for text in texts:
            group.append(text)
            held += len(text)
            if held >= words.GROUP_CHARS:
                yield from self._group_steps(group)
                group, held = [], 0
        yield from self._group_steps(group)

    def _group_steps(self, texts: list[str]) -> Iterator[np.ndarray]:
        plain = ["" if "<|" in t else words.normal(t) for t in texts]
        found = words.gathered([words.chunks(t) for t in plain], self._steps_of)
        for text, segment, flat in zip(texts, plain, found, strict=True):
            yield self.text_steps(text) if "<|" in text else _placed(segment, np.frombuffer(flat, "<i4"))

    def text_steps(self, text: str) -> np.ndarray:
        """Step of the prefix count at each character of the normal text."""
        parts, done = [], ""
        for part, special in words.segments(text):
            if special:
                # Until its last character a special string is ordinary text after the run before it.
                runs = words.chunks(done)
                run = runs[-1] if runs and done.endswith(runs[-1]) else ""
                steps = self.segment_steps(run + part)[len(run) :].copy()
                steps[-1] = 1 - int(steps[:-1].sum())
                parts.append(steps)
                done = ""
            else:
                done = words.normal(part)
                parts.append(self.segment_steps(done))
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def segment_steps(self, segment: str) -> np.ndarray:
        return _placed(segment, np.frombuffer(b"".join(map(self.chunks.__getitem__, words.chunks(segment))), "<i4"))


_IS_SPACE = np.zeros(0x3002, bool)
_IS_SPACE[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def _placed(segment: str, flat: np.ndarray) -> np.ndarray:
    """Steps of a segment's characters, from those of its runs: white space has none."""
    if len(flat) == len(segment):
        return flat
    out = np.zeros(len(segment), np.int32)
    if segment.isascii():
        codes = np.frombuffer(segment.encode(), np.uint8)
    else:
        codes = np.minimum(np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), "<u4"), len(_IS_SPACE) - 1)
    out[~_IS_SPACE[codes]] = flat
    return out


def _backwards(inner: dict[str, int], final: dict[str, int]) -> dict[str, tuple[int, int, dict]]:
    """Tokens by their letters from the last to the first: a step gives the inner and the final token of these letters (or -1) and the steps on."""
    root: dict = {}
    for text in {*inner, *final}:
        steps = root
        for k in range(len(text) - 1, -1, -1):
            if text[k] not in steps:
                so_far = text[k:]
                steps[text[k]] = (inner.get(so_far, -1), final.get(so_far, -1), {})
            steps = steps[text[k]][2]
    return root


def _counter(path: str) -> PrefixCounts:
    return held("prefix_counts", path, lambda: PrefixCounts(path))


def packed(steps: np.ndarray) -> bytes:
    """Width in bytes, then the steps in the narrowest signed type that holds them."""
    for width in (1, 2):
        info = np.iinfo(f"i{width}")
        if not len(steps) or (steps.min() >= info.min and steps.max() <= info.max):
            return bytes([width]) + steps.astype(f"<i{width}").tobytes()
    return b"\x04" + steps.astype("<i4").tobytes()


def unpacked(table: bytes) -> np.ndarray:
    return np.frombuffer(table, f"<i{table[0]}", offset=1)


def prefix_table(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Add ``prefix_table``, the binary table of each whole text, and its last count ``n_tokens``.

    Row by row, no shuffle. Null and empty texts give a table without steps and 0. Columns of these
    names are replaced, others stay.
    """
    where = path or default_path()

    @F.arrow_udf(StructType([StructField("prefix_table", BinaryType()), StructField("n_tokens", LongType())]))
    def tables(texts: pa.Array) -> pa.Array:
        counter, found, totals = _counter(where), [], []
        for steps in counter.all_steps(t.as_py() for t in texts):
            found.append(packed(steps))
            totals.append(int(steps.sum(dtype=np.int64)))
        return pa.StructArray.from_arrays([pa.array(found, pa.binary()), pa.array(totals, pa.int64())], ["prefix_table", "n_tokens"])

    # Spark would otherwise build the tables anew for each use.
    made = docs.withColumn("_made", tables.asNondeterministic()(whole(text)))
    return made.withColumns({"prefix_table": F.col("_made.prefix_table"), "n_tokens": F.col("_made.n_tokens")}).drop("_made")


@F.arrow_udf(LongType())
def _tokens_at(tables: pa.Array, places: pa.Array) -> pa.Array:
    out = [
        None if t is None or p is None else int(unpacked(t)[: max(p, 0)].sum(dtype=np.int64))
        for t, p in zip(tables.to_pylist(), places.to_pylist(), strict=True)
    ]
    return pa.array(out, pa.int64())


@F.arrow_udf(LongType())
def _longest_prefix(tables: pa.Array, budgets: pa.Array) -> pa.Array:
    out = []
    for t, budget in zip(tables.to_pylist(), budgets.to_pylist(), strict=True):
        if t is None or budget is None:
            out.append(None)
            continue
        within = np.flatnonzero(np.cumsum(unpacked(t), dtype=np.int64) <= budget)
        out.append(int(within[-1]) + 1 if len(within) else 0)
    return pa.array(out, pa.int64())


def tokens_at(table: Column, characters: Column) -> Column:
    """Tokens of the prefix of so many characters of the normal text."""
    return _tokens_at(table, characters.cast("long"))


def longest_prefix(table: Column, budget: Column) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens."""
    return _longest_prefix(table, budget.cast("long"))


def token_counts(docs: DataFrame, limit: int = 2048, path: str | None = None) -> DataFrame:
    """doc_id, bytes, tokens and whether they exceed ``limit``, of every whole text."""
    counted = prefix_table(docs.select("doc_id", "text"), path)
    return counted.select(
        "doc_id", F.octet_length(whole("text")).cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > F.lit(limit)).alias("over_limit"),
    )
