"""Text units of the word-end BPE vocabulary: special strings, normal form, white-space chunks, pieces."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from .common import MEMO_ENTRIES, Memo

# Fixed values of the vocabulary file: its special strings and its splitting pattern.
SPECIAL = {"<|startoftext|>": 49406, "<|endoftext|>": 49407}
SPACE = r"\t-\r \x85\xa0  -     　"
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")

_SPECIAL = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")
# Control characters that str.split drops although the vocabulary's pattern keeps them.
_KEPT_CONTROLS = re.compile("[\x1c-\x1f]")
_RUNS = re.compile(f"[^{SPACE}]+")


@lru_cache(1)
def byte_letters() -> list[str]:
    """Printable stand-in of every byte: itself if printable, else the next free code from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, free = [""] * 256, 256
    for b in range(256):
        if b in printable:
            letters[b] = chr(b)
        else:
            letters[b], free = chr(free), free + 1
    return letters


def as_letters(piece: str) -> str:
    if piece.isascii() and piece.isalnum():
        return piece
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_letter_table())


def all_letters(pieces: list[str]) -> list[str]:
    """``as_letters`` of each piece, in one go; line ends, which no piece has, part them."""
    joined = "\n".join(pieces).encode("utf-8", "surrogatepass").decode("latin-1")
    return joined.translate(_letter_table() | {10: "\n"}).split("\n") if pieces else []


@lru_cache(1)
def _letter_table() -> dict[int, str]:
    return dict(enumerate(byte_letters()))


def normal(segment: str) -> str:
    """NFC, then lower case character by character (a final sigma has no form of its own)."""
    if not segment.isascii():
        if not unicodedata.is_normalized("NFC", segment):
            segment = unicodedata.normalize("NFC", segment)
        if "Σ" in segment:
            segment = segment.replace("Σ", "σ")
    return segment.lower()


def chunks(segment: str) -> list[str]:
    """Runs without white space of a normal segment; no piece crosses them."""
    return _RUNS.findall(segment) if _KEPT_CONTROLS.search(segment) else segment.split()


def pieces(chunk: str) -> list[str]:
    """Pieces of a run without white space; one of a-z alone is a piece, also before a single sign."""
    if chunk.isascii():
        if chunk.isalpha():
            return [chunk]
        if chunk[:-1].isalpha() and not chunk[-1].isdigit():
            return [chunk[:-1], chunk[-1]]
    return PIECE.findall(chunk)


def segments(text: str) -> Iterator[tuple[str, bool]]:
    """(part, is special) in text order; special strings are taken out of the text as it is."""
    if "<|" not in text:
        yield text, False
        return
    for part in _SPECIAL.split(text):
        if part:
            yield part, part in SPECIAL


# Characters of text whose chunks are held at a time.
GROUP_CHARS = 1 << 22


def gathered(runs: list[list[str]], codes: Callable[[list[str]], list[bytes] | pa.Array]) -> Iterator[bytes]:
    """Joined codes of the chunks of each run; ``codes`` is asked for those of distinct chunks only."""
    flat = pa.array(list(chain.from_iterable(runs)), pa.large_string()).dictionary_encode()
    # The next line gives every chunk its code, end to end; the offsets say where.
    offsets, data = _codes_of(flat, codes)
    data, at = memoryview(data), 0
    for run in runs:
        yield bytes(data[offsets[at] : offsets[at + len(run)]])
        at += len(run)


def _codes_of(flat: pa.DictionaryArray, codes: Callable[[list[str]], list[bytes] | pa.Array]) -> tuple[np.ndarray, pa.Buffer | bytes]:
    """(offsets, data) of the codes of all strings, of which ``codes`` is asked for the distinct ones."""
    distinct = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
    joined = pa.array(codes(distinct), pa.large_binary()).take(flat.indices)
    _, offsets, data = joined.buffers()
    return np.frombuffer(offsets, np.int64) if len(joined) else np.zeros(1, np.int64), data or b""


# Chunks, each on a line of its own, to pieces and line ends; a special string comes behind a space.
_PARTS = regex.compile("\n| (?:" + "|".join(map(re.escape, SPECIAL)) + ")|" + PIECE.pattern)


class TextCoder:
    """Concatenated code of the pieces of texts; pieces not in the memo are coded together.

    ``of_pieces`` gives the code (bytes) of each piece of a list, ``of_special`` that of a special
    string, which is a chunk of its own behind a space (no other chunk has one). Distinct chunks
    are cut in one call and only pieces are kept.
    """

    def __init__(self, of_pieces: Callable[[list[str]], list[bytes]], of_special: Callable[[str], bytes], entries: int = MEMO_ENTRIES):
        self.of_pieces = of_pieces
        # Parts that are no pieces.
        self.apart = {"\n": b""} | {" " + special: of_special(special) for special in SPECIAL}
        self.pieces = Memo(lambda piece: of_pieces([piece])[0], entries, turns=False)

    def codes(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        group, held = [], 0
        for text in texts:
            run = []
            for part, special in segments(text) if text else ():
                run += [" " + part] if special else chunks(normal(part))
            group.append(run)
            held += len(text) if text else 0
            if held >= GROUP_CHARS:
                yield from gathered(group, self._chunk_codes)
                group, held = [], 0
        yield from gathered(group, self._chunk_codes)

    def _chunk_codes(self, distinct: list[str]) -> pa.Array:
        if not distinct:
            return pa.array([], pa.large_binary())
        parts = pa.array(_PARTS.findall("\n".join(distinct)), pa.large_string()).dictionary_encode()
        # Line ends have no code, so the codes of the chunks lie end to end as well.
        line_end = parts.dictionary.index("\n").as_py()
        offsets, data = _codes_of(parts, self._part_codes)
        ends = np.r_[0, offsets[np.flatnonzero(parts.indices.to_numpy() == line_end)], offsets[-1]]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(distinct), [None, pa.py_buffer(ends), pa.py_buffer(data)])

    def _part_codes(self, distinct: list[str]) -> list[bytes]:
        self.pieces.turn()
        self.pieces.update(self.apart)
        return self.pieces.all(distinct, self.of_pieces)
