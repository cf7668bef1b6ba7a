"""Whole Arrow batches of texts as NumPy arrays: words, their hashes, and windows of words.

A text column arrives as one UTF-8 buffer with offsets. The functions here look at that buffer as bytes, so
work on words costs a few array operations per byte and no Python step per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19  # texts are taken in groups of about this size, to bound the temporary arrays
LONG_BYTES = 1 << 21  # beyond this a text is read in slices
_U64 = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry table that is true inside the (first, last) ranges."""
    table = np.zeros(256, bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))  # words between ASCII white space
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))  # ASCII letters and digits, or not ASCII


def _up_to(size: int) -> int:
    return 1 << max(16, int(size).bit_length())


_POWERS: dict[int, np.ndarray] = {}  # for each base the longest table so far


def powers(base: int, size: int) -> np.ndarray:
    """The first ``size`` powers of ``base`` modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known) < size:
        steps = np.full(_up_to(size), base, _U64)
        steps[0] = 1
        known = _POWERS[base] = np.cumprod(steps, dtype=_U64)
    return known[:size]


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


@dataclass
class Texts:
    """Some texts of a batch: lower-cased (A-Z only) bytes, and where each text starts (one more entry at the end)."""

    raw: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The texts of a column in order, in groups of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        low, high = offsets[first], offsets[last]
        yield Texts(data[low:high], offsets[first : last + 1] - low)
        first = last


@dataclass
class Words:
    """Words of some texts: byte bounds, a hash of each, and for each text its first word (one more at the end)."""

    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(
    texts: Texts, inside: np.ndarray, lower: bool = True, parts: tuple[np.ndarray, np.ndarray] | None = None, limit: int = LONG_BYTES
) -> Words:
    """Maximal runs of bytes of the class ``inside``; runs end where a text ends.

    With ``parts``, two byte classes, a run is also cut wherever a byte of one class meets one of the other. A long text is
    read in slices that end between words, so the temporary arrays do not grow with it.
    """
    size, low, found = len(texts.raw), 0, []
    while not found or low < size:
        high = min(low + limit, size)
        while high < size:  # to the end of the word
            ahead = texts.raw[high : high + limit]
            gap = np.flatnonzero(~inside[LOWER[ahead] if lower else ahead])
            if len(gap):
                high += int(gap[0])
                break
            high += len(ahead)
        first, last = np.searchsorted(texts.starts, low), np.searchsorted(texts.starts, high, "right")
        of = _words(Texts(texts.raw[low:high], np.unique(np.concatenate([[low], texts.starts[first:last]])) - low), inside, lower, parts)
        found.append((of.begin + low, of.end + low, of.hash))
        low = high
    if len(found) == 1:
        begin, end, code = found[0]
    else:
        begin, end, code = (np.concatenate(x) for x in zip(*found))
    return Words(begin, end, code, np.searchsorted(begin, texts.starts))


def _words(texts: Texts, inside: np.ndarray, lower: bool, parts: tuple[np.ndarray, np.ndarray] | None) -> Words:
    raw = LOWER[texts.raw] if lower else texts.raw
    size = len(raw)
    mask = np.zeros(size + 1, bool)
    mask[:size] = inside[raw]
    before = np.zeros(size + 1, bool)
    before[1:] = mask[:-1]
    cut = np.zeros(size + 1, bool)  # a text starts here: the run before it is over
    cut[texts.starts] = True
    if parts is not None and size > 1:
        one, other = parts[0][raw], parts[1][raw]
        cut[1:size] |= (one[:-1] & other[1:]) | (other[:-1] & one[1:])
    begin = np.flatnonzero(mask & (~before | cut))
    end = np.flatnonzero(before & (~mask | cut))
    total = np.zeros(size + 1, _U64)
    if size:
        np.cumsum(_BYTE_VALUE[raw] * powers(_BASE, size), dtype=_U64, out=total[1:])
    code = (total[end] - total[begin]) * powers(_INVERSE, size + 1)[begin]
    return Words(begin, end, mix(code + (end - begin).astype(_U64)), np.searchsorted(begin, texts.starts))


def windows(word: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all runs of ``length`` words that stay inside one text."""
    n = len(word.hash)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, _U64)
    code = word.hash[: n - length + 1].copy()
    for k in range(1, length):
        code *= _U64(_BASE)
        code += word.hash[k : n - length + 1 + k]
    text = np.repeat(np.arange(len(word.first) - 1), word.counts())
    whole = np.flatnonzero(text[: n - length + 1] == text[length - 1 :])
    return whole, mix(code[whole] + _U64(length))


def word_bytes(texts: Texts, word: Words, at: int, length: int, lower: bool = True) -> bytes:
    """``length`` words from word ``at`` on, joined by one space."""
    raw = texts.raw
    parts = [raw[word.begin[k] : word.end[k]] for k in range(at, at + length)]
    if lower:
        parts = [LOWER[p] for p in parts]
    return b" ".join(p.tobytes() for p in parts)


def run_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs from ``begin`` to ``end``, which depend on their bytes and lengths only."""
    total = np.zeros(len(raw) + 1, _U64)
    if len(raw):
        np.cumsum(_BYTE_VALUE[raw] * powers(_BASE, len(raw)), dtype=_U64, out=total[1:])
    code = (total[end] - total[begin]) * powers(_INVERSE, len(raw) + 1)[begin]
    return mix(code + (end - begin).astype(_U64))
