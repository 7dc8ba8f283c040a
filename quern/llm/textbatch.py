"""Vectorised words over Arrow string columns: no Python string is made per word.

A word is a run of bytes other than space and the control characters tab to carriage return
(``[^\\x20\\x09-\\x0D]+``); UTF-8 continuation bytes never fall in that set, so bytes do.
Words get 64-bit hashes: a polynomial over random byte codes, taken from prefix sums, then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(20240917)
_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = U64(int(_rng.integers(1, 1 << 62)) * 4 + 1)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_STEP = _rng.integers(1, 1 << 62, 64, dtype=np.uint64) * U64(2) + U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
#: ASCII letters and digits, and all bytes of other characters: words without ASCII punctuation.
IS_ALNUM = np.zeros(256, dtype=bool)
IS_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    """Powers of the base and of its inverse, grown as texts need."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


_powers = _Powers()

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not the C library of GNU
    _trim = None


def release() -> None:
    """Give freed memory back: the allocators of a worker that Spark keeps would hold the most it ever used."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


@dataclass
class Texts:
    """Some consecutive rows of a batch: their bytes back to back."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo


def texts_of(column: pa.Array, limit: int = 1 << 20) -> Iterator[Texts]:
    """Pieces of about ``limit`` bytes, each of whole texts; a null is an empty text. Freed memory goes back after a large column."""
    column = column.fill_null("").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield Texts(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi
    if offsets[-1] - offsets[0] >= limit:
        release()


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # of each text, the index of its first word; one more entry at the end


def words_of(t: Texts, kind: np.ndarray = IS_WORD) -> Words:
    inside = kind[t.data]
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(len(t) + 1, np.int64))
    cut = t.bounds[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    starts[cut] = inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, t.bounds)
    doc = np.repeat(np.arange(len(t)), np.diff(first))
    return Words(start, end, doc, first)


#: bytes of prefix sums at a time, so that tables of powers don't follow the longest text
STRETCH = 1 << 18


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; starts are in order."""
    if not len(start):
        return np.zeros(0, np.uint64)
    if len(data) > 2 * STRETCH and len(start) > 1:
        cut = np.unique(np.searchsorted(start, np.arange(0, len(data), STRETCH)))
        cut = cut[cut < len(start)]  # no span may begin in the last stretches
        parts = []
        for a, b in zip(cut, np.append(cut[1:], len(start)), strict=False):
            lo, hi = start[a], end[a:b].max()
            parts.append(_span_hashes(data[lo:hi], start[a:b] - lo, end[a:b] - lo))
        return np.concatenate(parts)
    return _span_hashes(data, start, end)


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _powers.upto(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * up[: len(data)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    h += (end - start).astype(np.uint64) * _STEP[63]
    return mix64(h)


def window_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, and the word index at which each begins; windows stay in a text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = h[:n] * _STEP[0]
    for j in range(1, k):
        w += h[j : j + n] * _STEP[j]
    ok = np.ones(n, dtype=bool)
    for j in range(1, k):
        at = first[1:-1] - j
        ok[at[(at >= 0) & (at < n)]] = False
    at = np.flatnonzero(ok)
    return mix64(w[at]), at


def sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]."""
    sums = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.kind in "iub" else np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
