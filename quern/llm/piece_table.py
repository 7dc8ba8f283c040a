"""Tables of pieces of text in arrays: hashes to numbers, and the values of numbered pieces back to back."""

from __future__ import annotations

import numpy as np

TABLE_BITS = 20
#: bytes of spaces and line breaks, ASCII letters and digits, and other printable ASCII characters
BREAK, ALNUM, MARK = (np.zeros(256, bool) for _ in range(3))
BREAK[[10, 32]] = True
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
MARK[33:127] = ~ALNUM[33:127]


class PieceTable:
    """Numbers of hashes, by open addressing over arrays; holds at most 5/8 of its slots."""

    def __init__(self, bits: int = TABLE_BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.room = (5 << bits) // 8
        self.keys = np.zeros(1 << bits, np.uint64)
        self.number = np.full(1 << bits, -1, np.int32)
        self.n = 0

    def clear(self) -> None:
        self.number[:] = -1
        self.n = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        slot = (h & self.mask).astype(np.int64)
        out = self.number[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & int(self.mask)
            out[wrong] = self.number[slot[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[slot[wrong]] != h[wrong])]
        return out

    def add(self, h: np.ndarray) -> None:
        """Give distinct new hashes the next numbers, in their order."""
        numbers = np.arange(self.n, self.n + len(h), dtype=np.int32)
        slot, left = (h & self.mask).astype(np.int64), np.arange(len(h))
        while len(left):
            free = self.number[slot[left]] < 0
            asking = left[free]
            self.number[slot[asking]] = numbers[asking]
            won = self.number[slot[asking]] == numbers[asking]
            self.keys[slot[asking[won]]] = h[asking[won]]
            left = np.concatenate([left[~free], asking[~won]])
            slot[left] = (slot[left] + 1) & int(self.mask)
        self.n += len(h)


class Values:
    """Arrays of values for numbered pieces, back to back; they grow by doubling."""

    def __init__(self, *dtypes):
        self.flat = [np.zeros(1 << 12, d) for d in dtypes]
        self.first = np.zeros(1 << 12, np.int32)
        self.count = np.zeros(1 << 12, np.int32)
        self.n = self.size = 0

    def clear(self) -> None:
        self.n = self.size = 0

    def add(self, counts: np.ndarray, *values: np.ndarray) -> None:
        n, size = self.n + len(counts), self.size + len(values[0])
        if n > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros(n, np.int32)]) for x in (self.first, self.count))
        if size > len(self.flat[0]):
            self.flat = [np.concatenate([x, np.zeros(size, x.dtype)]) for x in self.flat]
        self.first[self.n : n] = self.size + np.cumsum(counts) - counts
        self.count[self.n : n] = counts
        for x, v in zip(self.flat, values, strict=True):
            x[self.size : size] = v
        self.n, self.size = n, size

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values each piece has, and where all of them stand in ``flat``."""
        counts = self.count[numbers].astype(np.int64)
        at = np.repeat(self.first[numbers] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return counts, at
