"""Byte-pair merges of many words at once, in arrays.

For words of ASCII other than white space, apostrophes and control characters, and of Latin letters U+00C0 to
U+00FF: there the vocabulary's normaliser only lower-cases, and its pattern cuts runs of letters, single digits
and runs of marks.  Each step merges in every run its pair of lowest rank, the leftmost of equal ones, as the
tokenizers library does one run after another.
"""

from __future__ import annotations

import json

import numpy as np

from .bpe import byte_alphabet
from .piece_table import PieceTable
from .textbatch import mix64

LETTER, DIGIT, OTHER, LEAD, FOREIGN = range(5)
_KIND = np.full(256, FOREIGN, np.uint8)
_KIND[33:127] = OTHER
_KIND[39] = FOREIGN  # the pattern has its own words for what follows an apostrophe
_KIND[48:58] = DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[0xC3] = LEAD
_SECOND = np.zeros(256, bool)  # bytes after 0xC3 that make a letter
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LOW_SECOND = np.arange(256, dtype=np.uint8)
_LOW_SECOND[0x80:0x9F] += 32
_NEVER = np.int64(1) << 62
_PLACE_BITS = 31


class WordMerges:
    def __init__(self, definition: str):
        model = json.loads(definition)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int64)
        self.last = np.array([vocab[c + suffix] for c in alphabet], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[m[i]] for m in merges], np.uint64) for i in (0, 1))
        self.result = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.ranks = PieceTable(int(np.ceil(np.log2(4 * len(merges)))))
        self.ranks.add(mix64(left << np.uint64(32) | right))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, -1 for those that don't merge."""
        return self.ranks.find(mix64(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)))

    def known(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which words are of the characters above; ``data[first[i]:first[i + 1]]`` is word i, and none is empty."""
        kind = _KIND[data]
        bad = kind == FOREIGN
        bad[first[1:] - 1] |= kind[first[1:] - 1] == LEAD
        lead = np.flatnonzero((kind == LEAD) & ~bad)
        ok = _SECOND[data[lead + 1]]
        bad[lead[~ok]] = True
        bad[lead[ok] + 1] = False
        return ~np.logical_or.reduceat(bad, first[:-1])

    def encode(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of some ``known`` words has, and all ids in a row."""
        kind, after_lead = _KIND[data], np.zeros(len(data), bool)
        after_lead[np.flatnonzero(kind == LEAD) + 1] = True
        data = np.where(after_lead, _LOW_SECOND[data], _LOW[data])
        kind[(kind == LEAD) | after_lead] = LETTER
        begins = kind == DIGIT
        begins[1:] |= kind[1:] != kind[:-1]
        begins[first[:-1]] = True
        run = np.flatnonzero(begins)
        ends = np.append(run[1:], len(data))
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        alive = self._merge(symbols, run, ends)
        return np.add.reduceat(alive, first[:-1], dtype=np.int64), symbols[alive]

    def _merge(self, symbols: np.ndarray, run: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Merge in place; which symbols are left. A run's symbols are linked by ``after`` and ``before``."""
        n = len(symbols)
        alive, after, before = np.ones(n, bool), np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[run] = -1, -1
        best = np.full(n, _NEVER)  # rank and place of the pair that begins here

        def look(at: np.ndarray) -> None:
            rank = self.rank(symbols[at], symbols[after[at]]).astype(np.int64)
            best[at] = np.where(rank < 0, _NEVER, rank << _PLACE_BITS | at)

        look(np.flatnonzero(after >= 0))
        length = ends - run
        run, length = run[length > 1], length[length > 1]
        while len(run):
            # the values of the runs that still merge, back to back
            cut = np.cumsum(length) - length
            low = np.minimum.reduceat(best[np.repeat(run - cut, length) + np.arange(length.sum())], cut)
            go = low < _NEVER
            run, length, low = run[go], length[go], low[go]
            at, rank = low & ((1 << _PLACE_BITS) - 1), low >> _PLACE_BITS
            gone = after[at]
            symbols[at] = self.result[rank]
            alive[gone], best[at], best[gone] = False, _NEVER, _NEVER
            behind = after[gone]
            after[at] = behind
            more = behind >= 0
            before[behind[more]] = at[more]
            look(at[more])
            prior = before[at]
            look(prior[prior >= 0])
        return alive
