"""Whole texts through the tokenizers library, each distinct piece once.

Texts are cut into pieces with numpy, at places that no match of a byte-level pattern crosses and at which a
new match begins: before a single space or line break between two characters that aren't white space, and
between an ASCII letter or digit and an ASCII mark after it.  So a text encodes to the ids of its pieces in a
row.  Pieces are known by 64-bit hashes in a table of fixed size (``TABLE_BITS``); the library encodes those that
are new.  A full table is emptied, which changes no result, and no Python object is kept for a piece, so a
worker's table never holds more than about 30 MB.  Texts with the string of a special token go to the library whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from .piece_table import ALNUM, BREAK, MARK, PieceTable, Values
from .textbatch import Texts, span_hashes, texts_of

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: other characters that str.isspace() holds for, as bytes
_WIDE_SPACE = [chr(c).encode() for c in range(128, 0x3001) if chr(c).isspace()]


def white(data: np.ndarray) -> np.ndarray:
    """Which bytes are of a white-space character."""
    out = _SPACE[data]
    for lead in {c[0] for c in _WIDE_SPACE}:
        at = np.flatnonzero(data == lead)
        for c in _WIDE_SPACE:
            if c[0] == lead and len(at):
                here = at[at + len(c) <= len(data)]
                for i in range(1, len(c)):
                    here = here[data[here + i] == c[i]]
                for i in range(len(c)):
                    out[here + i] = True
    return out


class LibraryEncoder:
    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content.encode() for t in added.values() if t.content]
        vocab = self.tokenizer.get_vocab()
        size = max([*vocab.values(), 0]) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # a byte-level vocabulary has a character for each byte
        self.n_bytes = np.zeros(size, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)
        self.ids = PieceTable(), Values(self.dtype)
        self.spans = PieceTable(), Values(np.int32, np.int32)

    def whole(self, t: Texts) -> np.ndarray:
        """Which texts may hold a special token's string."""
        out = np.zeros(len(t), bool)
        for s in self.special:
            at = np.flatnonzero(t.data == s[0])
            if len(s) > 1:
                at = at[at + 1 < len(t.data)]
                at = at[t.data[at + 1] == s[1]]
            out[np.searchsorted(t.bounds, at, side="right") - 1] = True
        return out

    @staticmethod
    def pieces(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of pieces, and which may stand in a row with others of the kind, to be encoded together."""
        data, n = t.data, len(t.data)
        blank = white(data)
        begins = np.zeros(n, bool)
        first = t.bounds[:-1][np.diff(t.bounds) > 0]
        if n > 2:
            begins[1:-1] = BREAK[data[1:-1]] & ~blank[:-2] & ~blank[2:]
        if n > 1:
            # a break that ends its text isn't before a character of that text
            ends_text = t.bounds[1:-1] - 1
            begins[ends_text[ends_text >= 0]] = False
            begins[1:] |= MARK[data[1:]] & ALNUM[data[:-1]]
        spaced = begins & BREAK[data]
        begins[first], spaced[first] = True, False
        start = np.flatnonzero(begins)
        end = np.append(start[1:], n) if len(start) else start
        return start, end, spaced[start] & ~blank[end - 1]

    def _numbers(self, t: Texts, kept, learn_joined, learn_single) -> tuple[np.ndarray, np.ndarray]:
        """Starts of pieces and their numbers in a table that holds them all."""
        table, values = kept
        start, end, joinable = self.pieces(t)
        h = span_hashes(t.data, start, end)
        numbers = table.find(h)
        for again in (False, True):
            missing = np.flatnonzero(numbers < 0)
            if not len(missing):
                return start, numbers
            new, at = np.unique(h[missing], return_index=True)
            if again or table.n + len(new) <= table.room:
                break
            table.clear()
            values.clear()
            numbers[:] = -1
        if len(new) > table.room:  # one huge text: a table for it alone
            table.__init__(int(np.ceil(np.log2(len(new) * 2))))
            values.clear()
        at = missing[at]
        for together in (True, False):
            mine = np.flatnonzero(joinable[at] == together)
            raw = [t.data[a:b].tobytes() for a, b in zip(start[at[mine]].tolist(), end[at[mine]].tolist(), strict=True)]
            if raw:
                values.add(*(learn_joined if together else learn_single)(raw))
                table.add(new[mine])
        numbers[missing] = table.find(h[missing])
        return start, numbers

    def _joined_ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of pieces that begin with a break and end without one."""
        got = np.array(self.tokenizer.encode_batch_fast([b"".join(pieces).decode()], add_special_tokens=False)[0].ids, np.int64)
        stop = np.searchsorted(np.cumsum(self.n_bytes[got]), np.cumsum([len(x) for x in pieces])) + 1
        return np.diff(stop, prepend=0), got.astype(self.dtype)

    def _single_ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in self.tokenizer.encode_batch_fast([x.decode() for x in pieces], add_special_tokens=False)]
        return np.array([len(x) for x in got]), np.array([i for x in got for i in x], self.dtype)

    def _joined_spans(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names = [x.decode() for x in pieces]
        offsets = np.array(self.tokenizer.encode("".join(names), add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        length = np.array([len(x) for x in names])
        at = np.cumsum(length) - length
        counts = np.diff(np.append(np.searchsorted(offsets[:, 0], at), len(offsets)))
        own = offsets - np.repeat(at, counts)[:, None]
        return counts, own[:, 0], own[:, 1]

    def _single_spans(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = [x.offsets for x in self.tokenizer.encode_batch([x.decode() for x in pieces], add_special_tokens=False)]
        flat = np.array([o for x in got for o in x], np.int64).reshape(-1, 2)
        return np.array([len(x) for x in got]), flat[:, 0], flat[:, 1]

    def ids_of(self, t: Texts) -> list[np.ndarray]:
        """Ids of each text."""
        start, numbers = self._numbers(t, self.ids, self._joined_ids, self._single_ids)
        counts, at = self.ids[1].of(numbers)
        flat = self.ids[1].flat[0][at]
        cut = np.append(0, np.cumsum(counts))[np.searchsorted(start, t.bounds)].tolist()
        out = [flat[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        for i in np.flatnonzero(self.whole(t)).tolist():
            text = t.data[t.bounds[i] : t.bounds[i + 1]].tobytes().decode()
            out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
        return out

    def spans_of(self, t: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
        """Character starts and ends of each text's tokens; bytes of one character share its span."""
        start, numbers = self._numbers(t, self.spans, self._joined_spans, self._single_spans)
        counts, at = self.spans[1].of(numbers)
        characters = np.append(0, np.cumsum((t.data & 0xC0) != 0x80))
        of_piece = np.searchsorted(start, t.bounds)
        own = characters[start] - np.repeat(characters[t.bounds[:-1]], np.diff(of_piece))
        base = np.repeat(own, counts)
        starts, ends = (base + x[at] for x in self.spans[1].flat)
        cut = np.append(0, np.cumsum(counts))[of_piece].tolist()
        out = [(starts[a:b], ends[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        for i in np.flatnonzero(self.whole(t)).tolist():
            text = t.data[t.bounds[i] : t.bounds[i + 1]].tobytes().decode()
            offsets = np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
            out[i] = offsets[:, 0], offsets[:, 1]
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        return [x for t in texts_of(pa.array(texts, pa.string())) for x in self.ids_of(t)]

    def spans_batch(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [x for t in texts_of(pa.array(texts, pa.string())) for x in self.spans_of(t)]


_encoders: dict[str, LibraryEncoder] = {}


def library_encoder(definition: str) -> LibraryEncoder:
    """One encoder for each definition in a worker, kept between tasks."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = LibraryEncoder(definition)
    return _encoders[key]
