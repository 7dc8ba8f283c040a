"""Byte-pair encoding and decoding with a public vocabulary file.

A word's symbols form a doubly linked list; candidate merges wait in a priority queue ordered by
(rank, place).  A popped entry whose symbols have changed since it was pushed is stale and skipped.
Decoding joins vocabulary strings.  The file's normaliser (NFC, white space to a space, lower case),
its pattern and its byte alphabet are followed, and its special tokens are found in the raw text first.

Texts are cut at spaces and line breaks, and between an ASCII letter or digit and an ASCII mark, before the
pattern runs: no match crosses such a place, and a new one begins there.  Each distinct piece is encoded once; after
that a worker finds its ids and strings by a 64-bit hash, in arrays of some 60 MB at most (``TABLE_BITS``).
A full table is emptied; that changes no result.

Nulls: a null text is an empty text, with no ids.  A null id keeps its row.  Repeated rows get equal
results; empty input gives empty output.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents
from .piece_table import ALNUM, BREAK, MARK, PieceTable, Values
from .textbatch import Texts, span_hashes, texts_of, words_of

TABLE_BITS = 20


def pieces_of(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces between spaces and line breaks, cut again before marks after an ASCII letter or digit."""
    w = words_of(t, ~BREAK)
    begins, ends = np.zeros(len(t.data) + 1, bool), np.zeros(len(t.data) + 1, bool)
    begins[w.start], ends[w.end] = True, True
    marks = np.flatnonzero(MARK[t.data[1:]] & ALNUM[t.data[:-1]]) + 1
    marks = marks[~begins[marks]]  # else they begin a text
    begins[marks] = ends[marks] = True
    return np.flatnonzero(begins), np.flatnonzero(ends)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b], extra = chr(extra), extra + 1
    return [table[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder for a vocabulary with word-end symbols."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(merges)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        (split,) = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        if any(s[:2] != "<|" for s in self.special):
            raise ValueError("special tokens must begin with <|")
        self.alphabet = byte_alphabet()
        # " " + text of each id, back to back: decimal and decoded
        size = max(self.strings) + 1
        self.shown = []
        for texts in ([f" {i}" for i in range(size)], [" " + self.strings.get(i, "") for i in range(size)]):
            raw = [x.encode() for x in texts]
            self.shown.append((np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))
        self.table, self.values = PieceTable(TABLE_BITS), [Values(np.int32), Values(np.uint8), Values(np.uint8)]

    def __setattr__(self, name, value):
        object.__setattr__(self, name, value)
        if name in ("ranks", "vocab"):
            object.__setattr__(self, "numbered", None)

    def _number_symbols(self) -> tuple:
        """Symbols as numbers: of bytes, of bytes that end a word; ``rank << 32`` of pairs; pairs, results and ids by rank."""
        names = [*self.vocab, *self.alphabet, *(x + self.suffix for x in self.alphabet), *(x for a, b in self.ranks for x in (a, b, a + b))]
        number = {s: i for i, s in enumerate(dict.fromkeys(names))}
        by_rank = {rank: (number[a], number[b], number[a + b]) for (a, b), rank in self.ranks.items()}
        pairs = {a << 20 | b: rank << 32 for rank, (a, b, _) in by_rank.items()}
        ids = [self.vocab.get(s) for s in number]
        return [number[x] for x in self.alphabet], [number[x + self.suffix] for x in self.alphabet], pairs, by_rank, ids

    def merge_word(self, word: str) -> list[int]:
        """Ids of one match of the pattern."""
        if self.numbered is None:
            self.numbered = self._number_symbols()
        of_byte, of_last, pairs, by_rank, ids = self.numbered
        raw = word.encode("utf-8", "surrogatepass")
        symbols = [of_byte[b] for b in raw]
        symbols[-1] = of_last[raw[-1]]
        n, pair = len(symbols), pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # an entry is rank << 32 | place
        queue = [rank | i for i in range(n - 1) if (rank := pair(symbols[i] << 20 | symbols[i + 1])) is not None]
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            left, right, both = by_rank[entry >> 32]
            if symbols[i] != left:
                continue
            j = after[i]
            if j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = both, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := pair(both << 20 | symbols[k])) is not None:
                    push(queue, rank | i)
            if (h := before[i]) >= 0 and (rank := pair(symbols[h] << 20 | both)) is not None:
                push(queue, rank | h)
        return [ids[s] for s in symbols if s >= 0 and ids[s] is not None]

    def normalise(self, text: str) -> str:
        # a capital sigma is lowered on its own, not as the end of a word
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of a piece of raw text between white space, without special tokens in it."""
        if piece.isascii():
            piece = piece.lower()
        else:
            piece = self.normalise(piece)
        ids: list[int] = []
        for word in self.pattern.findall(piece):
            ids += self.merge_word(word)
        return ids

    def _learn(self, pieces: list[bytes]) -> None:
        ids = [self.encode_piece(x.decode()) for x in pieces]
        counts, flat = np.array([len(x) for x in ids], np.int32), np.array([i for x in ids for i in x], np.int32)
        self.values[0].add(counts, flat)
        cut = np.append(0, np.cumsum(counts))
        for values, (text, first) in zip(self.values[1:], self.shown, strict=True):
            length = np.diff(first)[flat]
            at = np.repeat(first[flat] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            values.add(np.diff(np.append(0, np.cumsum(length))[cut]), text[at])

    def _numbers(self, t: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of pieces in a table that holds them all."""
        h = span_hashes(t.data, start, end)
        numbers = self.table.find(h)
        missing = np.flatnonzero(numbers < 0)
        if not len(missing):
            return numbers
        new, at = np.unique(h[missing], return_index=True)
        if self.table.n + len(new) > self.table.room:
            numbers[:] = -1
            missing = np.arange(len(h))
            new, at = np.unique(h, return_index=True)
            self.table = PieceTable(max(TABLE_BITS, int(np.ceil(np.log2(len(new) * 2)))))
            self.values = [Values(np.int32), Values(np.uint8), Values(np.uint8)]
        at = missing[at]
        self._learn([t.data[a:b].tobytes() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
        self.table.add(new)
        numbers[missing] = self.table.find(h[missing])
        return numbers

    def encode_texts(self, t: Texts) -> list[tuple[np.ndarray, bytes, bytes]]:
        """Ids, decimal ids joined by a space and decoded text (UTF-8) of each text."""
        start, end = pieces_of(t)
        numbers, of_text = self._numbers(t, start, end), np.searchsorted(start, t.bounds)
        found = []
        for values in self.values:
            counts, at = values.of(numbers)
            cut = np.append(0, np.cumsum(counts))[of_text].tolist()
            flat = values.flat[0][at]
            found.append([flat[a:b] for a, b in zip(cut, cut[1:], strict=False)])
        out = [(ids, shown[1:].tobytes(), decoded[1:].tobytes()) for ids, shown, decoded in zip(*found, strict=True)]
        bar = np.flatnonzero(t.data[1:] == 124)  # special tokens begin with "<|"
        for i in np.unique(np.searchsorted(t.bounds, bar[t.data[bar] == 60], side="right") - 1).tolist():
            text = t.data[t.bounds[i] : t.bounds[i + 1]].tobytes().decode()
            if self.special_pattern.search(text):
                ids = []
                for k, part in enumerate(self.special_pattern.split(text)):
                    ids += [self.special[part]] if k % 2 else [n for x in part.replace("\n", " ").split(" ") for n in self.encode_piece(x)]
                out[i] = np.array(ids, np.int32), " ".join(map(str, ids)).encode(), self.decode(ids).encode()
        return out

    def encode(self, text: str) -> list[int]:
        return [i for t in texts_of(pa.array([text], pa.string())) for x in self.encode_texts(t) for i in x[0].tolist()]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by a space, as with a file that names no decoder; unknown ids are left out."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])


_coders: dict[str, WordBpe] = {}


def coder(definition: str) -> WordBpe:
    """One coder for each definition in a worker, kept between tasks."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = WordBpe(definition)
    return _coders[key]


def tokenizer_definition(path: str | None, name: str) -> str:
    """The text of a tokenizer file; by default the public file of that name. The driver reads it and broadcasts it."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_round_trip(docs: DataFrame, tokenizer_path: str | None = None, *, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and with ``with_ids`` ids and decoded text."""
    definition = docs.sparkSession.sparkContext.broadcast(tokenizer_definition(tokenizer_path, "word_bpe_49k.json"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids

    def run(batches):
        bpe = coder(definition.value)
        digest = hashlib.sha256
        for batch in batches:
            for t in texts_of(batch.column(1)):
                ids, shown, decoded = zip(*bpe.encode_texts(t), strict=True)
                columns = [
                    batch.column(0).slice(t.lo, len(t)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([digest(x).hexdigest() for x in shown]),
                    pa.array([digest(x).hexdigest() for x in decoded]),
                ]
                if with_ids:
                    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))))
                    columns.append(pa.array(decoded, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op6_bpe(spark, sf_dir):
    return bpe_round_trip(documents(spark, sf_dir))


def bpe_stage(spark, docs, sf_dir):
    """Ids and their digests of each document that is left."""
    return bpe_round_trip(docs, with_ids=True)
