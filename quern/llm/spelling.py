"""Spelling variants: words one edit apart, matched exactly in one half and with one error in the other.

Words are counted over all texts.  Their list, sorted, is cut into ranges of about ``RANGE`` words; so is the list of
reversed words.  A task builds the minimal acyclic automaton of one range, whose transitions carry how many words come
before, so walking a word yields its number in the range (a perfect hash) and with it its count.

A word is looked up in both directions.  Forward, its first half must match exactly, which takes it to the few ranges
that hold words with that prefix; the rest is completed with exactly one inserted, deleted or replaced code point.
Backward the same is done with reversed words and the other half.  One error lies in one half or the other, so no
near word is missed; one that both directions find (its first half equals the word's) counts in the forward one.
A range is held by its task, the words that ask for it stream by; no prefix, however common, is one group.

``n_near`` counts near words, ``form`` is the most frequent one if it is at least ``DOMINANT`` times as frequent
(ties: the smallest in code-point order).  Counts grow tenfold along a chain of forms, so roots are found in at
most five rounds of pointer doubling.

A run is ``[A-Za-z\\u00C0-\\u00FF]+``, A-Z lower-cased; a 31st of the runs, by a checksum of id and run, lose one code
point first.  Nulls: a null text has no run; a null id is an empty text in the checksum.  Repeated rows count again.
A run of any length is one word.  Empty tables give no rows.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise, workspace
from .textbatch import IS_WORD, LOWER, Texts, texts_of, words_of

LEAST_LENGTH, LEAST_COUNT, DOMINANT = 7, 2, 10
DROP_ONE_OF = 31
RANGE = 1 << 15
PIECE_BYTES = 8 << 20
LONG_RUN = 64  # bytes; longer ones get their checksum one by one

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


# ---- words and counts


def checksums(prefix: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes, continued from ``prefix`` (the CRC-32 of what comes before)."""
    size, out = end - start, np.zeros(len(start), np.uint32)
    state = ~prefix.astype(np.uint32)
    at = np.flatnonzero(size <= LONG_RUN)
    at = at[np.argsort(-size[at], kind="stable")]
    live, place, left = state[at], start[at], size[at]
    for j in range(int(left[0]) if len(left) else 0):
        m = int(np.searchsorted(-left, -j))  # those longer than j come first
        live[:m] = _CRC[(live[:m] ^ data[place[:m] + j]) & 255] ^ (live[:m] >> 8)
    out[at] = ~live
    for i in np.flatnonzero(size > LONG_RUN):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(prefix[i]))
    return out


def words_in(t: Texts, ids: pa.Array) -> pa.Array:
    """The words of some texts with repeats, of ``LEAST_LENGTH`` code points and more."""
    data = LOWER[t.data]
    pair = t.data == 0xC3  # the first byte of the letters from 192 to 255
    inside = pair | ((data >= 97) & (data <= 122))
    inside[1:] |= pair[:-1]
    w = words_of(Texts(t.lo, t.hi, np.where(inside, 1, 32).astype(np.uint8), t.bounds), IS_WORD)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    length = begins[w.end] - begins[w.start]
    keep = np.flatnonzero(length >= LEAST_LENGTH)
    start, end, doc, length = w.start[keep], w.end[keep], w.doc[keep], length[keep]
    asked = np.unique(doc)
    prefix = np.zeros(len(t), np.uint32)
    for d in asked.tolist():
        i = ids[t.lo + d].as_py()
        prefix[d] = zlib.crc32(f"{'' if i is None else i}:".encode())
    h = checksums(prefix[doc], data, start, end).astype(np.int64)

    hit = np.flatnonzero(h % DROP_ONE_OF == 0)
    first = np.flatnonzero((data & 0xC0) != 0x80)
    at = first[begins[start[hit]] + h[hit] % length[hit]]  # the code point that goes
    width = 1 + pair[at].astype(np.int64)
    gone = np.zeros(len(data), bool)
    gone[at] = True
    gone[at[width == 2] + 1] = True
    size = end - start
    size[hit] -= width
    length[hit] -= 1
    mine = np.flatnonzero(length >= LEAST_LENGTH)
    span = (end - start)[mine]
    source = np.repeat(start[mine] - (np.cumsum(span) - span), span) + np.arange(span.sum())
    flat = data[source[~gone[source]]]
    offsets = np.concatenate([[0], np.cumsum(size[mine])])
    return pa.Array.from_buffers(pa.large_string(), len(mine), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _count(batches):
    for batch in batches:
        for t in texts_of(batch.column(1), PIECE_BYTES):
            counts = pc.value_counts(words_in(t, batch.column(0)))
            yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts")], ["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words that occur ``LEAST_COUNT`` times at least."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---- automata


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; a word's number is its place in their order."""

    def __init__(self, words: list[str]):
        self.edges: list[dict] = []  # of each state: letter -> (state, words that come before)
        self.final: list[bool] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        path, last = [({}, False)], ""  # open states along the last word: edges so far, final

        def close(edges: dict, final: bool) -> int:
            key = (final, *edges.items())
            state = known.get(key)
            if state is None:
                state = known[key] = len(self.edges)
                before, out = int(final), {}
                for letter, target in edges.items():
                    out[letter] = (target, before)
                    before += self.size[target]
                self.edges.append(out)
                self.final.append(final)
                self.size.append(before)
            return state

        for word in [*words, None]:
            shared = 0
            if word is not None:
                most = min(len(word), len(last))
                while shared < most and word[shared] == last[shared]:
                    shared += 1
            while len(path) > shared + 1:
                edges, final = path.pop()
                path[-1][0][last[len(path) - 1]] = close(edges, final)
            if word is None:
                break
            for _ in word[shared:]:
                path.append(({}, False))
            path[-1] = (path[-1][0], True)
            last = word
        self.root = close(*path[0])

    def walk(self, word: str, state: int, number: int) -> tuple[int, int]:
        """State and number after the letters of ``word``; state -1 if there is no way."""
        edges = self.edges
        for letter in word:
            step = edges[state].get(letter)
            if step is None:
                return -1, 0
            state, number = step[0], number + step[1]
        return state, number

    def one_error(self, word: str, exact: int) -> set[int]:
        """Numbers of words that begin with ``word[:exact]`` and are one insertion, deletion or replacement from it."""
        state, number = self.walk(word[:exact], self.root, 0)
        found, edges, final = set(), self.edges, self.final
        for i in range(exact, len(word) + 1):
            if state < 0:
                break
            own, rest = (word[i], word[i + 1 :]) if i < len(word) else (None, "")
            if own is not None:
                end, at = self.walk(rest, state, number)  # deleted
                if end >= 0 and final[end]:
                    found.add(at)
            for letter, (target, before) in edges[state].items():
                end, at = self.walk(word[i:], target, number + before)  # inserted
                if end >= 0 and final[end]:
                    found.add(at)
                if own is not None and letter != own:
                    end, at = self.walk(rest, target, number + before)  # replaced
                    if end >= 0 and final[end]:
                        found.add(at)
            state, number = self.walk(own or "", state, number) if own is not None else (-1, 0)
        return found


def near_in(lexicon: Automaton, words: list[str], key: str, exact: int, backward: bool) -> list[int]:
    """Numbers of the near words of ``key`` that this direction counts."""
    found = lexicon.one_error(key, exact)
    if backward and found:  # those that agree with the word's first half are found forward
        half = len(key) - exact
        head = key[::-1][:half]
        return [i for i in found if words[i][::-1][:half] != head]
    return list(found)


# ---- over ranges


def _asking(bounds, backward: bool):
    """(part, asks, key, exact) of each word and range that it must be looked up in."""

    def run(batches):
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                half = len(key) // 2
                exact = len(key) - half if backward else half
                lo = max(0, bisect.bisect_right(bounds, key[:exact]) - 1)
                hi = max(lo, bisect.bisect_left(bounds, key[:exact] + "￿") - 1)  # letters are below 256
                rows += [(part, key, exact) for part in range(lo, hi + 1)]
            part, key, exact = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([True] * len(part)), pa.array(key, pa.string()), pa.array(exact, pa.int64())], ["part", "asks", "key", "n"])

    return run


def _look_up(backward: bool):
    """Rows come sorted by part: the words of a range with counts, then those that ask."""

    def run(batches):
        part, words, counts, lexicon = None, [], [], None
        for batch in batches:
            rows = []
            for p, asks, key, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if p != part:
                    part, words, counts, lexicon = p, [], [], None
                if not asks:
                    words.append(key)
                    counts.append(n)
                    continue
                if lexicon is None:
                    lexicon = Automaton(words)
                found = near_in(lexicon, words, key, n, backward)
                if found:
                    best = min((-counts[i], words[i][::-1] if backward else words[i]) for i in found)
                    rows.append((key[::-1] if backward else key, len(found), *best))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "less", "form"])

    return run


def _direction(words: DataFrame, n_ranges: int, backward: bool, path: str) -> DataFrame:
    """(word, n_near, less, form) of words with near words, for one direction and range; ``less`` is the negated count."""
    listed = words.select(F.reverse("word").alias("key") if backward else F.col("word").alias("key"), "n")
    cut = materialise(listed.repartitionByRange(n_ranges, "key").withColumn("part", F.spark_partition_id()), path)
    starts = cut.groupBy("part").agg(F.min("key").alias("key")).orderBy("key").collect()  # one for RANGE words
    ranges = words.sparkSession.createDataFrame([(r["part"], i) for i, r in enumerate(starts)] or [(0, 0)], "part int, at int")
    held = cut.join(F.broadcast(ranges), "part").select(F.col("at").alias("part"), F.lit(False).alias("asks"), "key", "n")
    asking = cut.select("key").mapInArrow(_asking([r["key"] for r in starts], backward), "part int, asks boolean, key string, n long")
    met = held.unionByName(asking).repartition("part").sortWithinPartitions("part", "asks", "key")
    return met.mapInArrow(_look_up(backward), "word string, n_near long, less long, form string")


def spelling_groups(docs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    path = workspace(docs.sparkSession, "spelling")
    words = materialise(word_counts(docs), f"{path}/words")
    n_ranges = n_ranges or max(1, -(-words.count() // RANGE))
    found = _direction(words, n_ranges, False, f"{path}/forward").unionAll(_direction(words, n_ranges, True, f"{path}/backward"))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))
    rows = words.join(near, "word", "left")
    holds = -F.col("best.less") >= DOMINANT * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(holds, F.col("best.form")).alias("form"), F.when(holds, -F.col("best.less")).alias("form_n"))
    rows = materialise(rows, f"{path}/rows")
    roots, turn = rows.where("form is not null").select("word", F.col("form").alias("root")), 0
    while True:  # each round doubles the steps taken; a chain has at most 18
        further = roots.alias("a").join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        moved = materialise(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"{path}/roots-{turn}")
        roots, turn = moved.select("word", "root"), turn + 1
        if not moved.where("moved").limit(1).count():
            break
    return rows.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_groups(spark, sf_dir):
    return spelling_groups(documents(spark, sf_dir))
