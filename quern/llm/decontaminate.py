"""Benchmark decontamination: BM25 with block-max WAND, then question and answer overlap.

The inverted index is over benchmark items; every passage of every training document is a query.  An
item's impacts are divided by its own total, so a score is the share of the item's BM25 mass that a
passage covers, and one threshold serves all items.  Items are indexed by length class: at most ``WIDTH`` words, four
times as many, and so on.  A passage of a class is two neighbouring chunks of as many words as its longest items may
have, so an item that is copied anywhere lies wholly in some passage, and no item widens another's passages.

Retrieval returns every (passage, item) of at least ``threshold``, in two exact steps.  For groups of
neighbouring items the largest impact of each term is kept, and the sum of these over a passage's distinct
terms bounds the scores in the group; this is one gather and sum for a whole batch of passages.  Block-max
WAND then walks the posting lists of the passages and groups that are left: a pivot is found from list maxima,
checked against the maxima of its blocks, and only then scored.

A retrieved item is a leak if its question and its answer both overlap the passage: of each part's word
n-grams (n = 3, or the part's length) at least ``min_overlap`` are in the passage.  The answer is the last
sentence, or the last third where there is but one.

The index is built and broadcast in slices of at most ``slice_items`` items and ``slice_words`` words,
with document frequencies of the whole benchmark; more items make more slices, each run over all passages.

Nulls: a null text or one without a word has no passage; an item without a word isn't indexed; null ids are
kept as they are.  Repeated rows give repeated results.  Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise, workspace
from .textbatch import IS_ALNUM, LOWER, Texts, Words, span_hashes, texts_of, words_of

K1, B = 1.2, 0.75
THRESHOLD, MIN_OVERLAP = 0.5, 0.5
WIDTH = 64  # words of the first length class
BLOCK = 8  # postings of a block
GROUPS = 32  # of items in a slice
NGRAM = 3

_SENTENCE_END = regex.compile(r"(?<=[.!?])\s+")


def split_item(text: str) -> tuple[str, str]:
    """(question, answer) of an item."""
    parts = _SENTENCE_END.split(text.strip())
    if len(parts) > 1 and len(parts[-1].split()) >= 3:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = max(1, len(words) * 2 // 3) if len(words) > 1 else len(words)
    return " ".join(words[:cut]), " ".join(words[cut:])


def word_hashes(text: str) -> np.ndarray:
    out = [np.zeros(0, np.uint64)]
    for t in texts_of(pa.array([text], pa.string())):
        w = words_of(t, IS_ALNUM)
        out.append(span_hashes(LOWER[t.data], w.start, w.end))
    return np.concatenate(out)


def grams(h: np.ndarray, n: int) -> set:
    return {h[i : i + n].tobytes() for i in range(len(h) - n + 1)} if n else set()


@dataclass
class PostingList:
    items: list[int]
    impacts: list[float]
    block_last: list[int]
    block_max: list[float]
    most: float


def width_class(length: int) -> int:
    """Words of a chunk for items of a length."""
    width = WIDTH
    while width < length:
        width *= 4
    return width


class Index:
    """Items of one length class in a slice of the benchmark, with impacts in shares of an item's total."""

    def __init__(self, hashed: list[tuple[int, np.ndarray, str]], df: dict[int, int], n_items: int, mean_length: float, width: int):
        self.ids = [i for i, _, _ in hashed]
        self.chunk = width
        self.parts = [tuple(word_hashes(p) for p in split_item(text)) for _, _, text in hashed]
        rows = []
        for at, (_, h, _) in enumerate(hashed):
            terms, tf = np.unique(h, return_counts=True)
            n = np.array([df[int(t)] for t in terms])
            impact = np.log1p((n_items - n + 0.5) / (n + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / mean_length))
            rows.append((terms, np.full(len(terms), at), impact / impact.sum()))
        columns = [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0)]
        order = np.lexsort((columns[1], columns[0]))
        term, item, impact = (x[order] for x in columns)
        self.terms, first = np.unique(term, return_index=True)
        self.group_size = max(1, -(-len(self.ids) // GROUPS))
        self.group_most = np.zeros((len(self.terms) + 1, -(-len(self.ids) // self.group_size)), np.float32)
        term_at = np.repeat(np.arange(len(self.terms)), np.diff(np.append(first, len(term))))
        np.maximum.at(self.group_most, (term_at, item // self.group_size), np.nextafter(impact.astype(np.float32), np.float32(2)))
        self.lists = []
        for lo, hi in zip(first, np.append(first[1:], len(term)), strict=False):
            ends = range(lo + BLOCK, hi + BLOCK, BLOCK)
            self.lists.append(
                PostingList(
                    item[lo:hi].tolist(),
                    impact[lo:hi].tolist(),
                    [int(item[min(e, hi) - 1]) for e in ends],
                    [float(impact[e - BLOCK : min(e, hi)].max()) for e in ends],
                    float(impact[lo:hi].max()),
                )
            )

    def term_ids(self, h: np.ndarray) -> np.ndarray:
        """Of each hash, or -1."""
        if not len(self.terms):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)


def index_slice(items: list[tuple[int, str]], df: dict[int, int], n_items: int, mean_length: float) -> list[Index]:
    """An index for each length class among the items."""
    classes: dict[int, list] = {}
    for i, text in items:
        h = word_hashes(text)
        if len(h):
            classes.setdefault(width_class(len(h)), []).append((i, h, text))
    return [Index(hashed, df, n_items, mean_length, width) for width, hashed in sorted(classes.items())]


def block_max_wand(lists: list[PostingList], threshold: float, lo: int, hi: int) -> list[tuple[int, float]]:
    """All items in [lo, hi) whose impacts over ``lists`` reach ``threshold``, with their scores."""
    slack = threshold - 1e-9
    cursors = []  # [current item, position, list]

    def seek(c, item):
        """Move to the first posting of at least ``item``; whether there is one below ``hi``."""
        p, items, at = c[2], c[2].items, c[1]
        n = len(items)
        while at < n and p.block_last[at // BLOCK] < item:
            at = (at // BLOCK + 1) * BLOCK
        while at < n and items[at] < item:
            at += 1
        c[1] = at
        c[0] = items[at] if at < n else hi
        return c[0] < hi

    for p in lists:
        c = [0, 0, p]
        if seek(c, lo):
            cursors.append(c)
    found = []
    while cursors:
        cursors.sort(key=lambda c: c[0])
        total, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            total += c[2].most
            if total >= slack:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        bound, next_item = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else hi
        for c in cursors[: pivot + 1]:
            p, b = c[2], c[1] // BLOCK
            while b < len(p.block_last) and p.block_last[b] < item:
                b += 1
            if b < len(p.block_last):
                bound += p.block_max[b]
                next_item = min(next_item, p.block_last[b] + 1)
        if bound < slack:  # no item up to the nearest block end, or to the next cursor, can reach it
            target, moving = max(next_item, item + 1), cursors[: pivot + 1]
        elif cursors[0][0] == item:
            score = sum([c[2].impacts[c[1]] for c in cursors[: pivot + 1]])
            if score >= slack:
                found.append((item, score))
            target, moving = item + 1, cursors[: pivot + 1]
        else:
            target, moving = item, [c for c in cursors[:pivot] if c[0] < item]
        for c in moving:
            seek(c, target)
        cursors = [c for c in cursors if c[0] < hi]
    return found


def retrieve(t: Texts, w: Words, h: np.ndarray, index: Index, threshold: float):
    """(text, first word, stop word, item, score) of every passage and item of at least ``threshold``; ``h`` has the hashes of words."""
    n = len(w.start)
    if not n or not index.ids:
        return
    term = index.term_ids(h)
    size = index.chunk
    chunks = -(-np.diff(w.first) // size)  # of each text
    chunk_base = np.concatenate([[0], np.cumsum(chunks)])
    known = np.flatnonzero(term >= 0)
    doc, term_known = w.doc[known], term[known]
    chunk = chunk_base[doc] + (known - w.first[doc]) // size
    # the chunk in which the same term last stood in the same text
    order = np.lexsort((known, term_known, doc))
    again = np.zeros(len(known), bool)
    again[1:] = (doc[order][1:] == doc[order][:-1]) & (term_known[order][1:] == term_known[order][:-1])
    last = np.full(len(known), -2)
    last[order[1:]] = np.where(again[1:], chunk[order[:-1]], -2)
    once = np.flatnonzero(last < chunk)  # the first of its term in its chunk
    new = once[last[once] < chunk[once] - 1]  # and not in the chunk before
    n_chunks = int(chunk_base[-1])
    of_chunk, of_new = (np.zeros((n_chunks + 1, index.group_most.shape[1]), np.float32) for _ in range(2))
    for sums, at in ((of_chunk, once), (of_new, new)):
        if len(at):
            starts = np.flatnonzero(np.append(True, np.diff(chunk[at]) > 0))
            sums[chunk[at[starts]]] = np.add.reduceat(index.group_most[term_known[at]], starts, axis=0)
    owner = np.repeat(np.arange(len(t)), chunks)
    follows = np.zeros(n_chunks, bool)
    follows[:-1] = owner[1:] == owner[:-1]
    bound = of_chunk[:n_chunks] + of_new[1:] * follows[:, None]
    alone = np.ones(n_chunks, bool)  # a passage of one chunk is within that of two, unless its text has but one
    alone[1:] = owner[1:] != owner[:-1]
    worth = (bound >= threshold - 1e-4) & (follows | alone)[:, None]
    for c in np.flatnonzero(worth.any(axis=1)):
        i = owner[c]
        first = w.first[i] + (c - chunk_base[i]) * size
        stop = min(first + 2 * size, w.first[i + 1])
        ids = np.unique(term[first:stop])
        lists = [index.lists[k] for k in ids[ids >= 0].tolist()]
        for g in np.flatnonzero(worth[c]).tolist():
            for item, score in block_max_wand(lists, threshold, g * index.group_size, min((g + 1) * index.group_size, len(index.ids))):
                yield int(i), int(first), int(stop), item, score


def overlap(part: np.ndarray, passage: np.ndarray) -> float:
    n = min(NGRAM, len(part))
    mine = grams(part, n)
    return len(mine & grams(passage, n)) / len(mine) if mine else 1.0


def leaks(t: Texts, indexes: list[Index], threshold: float, min_overlap: float) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(text, item id): best score, question and answer overlap, of verified passages."""
    w, best = words_of(t, IS_ALNUM), {}
    h = span_hashes(LOWER[t.data], w.start, w.end)
    for index in indexes:
        for i, first, stop, item, score in retrieve(t, w, h, index, threshold):
            question, answer = (overlap(p, h[first:stop]) for p in index.parts[item])
            if question >= min_overlap and answer >= min_overlap:
                key = i, index.ids[item]
                best[key] = max(best.get(key, (0.0,)), (score, question, answer))
    return best


def build_indexes(benchmark: DataFrame, slice_items: int = 4096, slice_words: int = 1 << 20):
    """Indexes of slices of the benchmark, one slice at a time; what the driver holds is bounded by a slice."""
    spark = benchmark.sparkSession

    def count(batches):
        for batch in batches:
            for t in texts_of(batch.column(1)):
                w = words_of(t, IS_ALNUM)
                h = span_hashes(LOWER[t.data], w.start, w.end)
                terms = [np.unique(h[a:b]).view(np.int64) for a, b in zip(w.first.tolist(), w.first[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(t.lo, len(t)) for i in (0, 1)), pa.array(np.diff(w.first)), pa.array(terms, pa.list_(pa.int64()))],
                    ["item_id", "text", "length", "terms"],
                )

    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text")
    counted = items.mapInArrow(count, "item_id long, text string, length long, terms array<long>").where("length > 0")
    # read and hashed once; equal items are told apart by a row number, so they spread over slices
    counted = materialise(counted.withColumn("row", F.monotonically_increasing_id()), workspace(spark, "benchmark"))
    n_items, n_words = counted.agg(F.count("*"), F.sum("length")).first()
    if not n_items:
        return
    n_slices = max(1, -(-n_items // slice_items), -(-n_words // slice_words))
    frequency = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    if n_slices > 1:
        frequency = materialise(frequency, workspace(spark, "benchmark-terms"))
    for k in range(n_slices):
        part = counted.where(F.pmod(F.xxhash64("row"), F.lit(n_slices)) == k)
        rows = sorted(((r[0], r[1]) for r in part.select("item_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        mine = frequency
        if n_slices > 1:
            mine = frequency.join(part.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")
        df = {r[0] & 0xFFFFFFFFFFFFFFFF: r[1] for r in mine.collect()}
        yield index_slice(rows, df, n_items, n_words / n_items)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, min_overlap: float = MIN_OVERLAP, **slices) -> DataFrame:
    """A row per leaked (document, item): doc_id, item_id, score, question_overlap, answer_overlap."""
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    for indexes in build_indexes(benchmark, **slices):
        shared = spark.sparkContext.broadcast(indexes)

        def search(batches, shared=shared):
            for batch in batches:
                ids = batch.column(0)
                for t in texts_of(batch.column(1)):
                    found = leaks(t, shared.value, threshold, min_overlap)
                    if found:
                        scores = list(zip(*found.values(), strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [
                                ids.take(pa.array([t.lo + i for i, _ in found])),
                                pa.array([k for _, k in found], pa.int64()),
                                *(pa.array(s, pa.float64()) for s in scores),
                            ],
                            ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                        )

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, schema)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], schema) if out is None else out


def drop_leaked(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, min_overlap: float = MIN_OVERLAP, **slices) -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns: decided where the row is."""
    at = docs.columns.index("text")
    for indexes in build_indexes(benchmark, **slices):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def keep(batches, shared=shared):
            for batch in batches:
                for t in texts_of(batch.column(at)):
                    clean = np.ones(len(t), bool)
                    clean[[i for i, _ in leaks(t, shared.value, threshold, min_overlap)]] = False
                    yield batch.slice(t.lo, len(t)).filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op2_decontaminate(spark, sf_dir):
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontaminate_stage(spark, docs, sf_dir):
    """Documents without a benchmark item."""
    return drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
