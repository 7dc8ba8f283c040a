"""Ranked lexical search over dual-sorted inverted lists in wavelet trees.

A shard holds about ``SHARD_BYTES`` of whole texts, its documents numbered by ascending doc_id.  Its posting lists lie
back to back, each ordered by impact, largest first; that sequence of document numbers is kept as a wavelet tree, one
bit vector a level.  Going to a child keeps the order within each list's range, so a node (an interval of document
numbers) finds the part of any list inside its interval, and the first entry of that part has the list's largest impact
there.  The sum of those, times the terms' weights, bounds every document of the subtree, and is its score at a leaf.

A search goes down all lists of an item at once, best bound first, in rounds of at most ``ROUND`` nodes; ranges of lists
that are empty in a node drop out.  It ends when no node left can be among the best ``k``, so results are exact, ties
included.  The best ``k`` of a task's earlier shards bound those in later ones.  Shards are a table (``build_index``),
made once and searched any number of times (``search``).

The impact of a term in a document is ``(10^9 tf) div (1000 tf + 12 m)`` and needs the totals N and L, so texts are read
once into postings, and those are ordered when the totals are known.  Items are broadcast in slices of about
``SLICE_TERMS`` distinct terms; document frequencies are summed over shards for the slice's terms only.

Nulls: a null text or one without a term is no document; a null doc_id comes after all others among equal scores.
Repeated rows of documents are documents each.  Rows that repeat an item's id and text are one item; rows with one id
and different texts have a list each.  A text longer than a shard is a shard.  Empty tables give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LARGE_ROWS, documents, materialise, rows_at_once, workspace
from .textbatch import IS_ALNUM, LOWER, texts_of, words_of

K = 20
SHARD_BYTES = 8 << 20
SLICE_TERMS = 1 << 18
ROUND = 128
TEXTS_AT_ONCE, SHARDS_AT_ONCE = 1024, 1
POSTINGS = "shard long, n_docs long, n_terms long, doc_ids array<bigint>, lengths binary, terms array<string>, starts binary, docs binary, tf binary"
SHARDS = "shard long, doc_ids array<bigint>, terms array<string>, starts binary, impacts binary, bits binary"


def terms_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.LargeStringArray:
    """The terms of lower-cased bytes in their order, exactly."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


def _postings(batches):
    made = 0

    def shard(parts):
        nonlocal made
        ids = pa.concat_arrays([p[0] for p in parts])
        lengths = np.concatenate([p[1] for p in parts])
        coded = pa.concat_arrays([p[2] for p in parts]).dictionary_encode()
        has = np.flatnonzero(lengths)
        order = has[pc.sort_indices(ids.take(pa.array(has))).to_numpy()]  # nulls last
        number = np.empty(len(lengths), np.int64)
        number[order] = np.arange(len(order))
        n, codes = len(order), coded.indices.to_numpy().astype(np.int64)
        key, tf = np.unique(codes * n + number[np.repeat(np.arange(len(lengths)), lengths)], return_counts=True)
        made += 1
        row = [
            TaskContext.get().partitionId() << 32 | made, n, len(codes), ids.take(pa.array(order)).to_pylist(), lengths[order].astype("<i4").tobytes(), coded.dictionary.to_pylist(),
            np.searchsorted(key, np.arange(len(coded.dictionary) + 1) * n).astype("<i8").tobytes(), (key % n).astype("<u4").tobytes(), tf.astype("<i4").tobytes(),
        ]
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string())] + [pa.binary()] * 3
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in POSTINGS.split(", ")])

    parts, size = [], 0
    for batch in batches:
        for t in texts_of(batch.column(1)):
            data = LOWER[t.data]
            w = words_of(t, IS_ALNUM)
            if len(w.start):
                parts.append((batch.column(0).slice(t.lo, len(t)), np.diff(w.first), terms_of(data, w.start, w.end)))
                size += len(data)
            if size >= SHARD_BYTES:
                yield shard(parts)
                parts, size = [], 0
    if parts:
        yield shard(parts)


def _order(n_all: int, l_all: int):
    """Lists ordered by impact, as bits of the wavelet tree."""

    def run(batches):
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                read = lambda n, kind, i=i: np.frombuffer(column[n][i].as_buffer(), kind)
                starts, docs, tf, lengths = read("starts", "<i8"), read("docs", "<u4").astype(np.int64), read("tf", "<i4").astype(np.int64), read("lengths", "<i4").astype(np.int64)
                m = 100 - 25 + (25 * lengths * n_all) // l_all
                impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[docs])
                order = np.lexsort((docs, -impact, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
                docs, impact = docs[order], impact[order]
                bits = []
                for level in range(levels(len(lengths)) - 1, -1, -1):
                    one = (docs >> level & 1).astype(bool)
                    bits.append(np.packbits(one).tobytes())
                    docs = np.concatenate([docs[~one], docs[one]])
                yield pa.RecordBatch.from_arrays(
                    [column["shard"].slice(i, 1), column["doc_ids"].slice(i, 1), column["terms"].slice(i, 1), column["starts"].slice(i, 1), pa.array([impact.astype("<i4").tobytes()], pa.binary()), pa.array([b"".join(bits)], pa.binary())],
                    [c.split()[0] for c in SHARDS.split(", ")],
                )

    return run


def levels(n_docs: int) -> int:
    return max(0, (n_docs - 1).bit_length())


class Shard:
    """Ranks and impacts of every level: those of a level are the ones before, zeros first."""

    def __init__(self, n_docs: int, starts: np.ndarray, impacts: np.ndarray, bits: bytes):
        self.levels, self.n, self.starts = levels(n_docs), len(impacts), starts
        width = (self.n + 7) // 8
        self.rank0 = np.zeros((self.levels, self.n + 1), np.int32)
        self.impact = np.zeros((self.levels + 1, self.n + 1), np.int32)  # one entry more, for empty ranges at the end
        self.impact[0, : self.n] = impacts
        for level in range(self.levels):
            one = np.unpackbits(np.frombuffer(bits, np.uint8, width, level * width), count=self.n).view(bool)
            np.cumsum(~one, out=self.rank0[level, 1:])
            now = self.impact[level, : self.n]
            self.impact[level + 1, : self.n] = np.concatenate([now[~one], now[one]])
        self.zeros = self.rank0[:, -1].astype(np.int64)

    def bounds(self, level: np.ndarray, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The largest score in each node; rows are nodes, columns are lists."""
        first = self.impact[level[:, None], lo] * (hi > lo)
        return first.astype(np.int64) @ weight

    def children(self, level, at, lo, hi):
        """(level, first document, lo, hi) of both children of nodes; ``at`` is the node's number in its level."""
        a, b = self.rank0[level[:, None], lo], self.rank0[level[:, None], hi]
        ones = self.zeros[level][:, None]
        return np.tile(level + 1, 2), np.concatenate([2 * at, 2 * at + 1]), np.concatenate([a, ones + lo - a]), np.concatenate([b, ones + hi - b])


@dataclass
class Best:
    """The best k so far as (-score, id key, document), where a missing id comes last."""

    k: int
    rows: list

    def worst(self) -> tuple[int, int]:
        return self.rows[-1][:2] if len(self.rows) >= self.k else (0, -(1 << 63))

    def add(self, rows: list) -> None:
        self.rows = sorted(self.rows + rows, key=lambda r: r[:2])[: self.k]


NO_ID = (1 << 63) - 1


def search_shard(shard: Shard, keys: np.ndarray, ranges: np.ndarray, weight: np.ndarray, best: Best, doc_ids) -> None:
    """Put documents of a shard among ``best``: those that come before its worst by (score, id).

    ``ranges``: start and end of each list; ``keys``: ascending ids of the shard's documents.
    """
    depth, n_docs = shard.levels, len(keys)
    level, at = np.zeros(1, np.int64), np.zeros(1, np.int64)
    lo, hi = ranges[None, :, 0].astype(np.int64), ranges[None, :, 1].astype(np.int64)
    bound = shard.bounds(level, lo, hi, weight)
    while len(bound):
        first = np.minimum(at << (depth - level), n_docs - 1)
        score, key = best.worst()
        alive = (bound > -score) | ((bound == -score) & (keys[first] < key)) if score else bound > 0
        level, at, lo, hi, bound, first = (x[alive] for x in (level, at, lo, hi, bound, first))
        if not len(bound):
            return
        order = np.lexsort((first, -bound))
        now, later = order[:ROUND], order[ROUND:]
        leaf = now[level[now] == depth]
        if len(leaf):
            best.add([(-int(bound[i]), int(keys[at[i]]), doc_ids[int(at[i])]) for i in leaf[: best.k]])
            later = np.concatenate([later, leaf[best.k :]])
        now = now[level[now] < depth]
        l2, a2, lo2, hi2 = shard.children(level[now], at[now], lo[now], hi[now])
        level, at = np.concatenate([level[later], l2]), np.concatenate([at[later], a2])
        lo, hi = np.concatenate([lo[later], lo2]), np.concatenate([hi[later], hi2])
        bound = np.concatenate([bound[later], shard.bounds(l2, lo2, hi2, weight)])


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """(shards, N, L): the table of shards under ``path``, the number of documents with a term, and of their terms."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    posted = chosen.mapInArrow(_postings, POSTINGS)
    with rows_at_once(docs.sparkSession, TEXTS_AT_ONCE):
        posted.write.options(compression="zstd", **LARGE_ROWS).parquet(f"{path}/postings")
    posted = docs.sparkSession.read.schema(POSTINGS).parquet(f"{path}/postings")
    n_all, l_all = posted.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    used = posted.select("shard", "doc_ids", "lengths", "terms", "starts", "docs", "tf")
    ordered = used.mapInArrow(_order(n_all, max(1, l_all)), SHARDS)
    with rows_at_once(docs.sparkSession, SHARDS_AT_ONCE):
        ordered.write.options(compression="zstd", **LARGE_ROWS).parquet(f"{path}/shards")
    return docs.sparkSession.read.schema(SHARDS).parquet(f"{path}/shards"), n_all, l_all


def _item_terms(batches):
    for batch in batches:
        for t in texts_of(batch.column(1)):
            w = words_of(t, IS_ALNUM)
            terms = terms_of(LOWER[t.data], w.start, w.end).dictionary_encode()
            n = max(1, len(terms.dictionary))
            key, times = np.unique(w.doc * n + terms.indices.to_numpy().astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(t.lo + key // n)), terms.dictionary.take(pa.array(key % n)).cast(pa.string()), pa.array(times)], ["item", "term", "times"]
            )


def _frequencies(asked):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                at = pc.index_in(asked.value, value_set=batch.column(0)[i].values).to_numpy(zero_copy_only=False)
                found = np.flatnonzero(~np.isnan(at.astype(float)))
                size = np.diff(np.frombuffer(batch.column(1)[i].as_buffer(), "<i8"))[at[found].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(size)], ["at", "df"])

    return run


def _search(shared, k):
    def run(batches):
        terms, items = shared.value  # terms; (item, places of its terms, weights)
        best = [Best(k, []) for _ in items]
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                starts = np.frombuffer(column["starts"][i].as_buffer(), "<i8")
                doc_ids = column["doc_ids"][i].values
                keys = doc_ids.fill_null(NO_ID).to_numpy()
                shard = None  # the last one goes before the next is built
                shard = Shard(len(keys), starts, np.frombuffer(column["impacts"][i].as_buffer(), "<i4"), column["bits"][i].as_py())
                at = pc.index_in(terms, value_set=column["terms"][i].values).fill_null(-1).to_numpy()
                ids = doc_ids.to_pylist()
                for (_, places, weights), mine in zip(items, best, strict=True):
                    lists = at[places]
                    has = lists >= 0
                    if has.any():
                        lists = lists[has].astype(np.int64)
                        search_shard(shard, keys, np.stack([starts[lists], starts[lists + 1]], axis=1), weights[has], mine, ids)
        rows = [(item, doc, -score) for (item, _, _), b in zip(items, best, strict=True) for score, _, doc in b.rows]
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    return run


def search(shards: DataFrame, n_all: int, items: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the exact ``k`` best documents of each item, scores over 0 only."""
    spark, path = shards.sparkSession, workspace(shards.sparkSession, "ranked-search")
    known = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    known = materialise(known.withColumn("item", F.monotonically_increasing_id()), f"{path}/items")
    asked = materialise(known.select("item", "text").mapInArrow(_item_terms, "item long, term string, times long"), f"{path}/asked")
    n_slices = max(1, -(-asked.count() // SLICE_TERMS))
    out = None
    for part in range(n_slices):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(n_slices)) == part).toArrow()  # bounded by the slice
        if not rows.num_rows:
            continue
        coded = rows.column("term").combine_chunks().dictionary_encode()
        terms = coded.dictionary
        found = shards.select("terms", "starts").mapInArrow(_frequencies(spark.sparkContext.broadcast(terms)), "at long, df long").groupBy("at").agg(F.sum("df").alias("df"))
        with rows_at_once(spark, SHARDS_AT_ONCE):
            found = found.toArrow()
        df = np.zeros(len(terms), np.int64)
        df[found.column("at").to_numpy()] = found.column("df").to_numpy()
        weight = np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * int(n) + 1))) for n in df], np.int64)
        item, code, times = rows.column("item").to_numpy(), coded.indices.to_numpy().astype(np.int64), rows.column("times").to_numpy()
        order = np.lexsort((code, item))
        cuts = np.flatnonzero(np.diff(item[order])) + 1
        lists = [(int(item[g[0]]), code[g][weight[code[g]] > 0], (weight[code[g]] * times[g])[weight[code[g]] > 0]) for g in np.split(order, cuts)]
        shared = spark.sparkContext.broadcast((terms, lists))
        best = shards.mapInArrow(_search(shared, k), "item long, doc_id long, score long")
        out = best if out is None else out.unionAll(best)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    with rows_at_once(spark, SHARDS_AT_ONCE):
        ranked = materialise(out.withColumn("rank", rank).where(F.col("rank") <= k), f"{path}/ranked")
    return ranked.join(known.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark, sf_dir):
    shards, n_all, _ = build_index(documents(spark, sf_dir), workspace(spark, "ranked-index"))
    return search(shards, n_all, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_TERMS.format('text')} AS t FROM documents WHERE text IS NOT NULL),
st AS MATERIALIZED (SELECT count(*) AS n, sum(len(t)) AS l FROM d WHERE len(t) > 0),
p AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
f AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln((2 * st.n + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, st GROUP BY term, st.n),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + CAST((25 * p.n * st.n) // st.l AS BIGINT))))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN f USING (term), st GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
