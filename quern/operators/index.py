"""Lexical and vector indexes as tables, and ranked retrieval over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import is_garbage, render_context
from ..session import LARGE_ROWS, Scratch, rows_at_once


def postings(chunks: DataFrame, tokens: Column, id_col: str = "chunk_id") -> DataFrame:
    """(id, dl, term, tf): a row per chunk and distinct token; counts are summed in the task that reads the chunk before their shuffle."""
    t = chunks.select(F.col(id_col), tokens.alias("tokens")).where(F.size("tokens") > 0)
    return t.select(id_col, F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy(id_col, "dl", "term").agg(F.count("*").alias("tf"))


# ---- a lexical index: blocks of documents with their lists in order of impact

BLOCK_TOKENS = 1 << 18
TEXTS_AT_ONCE, BLOCKS_AT_ONCE = 1024, 1
SPLIT_BYTES = 1 << 20
SLICE_TERMS = 1 << 18
HITS_SENT = 1 << 17
# numbers and terms of a block are bytes, so that neither Spark nor its readers make an object for each of them
_RAW = "rows long, tokens long, ids array<{id}>, sizes binary, kinds binary, term_ends binary, term_bytes binary, starts binary, places binary, tf binary"
_BLOCKS = "ids array<{id}>, kinds binary, term_ends binary, term_bytes binary, starts binary, most binary, places binary, parts binary"
# without statistics: a writer keeps the least and the largest value of each row group until its file ends, so all blocks of a task
_BLOCK_ROWS = LARGE_ROWS | {"parquet.block.size": str(4 << 20), "compression": "zstd", "parquet.column.statistics.enabled": "false", "parquet.enable.dictionary": "false"}


def _type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _row(schema: str, id_type: pa.DataType, ids: list, **values) -> pa.RecordBatch:
    """A batch of one block; what is neither a number nor ``ids`` is bytes."""
    made = {n: pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for n, v in values.items()} | {"ids": pa.array([ids], pa.list_(id_type))}
    names = [part.split()[0] for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([made[n] for n in names], names)


def _numbers(batch, name: str, i: int, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[i].as_buffer(), kind)


def _terms(batch, i: int) -> pa.Array:
    ends, data = (batch.column(batch.schema.get_field_index(n))[i].as_buffer() for n in ("term_ends", "term_bytes"))
    return pa.StringArray.from_buffers(len(ends) // 4 - 1, pa.py_buffer(ends.to_pybytes()), data)  # ends may lie anywhere in a batch


def _words_of_rows(batch, stopwords: pa.Array):
    """(ids, words in a row, how many each row has), from lists of words or from lower-cased texts, a megabyte of them at a time."""
    ids, values = batch.column(0), batch.column(1)
    if not pa.types.is_string(values.type):
        yield ids, values.flatten(), values.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        return
    fold, between = str.maketrans(*lx.FRENCH_FOLD), f"[^a-z0-9{lx.FRENCH_FOLD[0]}]+"
    ends = np.cumsum(pc.binary_length(values).fill_null(0).to_numpy().astype(np.int64))
    lo = 0
    while lo < len(values):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SPLIT_BYTES, side="right")))
        split = pc.split_pattern_regex(values.slice(lo, hi - lo), between)
        row, coded = np.repeat(np.arange(hi - lo), split.value_lengths().fill_null(0).to_numpy()), split.flatten().dictionary_encode()
        distinct = pa.array([w if w.isascii() else w.translate(fold) for w in coded.dictionary.to_pylist()], pa.string())
        kept = pc.and_(pc.greater_equal(pc.binary_length(distinct), 2), pc.invert(pc.is_in(distinct, value_set=stopwords))).take(coded.indices)
        yield ids.slice(lo, hi - lo), distinct.take(coded.indices.filter(kept)), np.bincount(row[kept.to_numpy(zero_copy_only=False)], minlength=hi - lo)
        lo = hi


def _raw_blocks(stopwords: list[str]):
    def run(batches):
        none = pa.array(stopwords, pa.string())
        ids, sizes, parts, rows, held = [], [], [], 0, 0

        def block():
            coded = pa.concat_arrays([pa.array([], pa.string()), *parts]).dictionary_encode()
            length = np.array(sizes, np.int64)
            n, place = len(length), np.repeat(np.arange(len(length)), length)
            key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + place, return_counts=True)
            terms = pa.concat_arrays([coded.dictionary])  # its own, from the first byte on
            ends, data = np.concatenate([[0], np.cumsum(pc.binary_length(terms).to_numpy())]), terms.buffers()[2]
            return _row(
                _RAW, id_type, ids, rows=rows, tokens=held, sizes=length.astype("<i4").tobytes(), kinds=np.bincount(key % n, minlength=n).astype("<i4").tobytes(),
                term_ends=ends.astype("<i4").tobytes(), term_bytes=data.to_pybytes()[: ends[-1]] if data else b"",
                starts=np.searchsorted(key, np.arange(len(terms) + 1) * n).astype("<i4").tobytes(),
                places=(key % n).astype("<u4").tobytes(), tf=tf.astype("<i4").tobytes(),
            )

        for batch in batches:
            id_type = batch.column(0).type
            for of_rows, words, length in _words_of_rows(batch, none):
                ends = np.concatenate([[0], np.cumsum(length)])
                lo = 0
                while lo < len(length):
                    hi = max(lo + 1, int(np.searchsorted(ends[1:], ends[lo] + BLOCK_TOKENS - held, side="right")))
                    has = np.flatnonzero(length[lo:hi])
                    ids += of_rows.slice(lo, hi - lo).take(pa.array(has)).to_pylist()
                    sizes += length[lo:hi][has].tolist()
                    parts.append(words.slice(ends[lo], ends[hi] - ends[lo]))
                    rows, held, lo = rows + hi - lo, held + int(ends[hi] - ends[lo]), hi
                    if held >= BLOCK_TOKENS:
                        yield block()
                        ids, sizes, parts, rows, held = [], [], [], 0, 0
        if rows:
            yield block()

    return run


def _document_counts(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield pa.RecordBatch.from_arrays([_terms(batch, i), pa.array(np.diff(_numbers(batch, "starts", i, "<i4")).astype(np.int64))], ["term", "df"])


def _by_impact(mean: float):
    """Lists of blocks ordered by their part of the score (without idf), largest first, and each list's largest."""
    k1, b = lx.BM25_K1, lx.BM25_B

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                starts, size, place, tf = (_numbers(batch, n, i, kind) for n, kind in (("starts", "<i4"), ("sizes", "<i4"), ("places", "<u4"), ("tf", "<i4")))
                part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[place] / mean)) if len(tf) else np.zeros(0)
                order = np.lexsort((place, -part, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
                most = part[order][starts[:-1]] if len(tf) else part
                own = [batch.column(batch.schema.get_field_index(n)).slice(i, 1) for n in ("ids", "kinds", "term_ends", "term_bytes", "starts")]
                made = [pa.array([x.tobytes()], pa.binary()) for x in (most, place[order], part[order])]
                yield pa.RecordBatch.from_arrays(own + made, ["ids", "kinds", "term_ends", "term_bytes", "starts", "most", "places", "parts"])

    return run


def write_lexical(chunks: DataFrame, tokens, path: str, id_col: str, stopwords: list[str] = lx.FRENCH_STOPWORDS) -> str:
    """Keep a lexical index under ``path``: ``blocks`` of documents, ``terms`` with their idf, and ``statistics``.

    ``tokens`` is a list of words, or a lower-cased text, whose words (as ``french_tokens`` has them) are then found in the tasks without a list in Spark.

    A block holds about ``BLOCK_TOKENS`` tokens of whole documents, with a list for each of its terms in order of impact.
    Texts are tokenised once, in the tasks that read them; only the terms of each block are shuffled, for their counts.
    Negative idf is raised to ``BM25_EPSILON`` times the mean over the vocabulary.
    """
    spark, id_type = chunks.sparkSession, _type_of(chunks, id_col)
    made = chunks.select(F.col(id_col), tokens.alias("tokens")).mapInArrow(_raw_blocks(stopwords), _RAW.format(id=id_type))
    with rows_at_once(spark, TEXTS_AT_ONCE):
        made.write.options(**_BLOCK_ROWS).mode("overwrite").parquet(f"{path}/raw")
    raw = spark.read.schema(_RAW.format(id=id_type)).parquet(f"{path}/raw")
    n, words = raw.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    spark.createDataFrame([(n, words)], "n long, words long").write.mode("overwrite").parquet(f"{path}/statistics")
    counts = raw.select("term_ends", "term_bytes", "starts").mapInArrow(_document_counts, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    with rows_at_once(spark, BLOCKS_AT_ONCE):
        counts.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).write.mode("overwrite").parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    mean = counts.agg(F.avg("raw")).first()[0] or 0.0
    terms = counts.select("term", "df", F.when(F.col("raw") < 0, F.lit(lx.BM25_EPSILON * mean)).otherwise(F.col("raw")).alias("idf"))
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    used = raw.select("ids", "sizes", "kinds", "term_ends", "term_bytes", "starts", "places", "tf")
    ordered = used.mapInArrow(_by_impact(words / n if words else 1.0), _BLOCKS.format(id=id_type))
    with rows_at_once(spark, BLOCKS_AT_ONCE):
        ordered.write.options(**_BLOCK_ROWS).mode("overwrite").parquet(f"{path}/blocks")
    return path


def best_first(rows: list[tuple], k: int, descending: bool) -> list[tuple]:
    """The k best of (rounded score, id, score); ties by id. Ids may be numbers or strings."""
    return sorted(sorted(rows, key=lambda r: r[1], reverse=descending), key=lambda r: -r[0])[:k]


def _search_blocks(shared, k: int, query_col: str, id_col: str, by_share: bool):
    """Each task's best k of every question: a row for each of them, whatever the number of its documents.

    A block whose largest possible score can't reach a question's k-th so far isn't read for it.
    """

    def run(batches):
        questions, terms, q_type = shared.value  # [(question, places of its terms, weights)], the slice's terms
        best: list[list[tuple]] = [[] for _ in questions]
        kind = None
        for batch in batches:
            held = batch.column(batch.schema.get_field_index("ids"))
            kind = held.type.value_type
            for i in range(batch.num_rows):
                at = pc.index_in(terms, value_set=_terms(batch, i)).fill_null(-1).to_numpy()
                if (at < 0).all():
                    continue
                starts, most, place, part = (_numbers(batch, n, i, t) for n, t in (("starts", "<i4"), ("most", float), ("places", "<u4"), ("parts", float)))
                ids, n_docs = held[i].values, len(held[i])
                share = 1 / _numbers(batch, "kinds", i, "<i4")
                order = pc.sort_indices(ids).to_numpy()
                rank = np.empty(n_docs, np.int64)
                rank[order] = np.arange(n_docs) if by_share else -np.arange(n_docs)
                for (_, places, weights), mine, q in zip(questions, best, range(len(best)), strict=True):
                    lists, has = at[places], at[places] >= 0
                    lists, weight = lists[has], weights[has]
                    if not len(lists):
                        continue
                    least = mine[-1][0] if len(mine) == k else -np.inf
                    if not by_share and np.maximum(weight, 0) @ most[lists] < least - 1e-8:
                        continue
                    size = starts[lists + 1] - starts[lists]
                    where = np.repeat(starts[lists] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    docs = place[where]
                    score = np.bincount(docs, share[docs] if by_share else np.repeat(weight, size) * part[where], n_docs)
                    met = np.unique(docs)
                    rounded = np.round(score[met], 9)
                    if len(met) > k:
                        least = max(least, np.partition(rounded, -k)[-k])
                    met, rounded = met[rounded >= least], rounded[rounded >= least]
                    top = np.lexsort((rank[met], -rounded))[:k]
                    if len(top):
                        found = zip(rounded[top].tolist(), ids.take(pa.array(met[top])).to_pylist(), score[met[top]].tolist(), strict=True)
                        best[q] = best_first(mine + list(found), k, not by_share)
        rows = [(q, *r) for (q, _, _), mine in zip(questions, best, strict=True) for r in mine]
        if rows:
            asked, _, ids, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(asked, q_type), pa.array(ids, kind), pa.array(score)], [query_col, id_col, "score"])

    return run


def _best_of_tasks(spark, path: str, asked: DataFrame, *, id_col: str, query_col: str, k: int, by_share: bool) -> DataFrame:
    """``asked`` (question, term, weight) is broadcast in slices of about ``SLICE_TERMS`` rows; each slice reads the blocks once.

    What is found is kept, a table of at most ``k`` rows for each task and question.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    schema = f"{query_col} {_type_of(asked, query_col)}, {id_col} {blocks.schema['ids'].dataType.elementType.simpleString()}, score double"
    work = Scratch(spark, "asked")
    asked = work.keep(asked.select(F.col(query_col).alias("q"), "term", "weight"))
    n_slices, out = max(1, -(-asked.count() // SLICE_TERMS)), spark.createDataFrame([], schema)
    for s in range(n_slices):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(n_slices)) == s).orderBy("q", "term").toArrow()
        if not rows.num_rows:
            continue
        coded = rows.column("term").combine_chunks().dictionary_encode()
        codes, weight, q = coded.indices.to_numpy().astype(np.int64), rows.column("weight").to_numpy(), rows.column("q").to_pylist()
        cuts = [0, *(i for i in range(1, len(q)) if q[i] != q[i - 1]), len(q)]
        questions = [(q[a], codes[a:b], weight[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        shared = spark.sparkContext.broadcast((questions, coded.dictionary, rows.column("q").type))
        with rows_at_once(spark, BLOCKS_AT_ONCE):
            out = out.unionAll(work.keep(blocks.mapInArrow(_search_blocks(shared, k, query_col, id_col, by_share), schema)))
    return out


def search_lexical(spark, path: str, queries: DataFrame, query_tokens, *, id_col: str, query_col: str, k: int = lx.RETRIEVE_K) -> DataFrame:
    """(query, id, bm25, rank) from a kept index, ties to the larger id. No rows for a query whose best score isn't positive."""
    asked = queries.select(F.col(query_col), F.explode(query_tokens).alias("term")).groupBy(query_col, "term").agg(F.count("*").alias("qtf"))
    asked = asked.join(spark.read.parquet(f"{path}/terms"), "term").withColumn("weight", F.col("idf") * F.col("qtf"))
    found = _best_of_tasks(spark, path, asked, id_col=id_col, query_col=query_col, k=k, by_share=False)
    order = Window.partitionBy(query_col).orderBy(F.desc(F.round("score", 9)), F.desc(id_col))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    most = F.max("score").over(Window.partitionBy(query_col))
    return ranked.withColumn("most", most).where("most > 0").select(query_col, id_col, F.col("score").alias("bm25"), "rank")


def search_share(spark, path: str, queries: DataFrame, query_tokens, *, id_col: str, query_col: str, k: int = lx.RETRIEVE_K) -> DataFrame:
    """(query, id, score, rank): the share of a document's distinct tokens that are asked for, from a kept index; ties to the smaller id."""
    asked = queries.select(F.col(query_col), F.explode(F.array_distinct(query_tokens)).alias("term")).withColumn("weight", F.lit(1.0))
    found = _best_of_tasks(spark, path, asked, id_col=id_col, query_col=query_col, k=k, by_share=True)
    order = Window.partitionBy(query_col).orderBy(F.desc(F.round("score", 9)), id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(chunks: DataFrame, queries: DataFrame, tokens, query_tokens, *, id_col: str, query_col: str, k: int = lx.RETRIEVE_K) -> DataFrame:
    """(query, id, bm25, rank): Okapi scores with the multiplicity of query tokens; ties go to the larger id.

    The index of ``write_lexical`` is made in the work folder. A chunk that matches no term has no row.
    """
    path = write_lexical(chunks, tokens, Scratch(chunks.sparkSession, "lexical").path, id_col)
    return search_lexical(chunks.sparkSession, path, queries, query_tokens, id_col=id_col, query_col=query_col, k=k)


def dense_topk(vectors: DataFrame, queries: DataFrame, *, id_col: str, vec_col: str, k: int, block: int = 2048) -> DataFrame:
    """(query_id, id, score, rank): exact inner products, queries in blocks of bounded size against all rows.

    Each task keeps its best k for each query of the block; only these are shuffled. Ties go to the smaller id.
    """
    spark, out = vectors.sparkSession, None
    ordered = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("q"), F.col(vec_col).alias("v"))
    n_blocks = max(1, -(-ordered.count() // block))
    of_block = F.pmod(F.xxhash64("q"), F.lit(n_blocks))
    for part in range(n_blocks):
        rows = ordered.where(of_block == part).collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)))

        def search(batches, shared=shared):
            qs, m = shared.value
            best, ids = np.zeros((len(qs), 0)), np.zeros((len(qs), 0), np.int64)
            for batch in batches:
                kept = batch.filter(batch.column(1).is_valid())
                for lo in range(0, kept.num_rows, 512):  # a matrix has 2048 * 512 numbers at most
                    some = kept.slice(lo, 512)
                    v = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(some.num_rows, -1)
                    best = np.concatenate([best, m @ v.T], axis=1)
                    ids = np.concatenate([ids, np.broadcast_to(some.column(0).to_numpy(), (len(qs), len(v)))], axis=1)
                    best, ids = keep_best(best, ids, k)
            if best.size:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qs, best.shape[1])), pa.array(ids.ravel()), pa.array(best.ravel())], ["query_id", id_col, "score"])

        found = vectors.select(F.col(id_col).cast("long"), vec_col).mapInArrow(search, f"query_id long, {id_col} long, score double")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], f"query_id long, {id_col} long, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), id_col))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def keep_best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by (score to nine places, smaller id); those beyond the k-th score aren't sorted."""
    if score.shape[1] <= k:
        return score, ids
    rounded = np.round(score, 9)
    least = np.partition(rounded, -k, axis=1)[:, -k]
    out_score, out_ids = np.empty((len(score), k)), np.empty((len(score), k), ids.dtype)
    for i, low in enumerate(least):
        at = np.flatnonzero(rounded[i] >= low)
        at = at[np.lexsort((ids[i, at], -rounded[i, at]))[:k]]
        out_score[i], out_ids[i] = score[i, at], ids[i, at]
    return out_score, out_ids


def fuse(dense: DataFrame, sparse: DataFrame, *, query_col: str, id_col: str) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists, in one aggregation; order: score, dense list first, rank."""
    part = lambda df, w, order: df.select(query_col, id_col, F.lit(order).alias("list"), "rank", (w / (lx.RRF_K + F.col("rank"))).alias("part"))
    both = part(dense, lx.W_DENSE, 0).unionByName(part(sparse, lx.W_BM25, 1))
    fused = both.groupBy(query_col, id_col).agg(F.sum("part").alias("rrf"), F.min(F.struct("list", "rank")).alias("first"))
    order = Window.partitionBy(query_col).orderBy(F.desc(F.round("rrf", 12)), "first", id_col)
    return fused.withColumn("rank", F.row_number().over(order)).select(query_col, id_col, "rrf", "rank")


def with_documents(hits: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """``hits`` joined to ``docs`` by their id. Up to ``HITS_SENT`` hits go to the tasks that read the documents, so other texts aren't shuffled."""
    hits = Scratch(hits.sparkSession, "hits").keep(hits)
    return (F.broadcast(hits) if hits.count() <= HITS_SENT else hits).join(docs, id_col)


def drop_garbage(hits: DataFrame, text: Column, query_col: str) -> DataFrame:
    """Garbage chunks go, unless all of a query's chunks are garbage."""
    flagged = hits.withColumn("garbage", is_garbage(text))
    flagged = flagged.withColumn("all_garbage", F.min(F.col("garbage").cast("int")).over(Window.partitionBy(query_col)) == 1)
    return flagged.where(~F.col("garbage") | F.col("all_garbage")).drop("garbage", "all_garbage")


def context_of(hits: DataFrame, query_col: str, k: int = lx.FINAL_K) -> DataFrame:
    """One row per query: the context in rank order and the out-of-scope gate on the top score."""
    top = hits.where(F.col("rank") <= k)
    parts = F.sort_array(F.collect_list(F.struct("rank", render_context(F.col("source"), F.col("page"), F.col("text")).alias("part"))))
    return top.groupBy(query_col).agg(
        F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n").alias("context"),
        F.max("rrf").alias("top_rrf"),
        F.count("*").alias("n_chunks"),
        (F.max("rrf") < lx.OOS_RRF).alias("out_of_scope"),
    )


def rerank_pair(query: Column, intents: Column, chunk_language: Column) -> Column:
    """A question of several intents is prefixed by the phrase of the first known one."""
    known = F.filter(intents, lambda i: i.isin(list(lx.INTENT_PHRASES)))
    phrase = lambda at: F.create_map(*[F.lit(x) for i, p in lx.INTENT_PHRASES.items() for x in (i, p[at])])
    first = F.try_element_at(known, F.lit(1))
    prefix = F.when(chunk_language.isin("arabic_msa", "mixed"), F.try_element_at(phrase(0), first)).otherwise(F.try_element_at(phrase(1), first))
    return F.when((F.size(intents) > 1) & prefix.isNotNull(), F.concat(prefix, F.lit(" "), query)).otherwise(query)
