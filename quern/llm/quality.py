"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio with a fixed threshold.

Two multinomials over hashed word uni- and bigrams (A-Z lower-cased) are counted: the *raw corpus*
over every document, the *trusted target* over documents labelled ``quality = 1 and toxic = 0``
(at most ``trusted_rows`` labelled ids, by hash order; the counts of the raw corpus have no bound).
A bucket's log ratio is ``log((c + PRIOR) / (e + PRIOR))``, c its count in the target and e the count there
if the target were like the raw corpus: what neither has often says nothing, so clean documents with words of
their own aren't held against the few that have labels.
A document's verdict is ``sum(ratios) / (n_grams + PRIOR_GRAMS) >= threshold``: the mean log-likelihood
ratio, drawn to 0 for texts of a few grams.  Each document is decided on its own, without sampling.

A mean hides a handful of insults in ordinary prose, so evidence is also taken where it stands.  Over labelled
documents (``toxic = 1`` against the trusted target, at most ``trusted_rows`` ids each) the *documents* that hold a gram
are counted in a finer table, equal texts once.  Toxic are words and word pairs of log ratio ``TOXIC_RATIO`` or less in
``TOXIC_SHARE`` of the toxic documents, and, as insults are inflected, first four letters of words of log ratio
``STEM_RATIO`` or less in ``STEM_SHARE`` of them (what only near copies share is in fewer).  A document is not kept
if ``TOXIC_HITS`` toxic grams stand within ``TOXIC_WORDS`` words.

Nulls: a null text has no words, fails the base rules and is not kept; a null id keeps its row (it
can't be trusted).  Repeated rows get equal results.  Empty input gives empty output; without any
trusted document all ratios are 0 and only the base rules decide; without a toxic one no gram is toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, drop_path, materialise, workspace
from .textbatch import LOWER, U64, Texts, Words, mix64, span_hashes, sum_by, texts_of, window_hashes, words_of

BUCKET_BITS = 16
TRUSTED_ROWS = 20_000
THRESHOLD = -0.15
PRIOR_GRAMS = 32.0
PRIOR = 10.0
CHUNK = 1024
TOXIC_BITS = 20
TOXIC_RATIO = -1.5
TOXIC_SHARE = 0.1
TOXIC_PRIOR = 7.0  # documents; a mark of few documents is weak evidence
STEM, STEM_BITS = 4, 18
STEM_RATIO, STEM_SHARE = -3.0, 0.05
TOXIC_CELLS = (1 << TOXIC_BITS) + (1 << STEM_BITS)  # of words and pairs, then of first letters
TOXIC_HITS, TOXIC_WORDS = 2, 64

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STARTS_CHARACTER = np.ones(256, bool)
_STARTS_CHARACTER[0x80:0xC0] = False
_WORD_CHARACTER = _STARTS_CHARACTER.copy()
_WORD_CHARACTER[[9, 10, 11, 12, 13, 32]] = False

TRUSTED = "quality = 1 and toxic = 0"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def _in_text(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix64(h + doc.astype(np.uint64) * U64(0x9E3779B97F4A7C15))


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def measure(t: Texts, w: Words) -> dict[str, np.ndarray]:
    """The base columns of each text."""
    n_words = np.diff(w.first)
    symbols = sum_by(_SYMBOL[t.data], t.bounds)
    chars = sum_by(_WORD_CHARACTER[t.data], t.bounds)

    window, at = window_hashes(span_hashes(t.data, w.start, w.end), w.first, 5)
    hit = at[_repeated(_in_text(window, w.doc[at]))]
    covered = np.zeros(len(w.start), bool)
    for j in range(5):
        covered[hit + j] = True
    repeat_words = sum_by(covered, w.first)

    breaks = np.flatnonzero(t.data == 10)
    line_start = np.unique(np.concatenate([t.bounds[:-1], breaks + 1]))
    line_start = line_start[line_start < len(t.data)]
    line_end = np.append(line_start[1:], len(t.data))
    line_end = line_end - (t.data[line_end - 1] == 10) if len(line_start) else line_start
    with_word = np.searchsorted(w.start, line_start) < np.searchsorted(w.start, line_end)
    line_start, line_end = line_start[with_word], line_end[with_word]
    line_doc = np.searchsorted(t.bounds, line_start, side="right") - 1
    _, first_at = np.unique(_in_text(span_hashes(t.data, line_start, line_end), line_doc), return_index=True)
    dup_lines = np.bincount(line_doc, minlength=len(t)) - np.bincount(line_doc[first_at], minlength=len(t))
    return {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words,
        "base_failed": (n_words < 10) | (100 * repeat_words > 20 * n_words),
    }


def gram_hashes(t: Texts, w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, first word) of every word and every two words in a row."""
    h = span_hashes(LOWER[t.data], w.start, w.end)
    yield h, np.arange(len(h))
    yield window_hashes(h, w.first, 2)


def buckets(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64)


def toxic_cells(t: Texts, w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cell, first word) of words, of pairs, and of the first ``STEM`` characters of words that have as many."""
    for h, at in gram_hashes(t, w):
        yield buckets(h, TOXIC_BITS), at
    character = np.append(0, np.cumsum(_STARTS_CHARACTER[t.data]))
    place = np.append(np.flatnonzero(_STARTS_CHARACTER[t.data]), len(t.data))
    at = np.flatnonzero(character[w.end] - character[w.start] >= STEM)
    h = span_hashes(LOWER[t.data], w.start[at], place[character[w.start[at]] + STEM])
    yield (1 << TOXIC_BITS) + buckets(h, STEM_BITS), at


def _count_grams(batches):
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch in batches:
        trusted = batch.column(1).to_numpy(zero_copy_only=False)
        for t in texts_of(batch.column(0)):
            is_trusted = trusted[t.lo : t.hi]
            w = words_of(t)
            for h, at in gram_hashes(t, w):
                bucket, doc = buckets(h, BUCKET_BITS), w.doc[at]
                counts[0] += np.bincount(bucket, minlength=counts.shape[1])
                counts[1] += np.bincount(bucket[is_trusted[doc]], minlength=counts.shape[1])
    for kind in (0, 1):
        rows = counts[kind].reshape(-1, CHUNK)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(rows), kind, np.int32)),
                pa.array(np.arange(len(rows), dtype=np.int32)),
                pa.array(list(rows), pa.list_(pa.int64())),
            ],
            ["kind", "chunk", "counts"],
        )


def labelled_ids(labels: DataFrame, condition: str, name: str, rows: int) -> DataFrame:
    """At most ``rows`` ids of labels that meet a condition, by hash order."""
    ids = labels.where(f"{condition} and doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    return ids.orderBy(F.xxhash64(name), name).limit(rows)


def fit_ratio(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS) -> np.ndarray:
    """The log ratio of each bucket; the table has 2 ** BUCKET_BITS entries whatever the corpus."""
    trusted = labelled_ids(labels, TRUSTED, "trusted_id", trusted_rows)
    flagged = docs.select("doc_id", "text").join(F.broadcast(trusted), F.col("doc_id") == F.col("trusted_id"), "left")
    counts = (
        flagged.select("text", F.col("trusted_id").isNotNull().alias("trusted"))
        .mapInArrow(_count_grams, "kind int, chunk int, counts array<bigint>")
        .select("kind", "chunk", F.posexplode("counts").alias("at", "n"))
        .where("n > 0")
        .groupBy("kind", (F.col("chunk") * CHUNK + F.col("at")).alias("bucket"))
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    table = np.zeros((2, 1 << BUCKET_BITS))
    table[counts["kind"].to_numpy(int), counts["bucket"].to_numpy(int)] = counts["n"].to_numpy()
    if not table[1].sum():
        return np.zeros(table.shape[1])
    expected = table[1].sum() * table[0] / table[0].sum()
    return np.log(table[1] + PRIOR) - np.log(expected + PRIOR)


def _count_documents(batches):
    """Of each bucket, the clean and the toxic documents that hold it; bucket -1 has all of them."""
    counts, n = np.zeros((2, TOXIC_CELLS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for t in texts_of(batch.column(0)):
            w, kind = words_of(t), toxic[t.lo : t.hi].astype(np.int64)
            n += np.bincount(kind, minlength=2)
            cells = np.unique(np.concatenate([w.doc[at].astype(np.int64) * TOXIC_CELLS + cell for cell, at in toxic_cells(t, w)]))
            np.add.at(counts, (kind[cells // TOXIC_CELLS], cells % TOXIC_CELLS), 1)
    held = np.flatnonzero(counts.any(axis=0))
    bucket, both = np.append(held, -1), np.append(counts[:, held], n[:, None], axis=1)
    for lo in range(0, len(bucket), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[part].astype(np.int32)), pa.array(both[0, part]), pa.array(both[1, part])], ["bucket", "clean", "toxic"]
        )


def fit_toxic(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS) -> np.ndarray:
    """Which of the ``TOXIC_CELLS`` cells are toxic."""
    toxic = labelled_ids(labels, "toxic = 1", "toxic_id", trusted_rows)
    # an id with labels of both kinds counts as toxic
    clean = labelled_ids(labels, TRUSTED, "id", trusted_rows).join(F.broadcast(toxic), F.col("id") == F.col("toxic_id"), "left_anti")
    sides = toxic.select(F.col("toxic_id").alias("id"), F.lit(True).alias("toxic")).union(clean.select("id", F.lit(False)))
    counts = (
        docs.select("doc_id", "text")
        .where("text is not null")
        .join(F.broadcast(sides), F.col("doc_id") == F.col("id"))
        .select("text", "toxic")
        .dropDuplicates()  # of at most twice ``trusted_rows`` ids
        .mapInArrow(_count_documents, "bucket int, clean bigint, toxic bigint")
        .groupBy("bucket")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where("bucket < 0 or toxic > 1")  # one document is no evidence
    )
    path = workspace(docs.sparkSession, "toxic-grams")
    counts = materialise(counts, path)
    table, total = np.zeros(TOXIC_CELLS, bool), counts.where("bucket < 0").first()
    if total and total["toxic"]:
        expected = F.col("toxic") * (total["clean"] / total["toxic"])
        ratio, share = F.log((F.col("clean") + TOXIC_PRIOR) / (expected + TOXIC_PRIOR)), F.col("toxic") / total["toxic"]
        stem = F.col("bucket") >= (1 << TOXIC_BITS)
        strong = F.when(stem, (ratio <= STEM_RATIO) & (share >= STEM_SHARE)).otherwise((ratio <= TOXIC_RATIO) & (share >= TOXIC_SHARE))
        found = counts.where((F.col("bucket") >= 0) & strong)
        table[[r["bucket"] for r in found.select("bucket").collect()]] = True
    drop_path(docs.sparkSession, path)
    return table


def locally_toxic(hits: list[np.ndarray], w: Words) -> np.ndarray:
    """Texts with enough toxic grams close together; ``hits`` has the first words of toxic words, pairs and first letters."""
    hit = np.zeros(len(w.start) + 1, bool)
    hit[hits[0]] = hit[hits[2]] = True
    # a pair with a toxic word in it is no further evidence
    hit[hits[1][~hit[hits[1]] & ~hit[hits[1] + 1]]] = True
    at = np.flatnonzero(hit)
    near = at[TOXIC_HITS - 1 :] - at[: len(at) - TOXIC_HITS + 1] < TOXIC_WORDS
    doc = w.doc[at]
    near &= doc[TOXIC_HITS - 1 :] == doc[: len(doc) - TOXIC_HITS + 1]
    return np.bincount(doc[TOXIC_HITS - 1 :][near], minlength=len(w.first) - 1) > 0


def verdicts(t: Texts, table: np.ndarray, toxic: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """The base columns, the ratio and the verdict of each text."""
    w = words_of(t)
    out = measure(t, w)
    total, grams = np.zeros(len(t)), np.zeros(len(t))
    for h, at in gram_hashes(t, w):
        doc = w.doc[at]
        total += np.bincount(doc, table[buckets(h, BUCKET_BITS)], len(t))
        grams += np.bincount(doc, minlength=len(t))
    hits = [at[toxic[cell]] for cell, at in toxic_cells(t, w)]
    out["llr"] = total / (grams + PRIOR_GRAMS)
    out["kept"] = ~out["base_failed"] & (out["llr"] >= threshold) & ~locally_toxic(hits, w)
    return out


def fit_tables(docs: DataFrame, labels: DataFrame, trusted_rows: int):
    return docs.sparkSession.sparkContext.broadcast((fit_ratio(docs, labels, trusted_rows), fit_toxic(docs, labels, trusted_rows)))


def quality_rules(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base columns, ``llr`` and ``kept``."""
    tables = fit_tables(docs, labels, trusted_rows)

    def score(batches):
        for batch in batches:
            for t in texts_of(batch.column(1)):
                out = verdicts(t, *tables.value, threshold)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(t.lo, len(t)), *(pa.array(x) for x in out.values())], ["doc_id", *out]
                )

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id long, {MEASURES}, llr double, kept boolean")


def keep_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """The kept rows of ``docs`` with all their columns: decided where the row is, so nothing is joined back."""
    tables = fit_tables(docs, labels, trusted_rows)
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            for t in texts_of(batch.column(at)):
                kept = verdicts(t, *tables.value, threshold)["kept"]
                yield batch.slice(t.lo, len(t)).filter(pa.array(kept))

    return docs.mapInArrow(keep, docs.schema)


def op9_quality_rules(spark, sf_dir):
    return quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_stage(spark, docs, sf_dir):
    """Documents that the rules keep."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
