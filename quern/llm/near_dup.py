"""Near-duplicate components by SetSketch registers, bands, a joint likelihood estimate and verification.

A document's set is its distinct 5-word shingles (A-Z lower-cased; with fewer words the whole sequence is
one shingle; without words there is none, and the document is linked with nothing).

1. A set's sketch has ``REGISTERS`` registers ``clip(floor(1 - log_B(e)))``, e the least of exponential hashes
   of rate ``RATE`` over the set: exponentially spaced truncated minima, mergeable by maximum.
2. Equal sets are one class, stood for by its smallest doc_id.
3. ``ROWS`` registers in a row are a band; classes that share a band's values meet in a bucket.  At
   similarity 0.75 a pair meets in none of the bands with probability 2e-5.
4. Each class is tried against the smallest class of each of its buckets: registers and set sizes give the
   maximum-likelihood similarity, the likeliest partner is verified on full sets, and verified links are
   contracted into components.
5. Of classes that share a bucket but not a component, those outside a bucket's largest component are
   tried against the others wherever two hold a rare enough shingle in common (``rare_meetings``), and
   these pairs are estimated and verified in the same way.  So every pair that meets in a bucket is in one
   component, was verified, or can't reach 0.75 by its estimate or its rarest shingles; copies aren't
   expanded into pairs, and no bucket is capped.

An estimate below ``ESTIMATE_FLOOR`` (more than 4.5 standard deviations under 0.75) ends a pair's trial.

Nulls: a null text has no words.  Rows that share an id are one document: what links to one links to the
other; a null id stands for itself and gets the smallest id of its component, or null.  Empty input
gives empty output.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise, workspace
from .textbatch import LOWER, U64, mix64, span_hashes, texts_of, window_hashes, words_of

SHINGLE = 5
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
B, RATE, TOP = 1.1, 20.0, 255
ESTIMATE_FLOOR = 0.61
NULL_NODES = 1 << 62  # nodes of rows without an id come after all ids

_MULTIPLIERS = np.random.default_rng(99).integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(column: pa.Array, k: int = SHINGLE):
    """Yields, text by text, the sorted distinct shingle hashes."""
    for t in texts_of(column):
        w = words_of(t)
        h = span_hashes(LOWER[t.data], w.start, w.end)
        shingles, at = window_hashes(h, w.first, k)
        cut = np.searchsorted(at, w.first)
        for i in range(len(t)):
            n = w.first[i + 1] - w.first[i]
            if n >= k:
                x = np.sort(shingles[cut[i] : cut[i + 1]])
                yield x[np.append(True, x[1:] != x[:-1])]
            elif n:
                whole, _ = window_hashes(h[w.first[i] : w.first[i + 1]], np.array([0, n]), int(n))
                yield mix64(whole + U64(n))
            else:
                yield h[:0]


def registers(s: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes."""
    if not len(s):
        return np.zeros(REGISTERS, np.uint8)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for lo in range(0, len(s), 256):
        np.minimum(least, np.multiply.outer(s[lo : lo + 256], _MULTIPLIERS).min(axis=0), out=least)
    u = (least.astype(np.float64) + 1) / 2.0**64
    e = -np.log1p(-np.minimum(u, 1 - 2**-53)) / RATE
    return np.clip(np.floor(1 - np.log(e) / np.log(B)), 0, TOP).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, grid: int = 101) -> np.ndarray:
    """Maximum-likelihood similarity of pairs (rows of registers) with known set sizes."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, grid)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    p_more, p_less = p(u - v * j), p(v - u * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = [np.where(n > 0, n * np.log(np.maximum(q, 1e-300)), 0) for n, q in ((more, p_more), (less, p_less), (same, 1 - p_more - p_less))]
    return np.take_along_axis(j, sum(terms).argmax(axis=1)[:, None], axis=1)[:, 0]


def _sketch(batches):
    for batch in batches:
        ids = batch.column(0).to_pylist()
        at = 0
        rows = []

        def out(rows):
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "node", "n", "digest", "regs"])

        for s in shingle_sets(batch.column(1)):
            digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            node = ids[at] if ids[at] is not None else NULL_NODES | int.from_bytes(digest[:8], "little") >> 2
            rows.append((ids[at], node, len(s), digest, registers(s).tobytes()))
            at += 1
            if len(rows) == 4096:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)


def _estimated(batches):
    for batch in batches:
        regs = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, REGISTERS) for i in (2, 4)]
        sizes = [batch.column(i).to_numpy() for i in (3, 5)]
        got = np.concatenate([estimate(*(x[lo : lo + 1024] for x in (*regs, *sizes))) for lo in range(0, batch.num_rows, 1024)] or [np.zeros(0)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got)], ["a", "b", "similarity"]).filter(pa.array(got >= ESTIMATE_FLOOR))


def _linked(batches):
    """(a, b, text of a, text of b) in, linked pairs out; rows with the same ``b`` come together."""
    last, known = None, None
    for batch in batches:
        sets = shingle_sets(batch.column(2))
        links = []
        for a, b, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if known is None or last != text:
                last, known = text, next(shingle_sets(pa.array([text], pa.string())))
            mine = next(sets)
            both = len(np.intersect1d(mine, known, assume_unique=True))
            if both and 100 * both >= 75 * (len(mine) + len(known) - both):
                links.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])


class _Work:
    """Tables of one run in a folder of the shared storage."""

    def __init__(self, spark: SparkSession):
        self.path, self.n = workspace(spark, "near-dup"), 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        return materialise(df, f"{self.path}/{self.n}-{name}")


def components(edges: DataFrame, work: _Work) -> DataFrame:
    """(node, label): the least node of each node's component, by neighbours' minima and pointer jumps."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = work.keep(both, "edges")
    labels = work.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        near = work.keep(near, "near")
        lower = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("lower"))
        lower = work.keep(lower, "lower")
        to = lower.select(F.col("node").alias("lower"), F.col("lower").alias("jump"))
        new = work.keep(lower.join(to, "lower", "left").select("node", F.coalesce("jump", "lower").alias("label"), F.col("label").alias("was")), "labels")
        changed = new.where("label <> was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def _shingle_rows(batches):
    for batch in batches:
        nodes = batch.column(0).to_pylist()
        for lo in range(0, len(nodes), 256):
            sets = list(shingle_sets(batch.column(1).slice(lo, 256)))
            owner = np.repeat(np.array(nodes[lo : lo + 256], np.int64), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(sets).view(np.int64))], ["node", "shingle"])


def rare_meetings(whole: DataFrame, texts: DataFrame, work: _Work) -> DataFrame:
    """(a, b), a > b, of different components, where a ``minor`` class could reach 0.75 with another class.

    Shingles are ordered by how many of these classes hold them, rarest first.  Sets of sizes m and n with
    similarity 0.75 share at least 3/7 (m + n) shingles, so the first shared one stands at most that far from either
    set's end.  Classes whose differences are all their own therefore meet nowhere, however many they are.
    """
    held = work.keep(texts.mapInArrow(_shingle_rows, "node long, shingle long").distinct(), "held")
    spread = work.keep(held.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "spread")
    common = work.keep(held.join(spread, "shingle"), "common")
    order = Window.partitionBy("node").orderBy("df", "shingle")
    placed = common.join(whole, "node").withColumn("shared", F.count("*").over(Window.partitionBy("node"))).withColumn("at", F.row_number().over(order) - 1)
    placed = placed.withColumn("at", F.col("at") + F.col("n") - F.col("shared")).where("4 * (n - at) >= 3 * n")
    placed = work.keep(placed.select("shingle", "node", "n", "label", "minor", "at"), "placed")
    x, y = placed.where("minor").alias("x"), placed.alias("y")
    return (
        x.join(
            y,
            F.expr(
                "x.shingle = y.shingle and x.label <> y.label and (not y.minor or x.node < y.node)"
                " and 7 * (x.n - x.at) >= 3 * (x.n + y.n) and 7 * (y.n - y.at) >= 3 * (x.n + y.n)"
            ),
        )
        .select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    spark = docs.sparkSession
    work = _Work(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = work.keep(docs.mapInArrow(_sketch, "doc_id long, node long, n long, digest binary, regs binary"), "sketches")
    filled = rows.where("n > 0")
    classes = work.keep(filled.groupBy("digest").agg(F.min("node").alias("node")), "classes")
    # a class's sketch is that of its smallest row; rows that share an id may be several classes
    sketches = work.keep(
        filled.select("digest", "node", "n", "regs").join(classes, ["digest", "node"], "left_semi").dropDuplicates(["digest"]), "classes-sketched"
    )

    bands = sketches.select(
        "node",
        "n",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(BANDS - 1)),
                lambda i: i.cast("long") * (1 << 40) + F.conv(F.hex(F.substring("regs", i * ROWS + 1, F.lit(ROWS))), 16, 10).cast("long"),
            )
        ).alias("bucket"),
    )
    bands = work.keep(bands, "bands")
    buckets = bands.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").select("bucket", "leader")
    buckets = work.keep(buckets, "buckets")
    met = work.keep(bands.join(buckets, "bucket").select("bucket", "node", "n", "leader"), "met")

    def trial(pairs: DataFrame, name: str) -> DataFrame:
        """(a, b) with their estimated similarity, of those worth verifying."""
        left = sketches.select(F.col("node").alias("a"), F.col("regs").alias("regs_a"), F.col("n").alias("n_a"))
        right = sketches.select(F.col("node").alias("b"), F.col("regs").alias("regs_b"), F.col("n").alias("n_b"))
        sized = pairs.join(left, "a").join(right, "b").where("100 * n_a >= 75 * n_b and 100 * n_b >= 75 * n_a")
        return work.keep(sized.select("a", "b", "regs_a", "n_a", "regs_b", "n_b").mapInArrow(_estimated, "a long, b long, similarity double"), name)

    class_text = None

    def texts() -> DataFrame:
        """Texts of the classes that met others, one row for each class."""
        nonlocal class_text
        if class_text is None:
            wanted = met.select("node").distinct()
            told = docs.withColumn("node", F.col("doc_id")).where("doc_id is not null").select("node", "text").join(wanted, "node", "left_semi")
            null_ids = docs.where("doc_id is null")
            if null_ids.limit(1).count():
                marked = null_ids.mapInArrow(_null_nodes, "node long, text string")
                told = told.unionAll(marked.join(wanted, "node", "left_semi"))
            class_text = work.keep(told.withColumn("h", F.xxhash64("text")).dropDuplicates(["node", "h"]).drop("h"), "texts")
        return class_text

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        left = texts().select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        right = texts().select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        held = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        return work.keep(held.mapInArrow(_linked, "a long, b long").distinct(), name)

    tried = work.keep(met.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "stars")
    likely = trial(tried, "stars-likely")
    first = likely.groupBy("a").agg(F.max_by("b", F.struct("similarity", -F.col("b"))).alias("b"))
    links = verified(work.keep(first, "first"), "first-links")
    labels = components(links, work)

    placed = work.keep(
        met.select("bucket", "node", "n").join(labels, "node", "left").select("bucket", "node", "n", F.coalesce("label", "node").alias("label")), "placed"
    )
    split = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    apart = work.keep(placed.join(work.keep(split, "split"), "bucket", "left_semi"), "apart")
    main = apart.groupBy("bucket", "label").count().groupBy("bucket").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    main = work.keep(main, "main")
    sided = work.keep(apart.join(main, "bucket").withColumn("minor", F.col("label") != F.col("main")).drop("main"), "sided")
    # of each class, whether some bucket holds it outside its largest component
    whole = work.keep(sided.groupBy("node").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.max("minor").alias("minor")), "whole")
    rest = rare_meetings(whole, texts().join(whole.select("node"), "node", "left_semi"), work)
    unlike = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # stars that the estimate ended or verification refused needn't be tried again; likely ones that weren't first must be
    done = unlike.join(likely.select("a", "b"), ["a", "b"], "left_anti").unionAll(first.select("a", "b"))
    rest = work.keep(rest, "rest").join(done, ["a", "b"], "left_anti")
    more = verified(trial(rest, "rest-likely"), "rest-links")
    # the classes of rows that share an id
    shared = filled.groupBy("node").agg(F.min(F.xxhash64("digest")).alias("lo"), F.max(F.xxhash64("digest")).alias("hi")).where("lo <> hi").select("node")
    joined = filled.select("node", "digest").join(shared, "node", "left_semi").join(classes.withColumnRenamed("node", "b"), "digest")
    joined = joined.where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    labels = components(links.unionAll(more).unionAll(joined), work)

    placed_rows = rows.join(classes.withColumnRenamed("node", "class_node"), "digest", "left")
    component = F.when(F.col("n") > 0, F.coalesce("label", "class_node")).otherwise(F.col("node"))
    return (
        placed_rows.join(labels.select(F.col("node").alias("class_node"), "label"), "class_node", "left")
        .withColumn("component_id", F.when(component < NULL_NODES, component))
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id").eqNullSafe(F.col("component_id")), F.lit(False)).alias("kept"))
    )


def _null_nodes(batches):
    for batch in batches:
        nodes = [NULL_NODES | int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8 * 2).digest()[:8], "little") >> 2 for s in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), batch.column(1)], ["node", "text"])


def op5_near_dup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


def near_dup_stage(spark, docs, sf_dir):
    """One document of each component stays: the one with the smallest id (of repeated rows, one)."""
    kept = materialise(near_duplicates(docs).where("kept").select("doc_id", "n_shingles"), workspace(spark, "near-dup-kept"))
    ids = kept.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("n_shingles").alias("n"))
    whole = ids.where("rows = 1 or n = 0 or doc_id is null")
    several = ids.where("rows > 1 and n > 0 and doc_id is not null")
    single = docs.join(whole, docs["doc_id"].eqNullSafe(whole["doc_id"]), "left_semi")
    repeated = docs.join(several, docs["doc_id"] == several["doc_id"], "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(repeated)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM w),
c AS MATERIALIZED (SELECT min(doc_id) AS c, s FROM s WHERE len(s) > 0 GROUP BY s),
e AS MATERIALIZED (SELECT c, len(s) AS n, unnest(s) AS x FROM c),
p AS MATERIALIZED (SELECT a.c AS a, b.c AS b FROM e a JOIN e b ON a.x = b.x AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(c, m) AS (SELECT c, c FROM c UNION SELECT l.b, r.m FROM r JOIN l ON r.c = l.a),
m AS (SELECT c, min(m) AS m FROM r GROUP BY c)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(m.m, s.doc_id) AS component_id, s.doc_id = coalesce(m.m, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN m ON m.c = c.c
"""
