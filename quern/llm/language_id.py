"""Language identification by hyperdimensional letter profiles.

Each letter has a random +1/-1 vector.  A trigram's vector binds (multiplies) its letters' vectors,
each rotated by its place: ``rot2(a) * rot1(b) * c``.  A document's vector bundles (adds) the vectors of
all trigrams of the whole text; a language's prototype bundles those of all its training documents.
A document gets the language whose prototype has the largest cosine, ties to the smaller name.
A text is read between two separators, so texts of one or two letters have trigrams too (``_a_``; ``_ab``, ``ab_``).

Letters are case-folded; a-z have an index each, all other letters share ``OTHER`` indexes by hash, and a
run of non-letters is one separator, so there are ``A ** 3`` trigrams whatever the corpus.  Tasks bundle
their training texts and Spark adds the sums; the driver gets ``DIMENSIONS`` numbers for each of at most ``max_languages``.

Nulls: a null text, or one without a letter, is ``und`` with score 0; a null ``lang`` or id is never
learned from (a null id counts as held out).  Repeated rows get equal results; empty input gives empty
output; with no training documents all are ``und``.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .textbatch import Texts, texts_of

OTHER = 13
A = 1 + 26 + OTHER
DIMENSIONS = 512
UNDETERMINED = "und"
MIN_SCORE = 0.3


@lru_cache(1)
def letter_table() -> np.ndarray:
    """The letter index of each code point; 0 is no letter."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = ord(chr(c).lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 8) % OTHER
    return table


@lru_cache(1)
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (A, DIMENSIONS))


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors of trigram codes ``(a * A + b) * A + c``."""
    v = letter_vectors()
    rot1, rot2 = np.roll(v, 1, axis=1), np.roll(v, 2, axis=1)
    return rot2[codes // (A * A)] * rot1[codes // A % A] * v[codes % A]


class _Rows:
    """Trigram vectors made when first needed."""

    def __init__(self):
        self.at = np.full(A**3, -1, np.int32)
        self.rows = np.zeros((1024, DIMENSIONS), np.float32)
        self.used = 0

    def of(self, codes: np.ndarray) -> np.ndarray:
        new = np.unique(codes[self.at[codes] < 0])
        if len(new):
            while self.used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.used : self.used + len(new)] = trigram_vectors(new)
            self.at[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
        return self.at[codes]


_rows = _Rows()


def trigrams(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams of each text in text order: (first row of each text, code, count, has a letter)."""
    points = np.frombuffer(t.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    starts_character = (t.data & 0xC0) != 0x80
    ends = np.concatenate([[0], np.cumsum(starts_character)])[t.bounds]
    sizes = np.diff(ends)
    doc = np.repeat(np.arange(len(t)), sizes)
    has_letter = np.bincount(doc, letter_table()[points] > 0, len(t)) > 0
    # every text stands between separators, so one letter is a trigram
    letter = np.zeros(len(points) + 2 * len(t), np.int64)
    letter[np.arange(len(points)) + 2 * doc + 1] = letter_table()[points]
    doc = np.repeat(np.arange(len(t)), sizes + 2)
    keep = np.ones(len(letter), bool)
    keep[1:] = (letter[1:] > 0) | (letter[:-1] > 0) | (doc[1:] != doc[:-1])
    letter, doc = letter[keep], doc[keep]
    same = doc[2:] == doc[:-2]
    code = ((letter[:-2] * A + letter[1:-1]) * A + letter[2:])[same]
    key, count = np.unique(doc[:-2][same] * A**3 + code, return_counts=True)
    first = np.searchsorted(key, np.arange(len(t) + 1) * A**3)
    return first, key % A**3, count, has_letter


def profiles(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of texts (zero without a trigram), and which texts have a letter."""
    first, code, count, has_letter = trigrams(t)
    rows, weight = _rows.of(code), count.astype(np.float32)
    out = np.zeros((len(t), DIMENSIONS), np.float32)
    for i in range(len(t)):
        if first[i + 1] > first[i]:
            span = slice(first[i], first[i + 1])
            out[i] = weight[span] @ _rows.rows[rows[span]]
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out, has_letter


def _bundle(batches):
    """Sums of trigram vectors by language; trigrams of a few languages are counted first, then bound once each."""
    counts: dict[str, np.ndarray] = {}
    sums: dict[str, np.ndarray] = {}

    def fold():
        for lang, n in counts.items():
            at, total = np.flatnonzero(n), sums.setdefault(lang, np.zeros(DIMENSIONS))
            for lo in range(0, len(at), 8192):
                total += n[at[lo : lo + 8192]] @ trigram_vectors(at[lo : lo + 8192])
        counts.clear()

    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for t in texts_of(batch.column(0)):
            first, code, count, _ = trigrams(t)
            for lang in set(langs[t.lo : t.hi]):
                mine = np.repeat(langs[t.lo : t.hi] == lang, np.diff(first))
                counts.setdefault(lang, np.zeros(A**3))
                counts[lang] += np.bincount(code[mine], count[mine], A**3)
                if len(counts) > 32:
                    fold()
    fold()
    for lang, v in sums.items():
        at = np.arange(DIMENSIONS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS, pa.string()), pa.array(at), pa.array(v.astype(np.int64))], ["lang", "at", "v"])


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit_prototypes(docs: DataFrame, max_languages: int = 1000) -> tuple[list[str], np.ndarray]:
    """Languages in name order and their unit prototypes, from documents that aren't held out."""
    sums = (
        docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("text", "lang")
        .mapInArrow(_bundle, "lang string, at int, v bigint")
        .groupBy("lang", "at")
        .agg(F.sum("v").alias("v"))
    )
    found = sums.limit(max_languages * DIMENSIONS + 1).toPandas()
    if len(found) > max_languages * DIMENSIONS:
        raise ValueError(f"over {max_languages} languages")
    langs = sorted(found["lang"].unique())
    prototypes = np.zeros((len(langs), DIMENSIONS), np.float64)
    prototypes[np.searchsorted(langs, found["lang"].to_numpy(str)), found["at"].to_numpy(int)] = found["v"].to_numpy(float)
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
    return langs, prototypes.astype(np.float32)


def decide(t: Texts, langs: list[str], prototypes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language index (-1: undetermined) and score of each text."""
    if not langs:
        return np.full(len(t), -1), np.zeros(len(t))
    vectors, has_letter = profiles(t)
    cosine = vectors @ prototypes.T
    best = np.where(has_letter, cosine.argmax(axis=1), -1)
    score = np.where(has_letter, np.clip(cosine.max(axis=1), 0, 1), 0).astype(np.float64)
    return best, score


def predict_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; only ``text`` is an input of a prediction."""
    model = docs.sparkSession.sparkContext.broadcast(fit_prototypes(docs))

    def predict(batches):
        langs, prototypes = model.value
        names = np.array([*langs, UNDETERMINED], object)
        for batch in batches:
            for t in texts_of(batch.column(2)):
                best, score = decide(t, langs, prototypes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(t.lo, len(t)), batch.column(1).slice(t.lo, len(t)), pa.array(names[best], pa.string()), pa.array(score)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        predict, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def keep_determined(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is determined with at least ``min_score``, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit_prototypes(docs))
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            for t in texts_of(batch.column(at)):
                best, score = decide(t, *model.value)
                yield batch.slice(t.lo, len(t)).filter(pa.array((best >= 0) & (score >= min_score)))

    return docs.mapInArrow(keep, docs.schema)


def op8_language_id(spark, sf_dir):
    return predict_language(documents(spark, sf_dir))


def language_stage(spark, docs, sf_dir):
    """Documents in a determined language."""
    return keep_determined(docs)
