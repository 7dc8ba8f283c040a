"""Pages to chunks: article segments, sentences packed up to a word budget with overlap, in one pass over the texts."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..session import Scratch

_ARTICLE = {True: re.compile(lx.ARABIC_ARTICLE), False: re.compile(lx.FRENCH_ARTICLE)}
_SENTENCE_END = {True: re.compile(r"[،؟\n]+"), False: re.compile(r"[.!?\n]+")}
_NUMBER = re.compile(lx.ARABIC_NUMBER), re.compile(lx.FRENCH_NUMBER, re.I)
_LAW = re.compile(lx.ARABIC_LAW), re.compile(lx.FRENCH_LAW, re.I)
_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_ARABIC_LEADS = bytes(range(0xD8, 0xDC))  # first bytes of U+0600 to U+06FF
_CONTINUED = bytes(range(0x80, 0xC0))
_SPACES = b" \t\n\x0b\f\r"


def language_of(text: str) -> str:
    """What ``functions.text.chunk_language`` says, from counts of bytes."""
    raw = text.encode("utf-8", "replace")
    without = lambda cut: len(raw) - len(raw.translate(None, cut))
    arabic, latin = without(_ARABIC_LEADS), without(_LETTERS)
    n = max(1, len(raw) - without(_CONTINUED) - without(_SPACES))
    if arabic / n > 0.55:
        return "arabic_msa"
    if latin / n > 0.65:
        return "french"
    return "mixed" if arabic / n > 0.2 and latin / n > 0.2 else "arabic_msa"


def article_segments(text: str, arabic: bool) -> list[str]:
    """Segments that begin at an article marker; text before the first one stays if it has enough words. A text without markers is one segment."""
    starts = [m.start() for m in _ARTICLE[arabic].finditer(text)]
    if not starts:
        return [text]
    head = text[: starts[0]].strip()
    parts = [text[a:b].strip() for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
    return [head] * (len(head.split()) >= lx.MIN_CHUNK_WORDS) + [p for p in parts if p]


def pack_sentences(segment: str, arabic: bool, size: int = lx.CHUNK_WORDS, overlap: int = lx.CHUNK_OVERLAP, least: int = lx.MIN_CHUNK_WORDS) -> list[str]:
    """Greedy chunks of whole sentences; a new chunk begins with the last ``overlap`` words of the one before.

    A segment within the budget is a chunk as it is. A sentence over the budget isn't cut. Only the last chunk must have ``least`` words.
    """
    words = segment.split()
    if len(words) <= size:
        return [segment] if len(words) >= least else []
    out, held = [], []
    for sentence in _SENTENCE_END[arabic].split(segment):
        new = sentence.split()
        if held and len(held) + len(new) > size:
            out.append(" ".join(held))
            held = held[-overlap:]
        held += new
    if len(held) >= least:
        out.append(" ".join(held))
    return out


def _first(patterns, text: str, group: int) -> str:
    return next((m.group(group).strip() for p in patterns if (m := p.search(text))), "")


def page_chunks(text: str) -> list[tuple]:
    """(seg, pos, text, language, article_number, law_name) of a page with enough words.

    Number and law are those of the whole segment, so later chunks of a long article keep them.
    """
    if len(text.split()) < lx.MIN_PAGE_WORDS:
        return []
    out = []
    for seg, segment in enumerate(article_segments(text, language_of(text) in ("arabic_msa", "mixed"))):
        chunks = pack_sentences(segment, language_of(segment) in ("arabic_msa", "mixed"))
        if chunks:
            number, law = _first(_NUMBER, segment, 1), _first(_LAW, segment, 0)
            out += [(seg, pos, chunk, language_of(chunk), number, law) for pos, chunk in enumerate(chunks)]
    return out


def chunk_pages(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, seg, pos, text, language, article_number, law_name, lang_bucket) of pages with enough words."""
    names = [id_col, "seg", "pos", "text", "language", "article_number", "law_name"]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                ids, texts = batch.column(0).slice(lo, 256), batch.column(1).slice(lo, 256).to_pylist()
                rows = [(i, *c) for i, text in enumerate(texts) if text for c in page_chunks(text)]
                if rows:
                    at, *columns = zip(*rows, strict=True)
                    kinds = [pa.int32(), pa.int32(), *[pa.string()] * 4]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    id_type = pages.schema[id_col].dataType.simpleString()
    chunks = pages.select(id_col, "text").mapInArrow(run, f"{id_col} {id_type}, seg int, pos int, text string, language string, article_number string, law_name string")
    return chunks.withColumn("lang_bucket", F.when(F.col("language").isin("arabic_msa", "mixed"), "arabic").otherwise("french"))


def numbered(df: DataFrame, order: list[str], groups: list[str] | None = None, name: str = "ord") -> DataFrame:
    """``name``: the place of each row in ``order`` (from 0) within its group, without one task for all rows or for a whole group.

    Rows are written once by ranges of (groups, order); a row's place is the number of its group's rows in the ranges
    before, plus its place in its range. There is a count for each range and group.
    """
    groups, keep = groups or [], Scratch(df.sparkSession, "numbered").keep
    parts = keep(df).repartitionByRange(*groups, *order).withColumn("part", F.spark_partition_id())  # ranges are drawn from what is written
    parts = keep(parts)
    sizes = parts.groupBy("part", *groups).count()
    before = F.sum("count").over(Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part", *groups, F.coalesce(before, F.lit(0)).alias("before"))
    same = [parts[c].eqNullSafe(sizes[c]) for c in ["part", *groups]]
    at = F.row_number().over(Window.partitionBy("part", *groups).orderBy(*order)) - 1
    placed = parts.withColumn("at", at)
    same = [placed[c].eqNullSafe(sizes[c]) for c in ["part", *groups]]
    return placed.join(F.broadcast(sizes), same).select(*[placed[c] for c in df.columns], (F.col("before") + F.col("at")).alias(name))


def number_chunks(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A global ordinal in (id, seg, pos) order and its ``chunk_%04d`` name."""
    return numbered(chunks, [id_col, "seg", "pos"]).withColumn("chunk_id", F.format_string("chunk_%04d", F.col("ord")))
