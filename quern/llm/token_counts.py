"""Token counts of fields or sections by offset-mapped attribution.

A document is encoded once, whole, with the tokenizers library.  Its tokens' character spans are
interval-joined to section spans.  Rule for a token that crosses a boundary: it goes to the section that
holds most of its characters, ties to the earlier one; a token outside every section goes to none.

Sections are the lines of a text, each with its line break (``line_sections``), or the fields of a row,
rendered as ``field`` + separator + ``field`` (``field_token_counts``; separators belong to no field,
so a token that also holds a separator is judged by its characters in fields).

Nulls: a null text is an empty text, which has one empty section with no tokens; a null field is an
empty field.  Repeated rows keep their rows; empty input gives empty output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import tokenizer_definition
from .common import documents
from .library_encoder import library_encoder
from .textbatch import texts_of


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of lines; each but the last holds its line break."""
    lengths = np.array([len(x) + 1 for x in text.split("\n")], np.int64)
    ends = np.cumsum(lengths)
    ends[-1] -= 1
    return ends - np.append(lengths[:-1], lengths[-1] - 1), ends


def attribute(starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section (or -1) of each token and whether it crosses a boundary; sections [lo, hi) are in order and apart."""
    first = np.searchsorted(hi, starts, side="right")  # the first section that ends after the token starts
    stop = np.searchsorted(lo, ends, side="left")  # those before it start before the token ends
    section = np.where(first < stop, first, -1)
    inside = first < np.minimum(stop, len(lo))
    crosses = np.zeros(len(starts), bool)
    at = np.minimum(first, len(lo) - 1)
    crosses[inside] = (starts[inside] < lo[at[inside]]) | (ends[inside] > hi[at[inside]])
    for k in np.flatnonzero(inside & (stop - first > 1)):
        span = np.arange(first[k], stop[k])
        section[k] = span[np.argmax(np.minimum(hi[span], ends[k]) - np.maximum(lo[span], starts[k]))]
    return section, crosses


def section_token_counts(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row per line of each text: doc_id, section, char_start, char_end, n_tokens, n_crossing, doc_tokens."""
    definition = docs.sparkSession.sparkContext.broadcast(tokenizer_definition(tokenizer_path, "byte_bpe_50k.json"))

    def run(batches):
        encoder = library_encoder(definition.value)
        for batch in batches:
            for t in texts_of(batch.column(1)):
                ids = batch.column(0).slice(t.lo, len(t))
                texts = [x or "" for x in batch.column(1).slice(t.lo, len(t)).to_pylist()]
                lines, los, his, counts, crossing, totals = [], [], [], [], [], []
                for text, (starts, ends) in zip(texts, encoder.spans_of(t), strict=True):
                    lo, hi = line_sections(text)
                    section, crosses = attribute(starts, ends, lo, hi)
                    lines.append(np.arange(len(lo), dtype=np.int32))
                    los.append(lo)
                    his.append(hi)
                    counts.append(np.bincount(section[section >= 0], minlength=len(lo)))
                    crossing.append(np.bincount(section[crosses], minlength=len(lo)))
                    totals.append(np.full(len(lo), len(starts)))
                row = np.repeat(np.arange(len(texts)), [len(x) for x in lines])
                columns = [pa.array(np.concatenate(x)) for x in (lines, los, his, counts, crossing, totals)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), *columns],
                    ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, section int, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"
    )


def field_token_counts(df: DataFrame, id_col: str, fields: list[str], separator: str = "\n", tokenizer_path: str | None = None) -> DataFrame:
    """One row per row and field: id, field, n_tokens, n_crossing; the rendered row is encoded once."""
    definition = df.sparkSession.sparkContext.broadcast(tokenizer_definition(tokenizer_path, "byte_bpe_50k.json"))
    id_type = df.schema[id_col].dataType.simpleString()
    chosen = df.select(F.col(id_col), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"field_{i}") for i, f in enumerate(fields)])

    def run(batches):
        encoder = library_encoder(definition.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                values = list(zip(*(part.column(1 + i).to_pylist() for i in range(len(fields))), strict=True))
                tokens, crossing = [], []
                for row, (starts, ends) in zip(values, encoder.spans_batch([separator.join(v) for v in values]), strict=True):
                    lengths = np.array([len(v) for v in row], np.int64)
                    lo = np.cumsum(lengths + len(separator)) - lengths - len(separator)
                    filled = np.flatnonzero(lengths)
                    n, c = np.zeros(len(fields), np.int64), np.zeros(len(fields), np.int64)
                    if len(filled):
                        section, crosses = attribute(starts, ends, lo[filled], (lo + lengths)[filled])
                        n[filled] = np.bincount(section[section >= 0], minlength=len(filled))
                        c[filled] = np.bincount(section[crosses & (section >= 0)], minlength=len(filled))
                    tokens.append(n)
                    crossing.append(c)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(values)), len(fields))))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(fields * len(values), pa.string()), pa.array(np.concatenate(tokens)), pa.array(np.concatenate(crossing))],
                    [id_col, "field", "n_tokens", "n_crossing"],
                )

    return chosen.mapInArrow(run, f"`{id_col}` {id_type}, field string, n_tokens long, n_crossing long")


def op7_token_counts(spark, sf_dir):
    return section_token_counts(documents(spark, sf_dir))
