"""Scores of one answer against its gold row, and of its contexts; aggregations are in operators.evaluate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import arabizi_tokens, metric_text, strip_citations


def metric_tokens(text: Column) -> Column:
    return F.filter(F.split(metric_text(text), " "), lambda t: t != "")


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays taken as sets; 0 where either is empty or nothing is shared."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(2.0 * both, F.size(x) + F.size(y)), F.lit(0.0))


def token_f1(answer: Column, gold: Column, strip: bool = True) -> Column:
    return set_f1(metric_tokens(strip_citations(answer) if strip else answer), metric_tokens(gold))


def exact_match(answer: Column, gold: Column) -> Column:
    return (metric_text(strip_citations(answer)) == metric_text(gold)).cast("double")


def arabizi_f1(answer: Column, gold: Column) -> Column:
    return set_f1(arabizi_tokens(answer), arabizi_tokens(gold))


def lcs_length(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rouge_l(answer: Column, gold: Column) -> Column:
    """F1 of the longest common token sequence; inputs are arrays of tokens."""
    return F.pandas_udf(_rouge_l, DoubleType())(answer, gold)


def _rouge_l(answer: pd.Series, gold: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(answer, gold, strict=True):
        a, b = list(a) if a is not None else [], list(b) if b is not None else []
        n = lcs_length(a, b)
        out.append(2 * n / (len(a) + len(b)) if n else 0.0)
    return pd.Series(out)


def keyword_hits(text: Column, keywords: Column) -> Column:
    """Share of keywords that occur in the text; null without keywords."""
    held = metric_text(text)
    return F.try_divide(F.size(F.filter(keywords, lambda k: held.contains(metric_text(k)))), F.nullif(F.size(keywords), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def context_redundancy(contexts: Column) -> Column:
    """Mean Jaccard of neighbouring contexts."""
    sets = F.transform(contexts, lambda c: F.array_distinct(metric_tokens(c)))
    n = F.size(sets) - 1
    pairs = F.zip_with(F.slice(sets, F.lit(1), F.greatest(n, F.lit(0))), F.slice(sets, F.lit(2), F.greatest(n, F.lit(0))), jaccard)
    return F.when(n >= 1, F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)


def reciprocal_rank(contexts: Column, keywords: Column) -> Column:
    """1 / place of the first context that holds any keyword."""
    held = F.transform(contexts, lambda c: F.exists(keywords, lambda k: metric_text(c).contains(metric_text(k))))
    return F.coalesce(F.try_divide(F.lit(1.0), F.nullif(F.array_position(held, True), F.lit(0))), F.lit(0.0))


def utilisation(answer: Column, contexts: Column) -> Column:
    mine, theirs = F.array_distinct(metric_tokens(answer)), F.array_distinct(metric_tokens(F.array_join(contexts, " ")))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(mine, theirs)), F.size(theirs)), F.lit(0.0))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b\d[\d,.]*\b"), F.lit(0)))


def invented_numbers(answer: Column, context: Column) -> Column:
    """Share of an answer's numbers that its context doesn't hold; 0 without numbers."""
    mine = numbers(strip_citations(answer))
    return F.coalesce(F.try_divide(F.size(F.array_except(mine, numbers(context))), F.size(mine)), F.lit(0.0))


def any_keyword(text: Column, keywords: Column) -> Column:
    held = metric_text(text)
    return F.exists(keywords, lambda k: held.contains(metric_text(k)))


def dialect_match(answer: Column, language: Column) -> Column:
    """Ten Arabic characters; for Arabizi, letters with digits among them will do."""
    arabic = F.regexp_count(answer, F.lit(r"[\x{0600}-\x{06FF}]")) >= 10
    return (
        F.when(language.isin("Darija", "arabic_msa"), arabic).when(language == "Arabizi", arabic | answer.rlike("[a-zA-Z][2379]|[2379][a-zA-Z]")).cast("double")
    )
