"""Column functions over text: cleaning, tokenizers, scripts, sentences, citations. All run in the JVM but ``nfkc``."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicon as lx

ARABIC = r"[\x{0600}-\x{06FF}]"
NOT_WORD = r"[^\p{L}\p{N}_\s\x{0600}-\x{06FF}]"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def words(text: Column) -> Column:
    """White-space separated words; none for empty or null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles], F.lit(False))


def count_contained(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(n).cast("int") for n in needles], F.lit(0))


def nfkc(text: Column) -> Column:
    """Unicode NFKC; Spark has no function for it."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.pandas_udf(run, StringType())(text)


def clean_text(text: Column, *, normalise: bool = True, preserve_newlines: bool = False) -> Column:
    """Compatibility forms, single spaces, and only letters, digits, common punctuation. Idempotent."""
    out = nfkc(text) if normalise else text
    out = F.regexp_replace(out, r"[^\S\n]+" if preserve_newlines else r"\s+", " ")
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}_\s\x{0600}-\x{06FF}\x{00C0}-\x{024F}.,،؟?!:;«»()\-/]", ""))


def arabic_tokens(text: Column, stopwords: list[str] = lx.ARABIC_STOPWORDS) -> Column:
    out = F.translate(F.regexp_replace(text, f"[{lx.DIACRITICS}]", ""), *lx.ARABIC_FOLD)
    out = F.regexp_replace(out, r"(?<![\p{L}\p{N}_])ال", "")
    return F.filter(F.split(out, r"[^\x{0600}-\x{06FF}]+"), lambda t: (F.length(t) >= 2) & ~t.isin(stopwords))


def french_tokens(text: Column, stopwords: list[str] = lx.FRENCH_STOPWORDS) -> Column:
    out = F.translate(F.lower(text), *lx.FRENCH_FOLD)
    return F.filter(F.split(out, "[^a-z0-9]+"), lambda t: (F.length(t) >= 2) & ~t.isin(stopwords))


def bm25_tokens(text: Column, language: Column) -> Column:
    return F.when(language.isin("arabic_msa", "mixed", "Darija"), arabic_tokens(text)).otherwise(french_tokens(text))


def sentences(text: Column, arabic: Column) -> Column:
    split = F.when(arabic, F.split(text, r"[،؟\n]+")).otherwise(F.split(text, r"[.!?\n]+"))
    return F.filter(F.transform(split, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def script_counts(text: Column) -> tuple[Column, Column, Column]:
    """Arabic characters, ASCII letters, characters that aren't white space."""
    return count(text, ARABIC), count(text, "[A-Za-z]"), count(text, r"\S")


def chunk_language(text: Column) -> Column:
    """arabic_msa, french or mixed by shares of characters; empty text is arabic_msa."""
    arabic, latin, total = script_counts(text)
    n = F.greatest(total, F.lit(1))
    return (
        F.when(arabic / n > 0.55, "arabic_msa").when(latin / n > 0.65, "french").when((arabic / n > 0.2) & (latin / n > 0.2), "mixed").otherwise("arabic_msa")
    )


def language_guess(text: Column) -> Column:
    """By the share of Arabic among Arabic and Latin letters alone."""
    arabic, latin, _ = script_counts(text)
    share = F.try_divide(arabic, arabic + latin)
    return F.when(share > 0.55, "arabic").when(share < 0.35, "french").when(share.isNull(), "unknown").otherwise("mixed")


def language_bucket(language: Column) -> Column:
    return F.when(language.isin("arabic_msa", "mixed"), "arabic").otherwise("french")


def script_of(text: Column) -> Column:
    letters, arabic = count(text, r"\p{L}"), count(text, r"[\p{L}&&[\x{0600}-\x{06FF}]]")
    share = F.try_divide(arabic, letters)
    return F.when(share.isNull(), "none").when(share > 0.6, "arabic").when(share < 0.2, "latin").otherwise("mixed")


def ocr_confidence(text: Column) -> Column:
    arabic, latin, _ = script_counts(text)
    w = words(text)
    share = F.try_divide(arabic, arabic + latin)
    mean_length = F.try_divide(F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)), F.size(w))
    score = 0.4 * (1 - F.abs(0.5 - share)) + 0.3 * F.least(mean_length / 8, F.lit(1.0)) + 0.3 * F.least(F.size(F.array_distinct(F.split(text, ""))) / 100, F.lit(1.0))
    poor = (F.length(text) < 50) | (F.size(w) < 10) | share.isNull()
    return F.when(poor, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))))


def deloop(text: Column) -> Column:
    """A word four or more times in a row is left once; lines of six or more equal words go."""
    once = F.regexp_replace(text, r"(?<!\S)(\S+)(\s+\1){3,}(?!\S)", "$1")
    kept = F.filter(F.split(once, "\n"), lambda line: ~((n_words(line) >= 6) & (F.size(F.array_distinct(words(line))) == 1)))
    return F.array_join(kept, "\n")


def article_number(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, "(?U)" + lx.ARABIC_NUMBER, 1), F.lit("")), F.regexp_extract(text, "(?iU)" + lx.FRENCH_NUMBER, 1))


def law_name(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, "(?U)" + lx.ARABIC_LAW, 0), F.lit("")), F.regexp_extract(text, "(?iU)" + lx.FRENCH_LAW, 0))


def short_source(source: Column) -> Column:
    return F.when(source.rlike("^(?i)https?://"), F.regexp_extract(source, "^(?i)https?://([^/]+)", 1)).otherwise(source)


def is_garbage(text: Column) -> Column:
    n = F.greatest(F.length(text), F.lit(1))
    junk = (count(text, ARABIC) / n < 0.10) & (count(text, "[a-z]") / n < 0.15) & (count(text, r"[0-9/\\(),;:]") / n > 0.15)
    return text.isNull() | (n_words(text) < 5) | junk


def truncate_at_sentence(text: Column, limit: int = 900) -> Column:
    """At most ``limit`` characters, back to the first kind of separator found past half of them."""
    cut = F.substring(text, 1, limit)
    back = F.reverse(cut)
    ends = [limit - F.locate(s, back) + 1 for s in ("؟", "!", ".", "،", "\n")]
    chosen = F.coalesce(*[F.when((F.locate(s, back) > 0) & (e - 1 > limit // 2), e) for s, e in zip(("؟", "!", ".", "،", "\n"), ends, strict=True)], F.lit(limit))
    return F.when(F.length(text) <= limit, text).otherwise(F.substring(cut, F.lit(1), chosen))


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?i)\[Source:[^\]]*\]", ""), r"https?://\S+", "")


def metric_text(text: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), NOT_WORD, " "), r"\s+", " "))


def match_text(text: Column) -> Column:
    """For entity matching: Western digits, no tashkeel, single spaces, lower case."""
    out = F.regexp_replace(F.translate(text, "٠١٢٣٤٥٦٧٨٩", "0123456789"), r"[\x{064B}-\x{0652}\x{0670}]", "")
    return F.lower(F.trim(F.regexp_replace(out, r"\s+", " ")))


def arabizi_tokens(text: Column) -> Column:
    """Spelling variants of romanised dialect fall together; digits 2 and 9 follow the fixed map."""
    out = F.translate(F.lower(text), "372985", "ahqakh")
    for pattern, to in (("[0-9]", ""), ("[^a-z]+", " "), (r"(.)\1+", "$1"), ("[aeiouy]", "")):
        out = F.regexp_replace(out, pattern, to)
    return F.array_distinct(F.filter(F.split(out, r"\s+"), lambda t: F.length(t) >= 2))


def has_abstain_marker(answer: Column, markers: list[str] = lx.ABSTAIN_MARKERS) -> Column:
    return contains_any(F.lower(F.coalesce(answer, F.lit(""))), markers)


def canonical_language(label: Column) -> Column:
    names = {"ar": "arabic_msa", "arabic": "arabic_msa", "msa": "arabic_msa", "fr": "french", "français": "french", "darija": "Darija", "arabizi": "Arabizi"}
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(label))), label)


def render_context(source: Column, page: Column, text: Column) -> Column:
    return F.concat(F.lit("[Source: "), short_source(source), F.lit(" | Page: "), page.cast("string"), F.lit("]\n"), text)


def numbered_lines(text: Column, n: int) -> Column:
    """Items of lines like ``1. item`` of two words or more, at most n."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^[0-9]+\.\s*(.+)$"), F.lit(1))
    return F.slice(F.filter(found, lambda x: n_words(x) >= 2), 1, n)


def add_workdays(start: Column, days: Column) -> Column:
    """The date ``days`` Mondays to Fridays after ``start``, in closed form."""
    weekday = F.weekday(start)
    base = F.date_sub(start, F.greatest(weekday - 4, F.lit(0)))  # a weekend counts from its Friday
    from_monday = F.least(weekday, F.lit(4)) + days
    whole = F.floor(from_monday / 5).cast("int")
    moved = F.date_add(base, (whole * 7 + from_monday % 5 - F.least(weekday, F.lit(4))).cast("int"))
    return F.when(days > 0, moved).otherwise(start)
