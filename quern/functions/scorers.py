"""Model-dependent steps as pluggable columns, each with a deterministic default and its ``method``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grounding as g
from . import lexicon as lx
from .embedding import hashed_vectors
from .metrics import metric_tokens
from .text import words


def overlap_rerank(query: Column, text: Column) -> Column:
    """Share of the query's tokens in the text."""
    q = F.array_distinct(metric_tokens(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, metric_tokens(text))), F.size(q)), F.lit(0.0))


def extractive_answer(query: Column, context: Column) -> Column:
    """The sentence of the context that shares most words with the query."""
    lines = F.filter(F.split(context, r"[.!?\n]+"), lambda s: F.size(words(s)) > 2)
    scored = F.transform(lines, lambda s: F.struct(overlap_rerank(query, s).alias("score"), F.trim(s).alias("line")))
    best = F.aggregate(scored, F.struct(F.lit(-1.0).alias("score"), F.lit("").alias("line")), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    return best["line"]


def judge_verdict(verdict: Column) -> Column:
    """struct(grounded, confidence) of a judge's word."""
    pick = lambda ok, c: F.struct(F.lit(ok).alias("grounded"), F.lit(c).alias("confidence"))
    up = F.upper(verdict)
    return (
        F.when(up.contains("PARTIALLY"), pick(False, 0.6)).when(up.contains("CONTRADICTED"), pick(False, 0.1)).when(up.contains("SUPPORTED"), pick(True, 0.9)).otherwise(pick(False, 0.3))
    )


def entailment(logits: Column) -> Column:
    """Softmax share of the first of an array of logits."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return F.exp(F.element_at(logits, 1) - top) / total


def parse_score(reply: Column) -> Column:
    """A number in [0, 1] from a judge's reply; null without one."""
    return F.nullif(F.regexp_extract(reply, r"(0?\.[0-9]+|[01](?:\.0+)?)", 1), F.lit("")).try_cast("double")


def read_cascade(digital: Column, confidence: Column, vision: Column, ocr: Column, least: int = 100) -> Column:
    """struct(text, tier): digital text if trusted, else a vision model's if long enough, else OCR; null if none."""
    out = lambda c, tier: F.struct(c.alias("text"), F.lit(tier).alias("tier"))
    return F.when(confidence > 0.85, out(digital, "digital")).when(F.length(vision) >= least, out(vision, "vision")).when(F.trim(ocr) != "", out(ocr, "ocr"))


def ocr_language(file: Column) -> Column:
    return F.when(file.contains("_ar"), "ara").when(file.contains("_fr"), "fra").otherwise("ara+fra")


@dataclass
class Scorers:
    """What an engine calls where a model would be; replace any of them with a UDF column."""

    rerank: Callable[[Column, Column], Column] = overlap_rerank
    entail: Callable[[Column, Column], Column] = g.overlap_share
    generate: Callable[[Column, Column], Column] = extractive_answer
    enrich: Callable[[Column], Column] = lambda text: text  # the text a chunk is embedded by
    embed: Callable[[DataFrame, str, Column], DataFrame] = hashed_vectors  # (rows, id column, tokens) to (id, vector)
    methods: dict[str, str] = field(default_factory=lambda: {"rerank": "overlap", "entail": "word_overlap", "generate": "extractive", "embed": "hashed_tokens"})


MESSAGES = {
    ("refuse", "fr"): "Cette question est hors du domaine couvert.",
    ("refuse", "ar"): "هذا السؤال خارج النطاق.",
    ("abstain", "fr"): "Informations insuffisantes dans les documents.",
    ("abstain", "ar"): "غير متوفر في الوثائق.",
    ("legal", "fr"): "Ceci ne remplace pas un avis juridique.",
    ("legal", "ar"): "هذا لا يعوض الاستشارة القانونية.",
}


def message(kind: str, language: Column) -> Column:
    """A fixed message; Arabic scripts get Arabic, all others fall back to French."""
    return F.when(language.isin("arabic_msa", "Darija", "mixed"), MESSAGES[kind, "ar"]).otherwise(MESSAGES[kind, "fr"])


WEIGHTS = (lx.W_DENSE, lx.W_BM25)
