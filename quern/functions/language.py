"""Question understanding by script, markers and keywords. Model votes come in as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as lx
from .text import ARABIC, contains_any, count, count_contained

ARABIZI_DIGIT = "[a-zA-Z][2379]|[2379][a-zA-Z]"


def script_marker_language(text: Column) -> Column:
    arabic, latin = count(text, ARABIC), count(text, "[A-Za-z]")
    tokens = F.split(F.lower(text), "[^a-z0-9]+")
    dialect = text.rlike(ARABIZI_DIGIT) | F.arrays_overlap(tokens, F.array(*[F.lit(m) for m in lx.ARABIZI_MARKERS]))
    return (
        F.when((arabic >= latin) & (arabic > 0), F.when(contains_any(text, lx.DARIJA_MARKERS), "Darija").otherwise("arabic_msa"))
        .when(latin > 0, F.when(dialect, "Arabizi").otherwise("french"))
        .otherwise("unknown")
    )


def script_vote(text: Column) -> Column:
    """struct(language, confidence) by shares of characters."""
    arabic, latin, total = count(text, ARABIC), count(text, "[A-Za-z]"), count(text, r"[^\s0-9٠-٩]")
    a, b = F.try_divide(arabic, total), F.try_divide(latin, total)
    ramp = lambda r, t: F.least(F.lit(1.0), (r - t) / (1 - t) + 0.5)
    vote = lambda name, c: F.struct(name.alias("language"), c.cast("double").alias("confidence"))
    return (
        F.when(total < 3, vote(F.lit("unknown"), F.lit(0.0)))
        .when(a > 0.55, vote(F.lit("arabic_msa"), ramp(a, 0.55)))
        .when(b > 0.65, vote(F.lit("french"), ramp(b, 0.65)))
        .otherwise(vote(F.when(a > b, "arabic_msa").otherwise("french"), F.lit(0.4)))
    )


def keyword_vote(text: Column) -> Column:
    arabic, french = count_contained(text, lx.MSA_PHRASES), count_contained(F.lower(text), lx.FRENCH_PHRASES)
    total = arabic + french
    vote = lambda name, hits: F.struct(F.lit(name).alias("language"), F.least(F.lit(1.0), 0.5 + F.try_divide(hits, total * 2)).alias("confidence"))
    return F.when(total == 0, F.struct(F.lit("unknown").alias("language"), F.lit(0.0).alias("confidence"))).when(arabic >= french, vote("arabic_msa", arabic)).otherwise(vote("french", french))


def ensemble_language(df: DataFrame, text_col: str, model_votes: list[tuple[str, float]] = ()) -> DataFrame:
    """Adds language and confidence: dialect markers first, then weighted votes of script, keywords and any model columns.

    A model's vote is a column of struct(language, confidence). Votes are columns of their own, so each is made once.
    """
    text = F.col(text_col)
    voted = df.select(
        "*",
        script_vote(text).alias("_script"),
        keyword_vote(text).alias("_keyword"),
        count_contained(text, lx.ENSEMBLE_DARIJA).alias("_darija"),
        count_contained(F.lower(text), lx.ENSEMBLE_ARABIZI).alias("_arabizi"),
    )
    votes = [("_script", 1.0), ("_keyword", 1.5), *model_votes]
    weight = lambda name: reduce(
        lambda x, y: x + y, [F.when(F.col(v)["language"] == name, F.col(v)["confidence"] * w).otherwise(0.0) for v, w in votes]
    )
    voted = voted.withColumns({"_a": weight("arabic_msa"), "_b": weight("french")}).withColumn("_share", F.try_divide("_a", F.col("_a") + F.col("_b")))
    share, darija, arabizi = F.col("_share"), F.col("_darija"), F.col("_arabizi")
    cases = [
        (F.trim(text) == "", "unknown", F.lit(0.0)),
        (darija >= 2, "Darija", F.least(0.85 + 0.03 * (darija - 2), F.lit(0.95))),
        (arabizi >= 2, "Arabizi", F.least(0.80 + 0.03 * (arabizi - 2), F.lit(0.92))),
        (share.isNull(), "arabic_msa", F.lit(0.3)),
        ((share > 0.25) & (share < 0.75), "mixed", 2 * F.least(share, 1 - share)),
        (share >= 0.75, "arabic_msa", share),
        (F.lit(True), "french", 1 - share),
    ]
    pick = lambda i: F.coalesce(*[F.when(c[0], F.lit(c[i]) if i == 1 else c[i]) for c in cases])
    return voted.select(*df.columns, pick(1).alias("language"), pick(2).alias("confidence"))


def reconcile(text: Column, model_label: Column) -> Column:
    """A model's label unless script rules it out; the script's label without one."""
    script = script_marker_language(text)
    latin = count(text, "[A-Za-z]") > count(text, ARABIC)
    chosen = (
        F.when(model_label.isNull(), script)
        .when(latin & text.rlike(ARABIZI_DIGIT), "Arabizi")
        .when(latin & model_label.isin("arabic_msa", "Darija"), script)
        .when(~latin & model_label.isin("french", "Arabizi"), script)
        .otherwise(model_label)
    )
    return F.struct(chosen.alias("language"), F.when(model_label.isNull(), 0.5).otherwise(0.9).alias("confidence"))


def is_out_of_scope(text: Column) -> Column:
    return contains_any(text, lx.OOS_ARABIC) | contains_any(F.lower(text), lx.OOS_FRENCH)


def is_legal(text: Column) -> Column:
    return contains_any(text, lx.LEGAL_ARABIC) | contains_any(F.lower(text), lx.LEGAL_FRENCH)


def intent_hit(text: Column, keyword: str) -> Column:
    """An Arabic keyword standing as a word, with a proclitic if need be."""
    return text.rlike(rf"(?<![\p{{L}}])(?:[وفبلك]|ال|وال|بال|لل)?{keyword}(?![\p{{L}}])")


def multihop(text: Column) -> Column:
    """struct(votes, is_multihop, confidence, hop_count, signs)."""
    low = F.lower(F.trim(text))
    qwords = count(text, rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(lx.ARABIC_QUESTION_WORDS)})(?![\p{{L}}\p{{N}}_])") + count(
        low, rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(lx.FRENCH_QUESTION_WORDS)})(?![\p{{L}}\p{{N}}_])"
    )
    found = {"qwords": qwords >= 2}
    for sign, (raw, lowered) in lx.MULTIHOP_SIGNS.items():
        found[sign] = text.rlike("|".join(f"(?:{p})" for p in raw)) | low.rlike("|".join(f"(?:{p})" for p in lowered))
    votes = reduce(lambda a, b: a + b, [c.cast("int") for c in found.values()])
    joins = reduce(lambda a, b: a + b, [count(text, p) for p in lx.HOP_SIGNS[0]] + [count(low, p) for p in lx.HOP_SIGNS[1]])
    return F.struct(
        votes.alias("votes"),
        (votes >= 1).alias("is_multihop"),
        (votes / 5).alias("confidence"),
        F.greatest(F.lit(1), F.least(qwords + joins, F.lit(4))).alias("hop_count"),
        F.array_compact(F.array(*[F.when(c, s) for s, c in found.items()])).alias("signs"),
    )


def question_flags(intents: Column, needs_multihop: Column, legal: Column, out_of_scope: Column) -> Column:
    """Flags of a question: out of scope overrides intents, legal is added, documents is the default."""
    with_legal = F.when(legal, F.array_union(intents, F.array(F.lit("LEGAL")))).otherwise(intents)
    final = F.when(out_of_scope, F.array(F.lit("OUT_OF_SCOPE"))).when(F.size(with_legal) == 0, F.array(F.lit("DOCUMENTS"))).otherwise(with_legal)
    return F.struct(
        (~needs_multihop & ~legal & ~out_of_scope).alias("SIMPLE"),
        needs_multihop.alias("MULTIHOP"),
        legal.alias("LEGAL"),
        out_of_scope.alias("OUTSCOPE"),
        final.alias("intents"),
        F.when(needs_multihop, F.greatest(F.lit(1), F.least(F.size(final), F.lit(4)))).otherwise(1).alias("hop_count"),
    )
