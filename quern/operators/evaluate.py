"""Aggregations over scored answers: confusion, latency, breakdowns, comparisons of systems."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..functions.text import has_abstain_marker, n_words, strip_citations
from ..session import Scratch


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, predicted: Column, actual: Column, by: list[str] = ()) -> DataFrame:
    """tp, fp, fn, tn and precision, recall, f1, accuracy, with 0 for empty denominators."""
    n = lambda c: F.count_if(c)
    counts = df.groupBy(*by).agg(
        n(predicted & actual).alias("tp"), n(predicted & ~actual).alias("fp"), n(~predicted & actual).alias("fn"), n(~predicted & ~actual).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by, "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


def nearest_rank(df: DataFrame, by: list[str], value: str, percents: list[int]) -> DataFrame:
    """(by..., pct, value): the value at 0-based place floor(n * p / 100) in order, the last one at most.

    Ranks come from counts of distinct values.  The counts are cut into ranges of values, running sums stay within a
    range and start from the sum of the ranges before it, so a group of many distinct values isn't gathered in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    parts = Scratch(df.sparkSession, "ranks").keep(counts.repartitionByRange(*by, value).withColumn("part", F.spark_partition_id()))  # ranges are drawn once
    sums = parts.groupBy(*by, "part").agg(F.sum("n").alias("in_part"))
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("before"), F.sum("in_part").over(Window.partitionBy(*by)).alias("total"))
    within = Window.partitionBy(*by, "part").orderBy(value)
    upto = parts.join(sums, [*by, "part"]).withColumn("upto", F.col("before") + F.sum("n").over(within))
    wanted = upto.withColumn("pct", F.explode(F.array(*[F.lit(p) for p in percents])))
    place = F.least(F.floor(F.col("total") * F.col("pct") / 100), F.col("total") - 1)
    return wanted.where((F.col("upto") > place) & (F.col("upto") - F.col("n") <= place)).select(*by, "pct", F.col(value).alias("value"))


def best_per_metric(scores: DataFrame, higher_is_better: Column) -> DataFrame:
    """Systems that are best in a metric, ties within 1e-6 included; ``scores`` is (system, metric, value)."""
    signed = scores.withColumn("signed", F.when(higher_is_better, F.col("value")).otherwise(-F.col("value")))
    top = F.max("signed").over(Window.partitionBy("metric"))
    return signed.withColumn("is_best", F.col("signed") >= top - 1e-6).select("system", "metric", "value", "is_best")


def first_places(marked: DataFrame) -> DataFrame:
    """(system, n_best): in how many metrics a system is best, from ``best_per_metric``."""
    return marked.groupBy("system").agg(F.count_if("is_best").alias("n_best"))


def win_rates(scored: DataFrame, system: str, item: str, value: str, items: DataFrame | None = None) -> DataFrame:
    """(a, b, win_rate, n): 1, 0.5 or 0 for each item that both have, over all ``items`` (or those both have); 0.5 against itself."""
    x = scored.select(F.col(system).alias("a"), F.col(item).alias("item"), F.col(value).alias("va"))
    y = scored.select(F.col(system).alias("b"), F.col(item).alias("item"), F.col(value).alias("vb"))
    points = F.when(F.col("va") > F.col("vb"), 1.0).when(F.col("va") == F.col("vb"), 0.5).otherwise(0.0)
    sums = x.join(y, "item").groupBy("a", "b").agg(F.sum(points).alias("points"), F.count("*").alias("n"))
    total = F.col("n") if items is None else F.greatest(F.lit(items.count()), F.lit(1))
    return sums.select("a", "b", F.when(F.col("a") == F.col("b"), 0.5).otherwise(F.col("points") / total).alias("win_rate"), "n")


def breakdown(df: DataFrame, dims: list[str], **measures: Column) -> DataFrame:
    """One row per value of each dimension and one for all: (dim, dim_value, n, measures), from one pass."""
    aggs = [F.count("*").alias("n"), *[m.alias(k) for k, m in measures.items()]]
    sets = df.groupingSets([[F.col(d)] for d in dims] + [[]], *[F.col(d) for d in dims])
    out = sets.agg(*aggs, *[F.grouping(d).alias(f"_{d}") for d in dims])
    dim, value = F.lit("all"), F.lit(None).cast("string")
    for d in dims:
        dim, value = F.when(F.col(f"_{d}") == 0, d).otherwise(dim), F.when(F.col(f"_{d}") == 0, F.col(d).cast("string")).otherwise(value)
    return out.select(dim.alias("dim"), value.alias("dim_value"), "n", *measures)


def consistency(scored: DataFrame, source: str, language: str, value: str, order: str | None = None) -> DataFrame:
    """(lang_a, lang_b, consistency, n): 1 - |difference| of a source's scores in two languages.

    Of several items of a source in a language the last by ``order`` counts, or their mean without one.
    """
    one = F.max_by(value, order) if order else F.avg(value)
    per = scored.groupBy(source, language).agg(one.alias("v"))
    x = per.select(F.col(source).alias("s"), F.col(language).alias("lang_a"), F.col("v").alias("va"))
    y = per.select(F.col(source).alias("s"), F.col(language).alias("lang_b"), F.col("v").alias("vb"))
    pairs = x.join(y, "s").where("lang_a < lang_b")
    return pairs.groupBy("lang_a", "lang_b").agg(F.avg(1 - F.abs(F.col("va") - F.col("vb"))).alias("consistency"), F.count("*").alias("n"))


# ---- tiers over results joined with their gold items
#
# results: system, item_id, answer, contexts, latency_sec, is_outscope, agent_steps, n_tool_calls, cfi, claim_ratio, entity_ratio, is_grounded
# gold: item_id, category, language, source, gold_answer, gold_keywords, is_multihop
# Means are over the items to which a measure applies, and null without any.


def with_gold(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Results beside their gold items by id; results without one are left out."""
    return results.join(gold, "item_id")


def mean_if(value: Column, applies: Column) -> Column:
    return F.avg(F.when(applies, value.cast("double")))


def retrieval_quality(df: DataFrame, by: list[str]) -> DataFrame:
    """Coverage, redundancy, reciprocal rank and utilisation of answers with contexts."""
    ctx, kw = F.col("contexts"), F.col("gold_keywords")
    some, keyed = F.size(ctx) > 0, F.size(kw) > 0
    return df.groupBy(*by).agg(
        mean_if(m.keyword_hits(F.array_join(ctx, " "), kw), some & keyed).alias("context_coverage"),
        mean_if(m.context_redundancy(ctx), F.size(ctx) >= 2).alias("context_redundancy"),
        mean_if(m.reciprocal_rank(ctx, kw), some & keyed).alias("mean_reciprocal_rank"),
        mean_if(m.utilisation(F.col("answer"), ctx), some & (F.col("answer") != "")).alias("context_utilization"),
    )


def robustness(df: DataFrame, by: list[str]) -> DataFrame:
    """F1 under many contexts, rejection of questions out of scope, F1 over several hops, legal keywords."""
    f1 = m.token_f1(F.col("answer"), F.col("gold_answer"), strip=False)
    category = F.col("category")
    return df.groupBy(*by).agg(
        mean_if(f1, F.size("contexts") >= 3).alias("noise_robustness"),
        mean_if(F.col("is_outscope") | has_abstain_marker(F.col("answer")), category == "OUTSCOPE").alias("negative_rejection_rate"),
        mean_if(f1, category == "MULTIHOP").alias("information_integration"),
        mean_if(m.any_keyword(F.col("answer"), F.col("gold_keywords")), (category == "LEGAL") & (F.size("gold_keywords") > 0)).alias("counterfactual_robustness"),
    )


def domain_precision(df: DataFrame, by: list[str]) -> DataFrame:
    """Legal and numeric keywords, answers in the dialect of the question, keywords over hops, numbers of no context."""
    said, kw, category = strip_citations(F.col("answer")), F.col("gold_keywords"), F.col("category")
    numeric = F.filter(kw, lambda k: k.rlike(r"\p{Nd}"))
    return df.groupBy(*by).agg(
        mean_if(m.any_keyword(said, kw), (category == "LEGAL") & (F.size(kw) > 0)).alias("legal_citation_hit"),
        mean_if(m.any_keyword(said, numeric), F.size(numeric) > 0).alias("cost_deadline_hit"),
        mean_if(m.dialect_match(said, F.col("language")), F.col("language").isin("Darija", "Arabizi")).alias("dialect_response_match"),
        mean_if(m.keyword_hits(said, kw), (category == "MULTIHOP") & (F.size(kw) > 0)).alias("multihop_keyword_hit"),
        mean_if(m.invented_numbers(F.col("answer"), F.array_join("contexts", " ")), (F.size(m.numbers(said)) > 0) & (F.size("contexts") > 0)).alias("hallucination_number_rate"),
    )


def multihop_success(df: DataFrame, by: list[str], min_steps: int = 2, threshold: float = 0.5) -> DataFrame:
    """Routing, coverage, both, and mean steps of questions over several hops."""
    steps = F.when(F.coalesce("agent_steps", F.lit(0)) > 0, F.col("agent_steps")).otherwise(F.coalesce("n_tool_calls", F.lit(0)))
    said = F.lower(F.regexp_replace("answer", r"(?i)\[Source:[^\]]*\]", ""))
    keywords = F.filter("gold_keywords", lambda k: k != "")
    share = F.when(F.size(keywords) > 0, F.size(F.filter(keywords, lambda k: said.contains(F.lower(k)))) / F.size(keywords)).otherwise((n_words(said) > 20).cast("double"))
    rows = df.where((F.col("category") == "MULTIHOP") | F.col("is_multihop")).select(*by, steps.alias("steps"), (steps >= min_steps).alias("routed"), (share >= threshold).alias("covered"))
    rate = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*by).agg(
        rate(F.col("routed")).alias("routing_rate"), rate(F.col("covered")).alias("coverage_rate"), rate(F.col("routed") & F.col("covered")).alias("success_rate"),
        F.avg("steps").alias("avg_steps"), F.count("*").alias("items_n"),
    )


def grounding_means(df: DataFrame, by: list[str]) -> DataFrame:
    """Means of what audits hold; missing values don't count."""
    return df.groupBy(*by).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in ("cfi", "claim_ratio", "is_grounded", "entity_ratio")])


def efficiency(df: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean, least and largest latency, share of abstentions and errors, mean contexts; percentiles are ``nearest_rank``'s."""
    return df.groupBy(*by).agg(
        F.count("*").alias("count"), F.avg("latency_sec").alias("avg_latency_sec"), F.min("latency_sec").alias("min_latency_sec"), F.max("latency_sec").alias("max_latency_sec"),
        F.avg((F.col("is_outscope") | F.col("answer").contains("ERROR")).cast("double")).alias("abstain_rate"), F.avg(F.size("contexts")).alias("avg_contexts"),
    )


def lexical_means(df: DataFrame, by: list[str]) -> DataFrame:
    """Exact match, token F1 and keyword hits over all items (with keywords)."""
    said, gold = F.col("answer"), F.col("gold_answer")
    return df.groupBy(*by).agg(
        F.avg(m.exact_match(said, gold)).alias("exact_match"), F.avg(m.token_f1(said, gold)).alias("token_f1"),
        mean_if(m.keyword_hits(said, F.col("gold_keywords")), F.size("gold_keywords") > 0).alias("keyword_hit_rate"),
    )


def judge_means(scores: DataFrame, by: list[str]) -> DataFrame:
    """Means of a judge's columns: 1 to 5 as (s - 1) / 4, shares of supported facts, and replies read as numbers of 0 to 1."""
    reply = F.try_to_number(F.nullif(F.regexp_extract("reply", r"0?\.\d+|[01]", 0), F.lit("")), F.lit("9.999999")).cast("double")
    return scores.groupBy(*by).agg(
        F.avg((F.col("rating") - 1) / 4).alias("g_eval"), F.avg(F.try_divide(F.col("supported"), F.nullif(F.col("facts"), F.lit(0)))).alias("fact_score"), F.avg(reply).alias("judge"),
    )


def class_accuracy(df: DataFrame, expected: str, predicted: str, by: str) -> DataFrame:
    """(by, n, correct, accuracy, verdict): GO from 80 %, MARGINAL from 70 %, else NO-GO."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(expected) == F.col(predicted)).alias("correct"))
    accuracy = F.col("correct") / F.col("n")
    return counts.select(by, "n", "correct", accuracy.alias("accuracy"), F.when(accuracy >= 0.8, "GO").when(accuracy >= 0.7, "MARGINAL").otherwise("NO-GO").alias("verdict"))


def context_scores(asked: DataFrame, scored: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, pos, context, score): a context's score where it is among the query's first ``k`` scored ones, else 0."""
    first = scored.where(F.col("rank") <= k).groupBy("query_id", F.col("text").alias("context")).agg(F.min_by("score", "rank").alias("score"))
    each = asked.select("query_id", F.posexplode("contexts").alias("pos", "context"))
    return each.join(first, ["query_id", "context"], "left").select("query_id", "pos", "context", F.coalesce("score", F.lit(0.0)).alias("score"))


def token_matching(pairs: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., precision, recall, f1): each token of one text matched to the most similar one of the other, both ways.

    ``pairs``: keys, said array<int>, meant array<int> (places of tokens in a table of vectors); ``vectors``: place, vector.
    Tokens meet their vectors by a join, whatever the size of the table; what comes together is one pair's distinct tokens.
    A pair without tokens on one side, or with none in the table, scores 0.
    """
    told = lambda c, side: pairs.select(*keys, F.lit(side).alias("side"), F.explode(c).alias("place"))
    counts = told("said", 0).unionByName(told("meant", 1)).groupBy(*keys, "side", "place").agg(F.count("*").alias("n"))
    held = counts.join(vectors.select("place", F.col("vector").cast("array<double>").alias("vector")), "place")
    rows = held.groupBy(*keys).agg(F.collect_list(F.struct("side", "n", "vector")).alias("tokens"))

    def run(batches):
        for batch in batches:
            scores = []
            for tokens in batch.column(len(keys)):
                t = tokens.values
                side, n = t.field("side").to_numpy(), t.field("n").to_numpy().astype(float)
                x = t.field("vector").flatten().to_numpy().reshape(len(side), -1)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                a, b = side == 0, side == 1
                if not a.any() or not b.any():
                    scores.append((0.0, 0.0, 0.0))
                    continue
                best = x[a] @ x[b].T
                p, r = (best.max(axis=1) @ n[a]) / n[a].sum(), (best.max(axis=0) @ n[b]) / n[b].sum()
                scores.append((p, r, 2 * p * r / (p + r) if p + r else 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c) for c in zip(*scores, strict=True))], [*keys, "precision", "recall", "f1"])

    schema = ", ".join([f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys] + ["precision double", "recall double", "f1 double"])
    scored = rows.mapInArrow(run, schema)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return pairs.select(*keys).join(scored, keys, "left").select(*keys, *[zero(c) for c in ("precision", "recall", "f1")])
