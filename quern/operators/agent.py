"""Tools, bounded memory, plans and strategies, as stages over all questions at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import add_workdays, article_number, contains_any, law_name, n_words


def tool_for(intent: Column) -> Column:
    tools = F.create_map(*[F.lit(x) for kv in lx.INTENT_TOOLS.items() for x in kv])
    return F.coalesce(F.try_element_at(tools, intent), F.lit("retrieve_kb"))


def boosted(score: Column, hit: Column, factor: float) -> Column:
    return F.when(hit, F.least(score * factor, F.lit(1.0))).otherwise(score)


def eligibility_boost(text: Column, score: Column) -> Column:
    return boosted(score, contains_any(text, lx.ELIGIBILITY_WORDS), 1.3)


def amounts(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?i)([0-9][0-9\s]*)\s*(?:درهم|DH|MAD|dirhams?)"), F.lit(1))
    return F.transform(found, lambda m: F.regexp_replace(m, r"\s", "").try_cast("bigint"))


def amount_boost(text: Column, score: Column, low: int = 0, high: int = 100_000) -> Column:
    return boosted(score, F.exists(amounts(text), lambda a: F.coalesce(a.between(low, high), F.lit(False))), 1.4)


def stated_days(text: Column) -> Column:
    return F.regexp_extract(text, r"([0-9]+)\s+(?:يوم|jour)", 1).try_cast("int")


def deadline(as_of: Column, days: Column) -> Column:
    return add_workdays(as_of, days)


KEY_LENGTH = 8  # of article numbers; law names are found under three letters


def article_keys(chunks: DataFrame, id_col: str) -> DataFrame:
    """(kind, key, id): what a chunk's article and law can be found under, so that lookup is an equi-join.

    An article number has a key for each of its substrings up to ``KEY_LENGTH``, a law name for those up to three letters.
    """
    def parts(text: Column, most: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text))
        return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.substring(text, i, n)))))

    number, law = F.coalesce("article_number", F.lit("")), F.lower(F.coalesce("law_name", F.lit("")))
    of = lambda kind, text, most: chunks.where(text != "").select(F.lit(kind).alias("kind"), F.explode(parts(text, most)).alias("key"), F.col(id_col))
    return of("article", number, KEY_LENGTH).unionByName(of("law", law, 3))


def lookup_article(chunks: DataFrame, keys: DataFrame, asked: DataFrame, *, id_col: str, query_col: str, k: int = lx.RETRIEVE_K) -> DataFrame:
    """First k chunks, in order, whose article or law contains what is asked; ``asked`` has article and law, either may be empty.

    A question asks under one key for its article and one for its law (of its three-letter parts the one fewest chunks have);
    what is found there is verified.  Scores are fixed.
    """
    article, law = F.coalesce("article", F.lit("")), F.lower(F.coalesce("law", F.lit("")))
    asked = asked.select(query_col, article.alias("article"), law.alias("law"))
    by_article = asked.where("article <> ''").select(query_col, F.lit("article").alias("kind"), F.substring("article", 1, KEY_LENGTH).alias("key"))
    grams = F.when(F.length("law") < 3, F.array("law")).otherwise(F.transform(F.sequence(F.lit(1), F.length("law") - 2), lambda i: F.substring("law", i, F.lit(3))))
    grams = asked.where("law <> ''").select(query_col, F.explode(grams).alias("key"))
    often = keys.where("kind = 'law'").join(grams.select("key").distinct(), "key", "left_semi").groupBy("key").count()
    by_law = grams.join(often, "key", "left").groupBy(query_col).agg(F.min_by("key", F.struct(F.coalesce("count", F.lit(0)), F.col("key"))).alias("key"))
    wanted = by_article.unionByName(by_law.select(query_col, F.lit("law").alias("kind"), "key"))
    met = keys.join(wanted, ["kind", "key"]).select(query_col, id_col).distinct()
    hits = met.join(asked, query_col).join(chunks, id_col)
    art = (F.col("article") != "") & F.contains(F.coalesce("article_number", F.lit("")), "article")
    named = (F.col("law") != "") & F.contains(F.lower(F.coalesce("law_name", F.lit(""))), "law")
    order = F.row_number().over(Window.partitionBy(query_col).orderBy(id_col))
    hits = hits.where(art | named).withColumn("rank", order).where(F.col("rank") <= k).drop("article", "law")
    return hits.withColumn("rrf", F.lit(0.9)).withColumn("bm25", F.lit(1.0)).withColumn("dense", F.lit(0.9))


HIT = ["query_id", "chunk_id", "source", "text", "score", "rrf", "rank"]


class Tools:
    """Runs every tool once over all rows that ask for it.

    ``retrieve`` maps (query_id, text) to ``HIT``; ``chunks`` has chunk_id, text, source, article_number and law_name, and
    ``keys`` is ``article_keys`` of it. Deadlines count from ``as_of``.
    """

    def __init__(self, retrieve: Callable[[DataFrame], DataFrame], chunks: DataFrame | None = None, keys: DataFrame | None = None, as_of: Column | None = None, k: int = lx.RETRIEVE_K):
        self.retrieve, self.chunks, self.k = retrieve, chunks, k
        self.keys = keys if keys is not None or chunks is None else article_keys(chunks, "chunk_id")
        self.as_of = F.current_date() if as_of is None else as_of

    def known(self, tool: Column) -> Column:
        """Unknown tools retrieve, and so does a lookup without chunks to look in."""
        tools = list(lx.TOOLS) if self.chunks is not None else [t for t in lx.TOOLS if t != "lookup_article"]
        return F.when(tool.isin(tools), tool).otherwise("retrieve_kb")

    def run(self, asked: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``HIT`` and tool of (query_id, text, tool, article, law); a row that finds nothing has no hits.

        One retrieval serves all tools but a lookup that finds its article. A lookup that doesn't asks for its law and article.
        """
        rows = keep(asked.select("query_id", "text", self.known(F.col("tool")).alias("tool"), "article", "law"))
        looking, query = F.col("tool") == "lookup_article", F.col("text")
        found = None
        if self.chunks is not None:
            found = lookup_article(self.chunks, self.keys, rows.where(looking).drop("text"), id_col="chunk_id", query_col="query_id", k=self.k)
            found = keep(found.select("query_id", "chunk_id", "source", "text", F.lit(0.9).alias("score"), "rrf", "rank"))
            rows = rows.join(found.select("query_id").distinct(), "query_id", "left_anti")
            number = F.when(F.coalesce("article", F.lit("")) != "", F.concat(F.lit(lx.ARTICLE_WORD + " "), "article"))
            query = F.when(looking, F.coalesce(F.nullif(F.concat_ws(" ", F.nullif(F.lower("law"), F.lit("")), number), F.lit("")), "text")).otherwise(F.col("text"))
        hits = keep(self.retrieve(rows.select("query_id", query.alias("text")).where("text <> ''")).select(*HIT))
        hits = hits.join(rows.select("query_id", "tool"), "query_id")
        boost = F.when(F.col("tool") == "check_eligibility", eligibility_boost(F.col("text"), F.col("rrf"))).when(F.col("tool") == "search_by_amount", amount_boost(F.col("text"), F.col("rrf"))).otherwise(F.col("rrf"))
        again = F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(F.col("tool").isin("check_eligibility", "search_by_amount"), -F.round("rrf", 12)), "rank"))
        hits = hits.withColumn("rrf", boost).withColumn("rank", again).where(F.col("rank") <= self.k)
        days = F.when((F.col("rank") <= 3) & (F.col("tool") == "calculate_deadline"), F.struct("rank", stated_days(F.col("text")).alias("days")))
        first = F.min(F.when(days["days"].isNotNull(), days)).over(Window.partitionBy("query_id"))["days"]
        due = F.date_format(deadline(self.as_of, F.col("days")), "dd/MM/yyyy")
        told = F.concat(F.lit(lx.DEADLINE_NOTE[0]), F.col("days").cast("string"), F.lit(lx.DEADLINE_NOTE[1]), due, F.lit("] "), F.col("text"))
        hits = hits.withColumn("days", first).withColumn("text", F.when((F.col("rank") == 1) & (F.col("days") > 0), told).otherwise(F.col("text"))).select(*HIT, "tool")
        return hits if found is None else hits.unionByName(found.withColumn("tool", F.lit("lookup_article")))


def remember(rows: list[tuple], limit: int = lx.MEMORY_CHUNKS, per_source: int = lx.MEMORY_PER_SOURCE, least: float = lx.MEMORY_MIN_SCORE) -> list[tuple]:
    """Chunks a memory holds after (chunk_id, source, text, score) came in order; see ``memory``."""
    held: dict[str, list] = {}
    for chunk_id, source, text, score in rows:
        if score < least:
            continue
        same = next((c for c in held.values() if c[2] == text.strip()), None)
        if same is not None:
            same[3] = max(same[3], score)
            continue
        mine = [c for c in held.values() if c[1] == source]
        if len(mine) >= per_source:
            worst = min(mine, key=lambda c: c[3])
            if score <= worst[3]:
                continue
            del held[worst[0]]
        held[chunk_id] = [chunk_id, source, text.strip(), score]
        if len(held) > limit:
            del held[min(held, key=lambda c: held[c][3])]
    return sorted((tuple(c) for c in held.values()), key=lambda c: -c[3])


def memory(hits: DataFrame, *, query_col: str, order: list[str]) -> DataFrame:
    """(query, chunk_id, source, score, place): a bounded memory for each query, fed in order.

    Low scores are refused; a text held already keeps the better score; a full source gives way only to a better chunk;
    over the limit the worst goes.  A query has at most a few steps of k hits, so a group is small.
    """
    query_type = hits.schema[query_col].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        kept = remember(list(pdf[["chunk_id", "source", "text", "score"]].itertuples(index=False, name=None)))
        return pd.DataFrame([(pdf[query_col].iloc[0], c, s, v, i) for i, (c, s, _, v) in enumerate(kept)], columns=[query_col, "chunk_id", "source", "score", "place"])

    return hits.groupBy(query_col).applyInPandas(run, f"{query_col} {query_type}, chunk_id string, source string, score double, place int")


def fallback_plan(flags: DataFrame, query_col: str, max_steps: int = lx.MAX_STEPS) -> DataFrame:
    """(query, step, intent, tool): one step for each intent, at most ``max_steps``; a question without intents asks for documents."""
    intents = F.array_distinct(F.coalesce("intents", F.array().cast("array<string>")))
    steps = F.when(F.size(intents) > 0, intents).otherwise(F.array(F.lit("DOCUMENTS")))
    return flags.select(query_col, F.posexplode(F.slice(steps, 1, max_steps)).alias("step", "intent")).withColumn("tool", tool_for(F.col("intent")))


def cover_intents(plan: DataFrame, flags: DataFrame, query_col: str, max_steps: int = lx.MAX_STEPS) -> DataFrame:
    """A plan made elsewhere, cut to ``max_steps``, with a step for each known intent of a question that none of its steps has."""
    plan = plan.where(F.col("step") < max_steps)
    held = plan.groupBy(query_col).agg(F.collect_set("intent").alias("covered"), (F.max("step") + 1).alias("next"))  # of at most max_steps rows
    rows = flags.join(held, query_col, "left")
    known = F.filter(F.coalesce("intents", F.array().cast("array<string>")), lambda i: i.isin(list(lx.INTENT_TOOLS)))
    missing = F.array_except(known, F.coalesce("covered", F.array().cast("array<string>")))
    added = rows.select(query_col, F.coalesce("next", F.lit(0)).alias("next"), F.posexplode(missing).alias("at", "intent"))
    added = added.withColumn("step", (F.col("next") + F.col("at")).cast("int")).where(F.col("step") < max_steps)
    return plan.select(query_col, "step", "intent", "tool").unionByName(added.select(query_col, "step", "intent", tool_for(F.col("intent")).alias("tool")))


def route(n_chunks: Column, flags: Column) -> Column:
    return (
        F.when(n_chunks == 0, "abstain").when(flags["OUTSCOPE"], "refuse").when(flags["SIMPLE"] & ~flags["LEGAL"], "direct").otherwise("multihop")
    )


def reflect(answer: Column, n_chunks: Column) -> Column:
    words = F.size(F.filter(F.split(F.coalesce(answer, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.when((n_chunks == 0) | (words < 10) | contains_any(F.lower(answer), lx.ABSTAIN_MARKERS), "not_found").otherwise("complete")


def union_contexts(*contexts: Column) -> Column:
    """Contexts in order of first appearance."""
    return F.array_distinct(F.concat(*contexts))


def direct_or_abstain(context: Column, said: Column, abstain: Column, least_words: int = 20) -> Column:
    """A direct answer needs some context."""
    return F.when(n_words(F.coalesce(context, F.lit(""))) < least_words, abstain).otherwise(F.coalesce(F.nullif(F.trim(said), F.lit("")), abstain))


def rephrased(sub_question: Column, language: Column) -> Column:
    return F.concat_ws(" ", sub_question, F.when(language.isin("arabic_msa", "Darija"), lx.MORE_DETAILS_ARABIC).otherwise(lx.MORE_DETAILS))


def run(
    questions: DataFrame, plan: DataFrame, tools: Tools, generate: Callable[[Column, Column], Column], keep: Callable[[DataFrame], DataFrame],
    max_steps: int = lx.MAX_STEPS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plan, execute and reflect over all questions at once: (answers, trace, evidence).

    ``questions``: query_id, text, language; ``plan``: query_id, step, intent, tool. Each step runs the step's tool for every
    question that has it, answers from its first three chunks (400 characters each) and the start of the facts before, and
    looks once more with other words, for three more chunks, where the answer isn't complete. A question's evidence is held
    in a bounded ``memory``; the final answer is made from facts and memory, and is an empty string where both say too little.
    ``keep`` ends lineage after a step.

    answers: query_id, facts array<struct<step, intent, fact>>, answer, n_steps; trace: query_id, step, intent, tool, call,
    n_hits, reflection; evidence: query_id, chunk_id, source, score, place.
    """
    traces, facts, hits, columns = [], [], [], ["query_id", "chunk_id", "source", "text", "score", "rank"]
    phrase = F.try_element_at(F.create_map(*[x for i, p in lx.INTENT_PHRASES.items() for x in (F.lit(i), F.array(F.lit(p[0]), F.lit(p[1])))]), F.col("intent"))
    arabic = F.col("language").isin("arabic_msa", "Darija")
    phrase = F.get(phrase, F.when(arabic, 0).otherwise(1))
    known = questions.select("query_id", F.array().cast("array<struct<intent:string,fact:string>>").alias("prior"))
    for step in range(max_steps):
        now = plan.where(F.col("step") == step).join(questions, "query_id").join(known, "query_id")
        named = {"article": F.coalesce(article_number(F.col("text")), F.lit("")), "law": F.coalesce(law_name(F.col("text")), F.lit(""))}
        asked = keep(now.withColumn("sub_question", F.concat_ws(" ", phrase, F.col("text"))).withColumns(named).withColumn("tool", tools.known(F.col("tool"))))
        found = keep(tools.run(asked.select("query_id", F.col("sub_question").alias("text"), "tool", "article", "law"), keep).select(*columns))
        seen = found.groupBy("query_id").agg(
            F.count("*").alias("n_hits"),
            F.sort_array(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", F.substring("text", 1, 400).alias("text"))))).alias("top"),
        )
        before = F.array_join(F.transform("prior", lambda f: F.concat(F.lit("  - "), f["intent"], F.lit(": "), F.substring(f["fact"], 1, 100), F.lit("…"))), "\n")
        heading = F.when(arabic, lx.PRIOR_STEPS[0]).otherwise(lx.PRIOR_STEPS[1])
        context = F.concat_ws("\n\n", F.when(before != "", F.concat(heading, F.lit("\n"), before)), F.array_join(F.transform("top", lambda c: c["text"]), "\n\n"))
        said = asked.join(seen, "query_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
        said = said.withColumn("fact", F.when(F.col("n_hits") > 0, generate(F.col("sub_question"), context)).otherwise(""))
        said = keep(said.withColumn("reflection", reflect(F.col("fact"), F.col("n_hits"))).drop("top"))
        again = said.where("reflection <> 'complete'").select("query_id", rephrased(F.col("sub_question"), F.col("language")).alias("text"))
        extra = keep(tools.retrieve(again).where(F.col("rank") <= 3).select(*columns))
        n_extra = again.select("query_id").join(extra.groupBy("query_id").agg(F.count("*").alias("n_hits")), "query_id", "left")
        traces.append(said.select("query_id", "step", "intent", "tool", F.lit("plan").alias("call"), "n_hits", "reflection"))
        traces.append(
            said.drop("n_hits").join(n_extra, "query_id").select("query_id", "step", "intent", F.lit("retrieve_kb").alias("tool"), F.lit("retry").alias("call"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "reflection")
        )
        facts.append(said.select("query_id", "step", "intent", "fact"))
        told = said.select("query_id", F.array(F.struct("intent", "fact")).alias("new"))
        known = keep(known.join(told, "query_id", "left").select("query_id", F.concat("prior", F.coalesce("new", F.slice("prior", 1, 0))).alias("prior")))
        hits += [found.withColumn("order", F.lit(2 * step)), extra.withColumn("order", F.lit(2 * step + 1))]
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    trace, every = union(traces), union(hits)
    evidence = keep(memory(every, query_col="query_id", order=["order", "rank"]))
    texts = every.groupBy("query_id", "chunk_id").agg(F.min_by("text", "order").alias("text"))
    held = evidence.join(texts, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("held"))
    told = union(facts).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("step", "intent", "fact"))).alias("facts"), F.count("*").alias("n_steps"))
    rows = questions.join(told, "query_id").join(held, "query_id", "left")
    context = F.array_join(F.transform("held", lambda c: c["text"]), "\n")
    all_facts = F.array_join(F.filter(F.transform("facts", lambda f: f["fact"]), lambda f: f != ""), "\n")
    synthesis = F.coalesce(generate(F.col("text"), F.concat_ws("\n", all_facts, context)), F.lit(""))
    answer = F.when((all_facts != "") & (F.length(synthesis) >= 20), synthesis).otherwise(direct_or_abstain(context, generate(F.col("text"), context), F.lit("")))
    return rows.select("query_id", "facts", answer.alias("answer"), "n_steps"), trace, evidence


def crag_verdict(reply: Column) -> Column:
    """INCORRECT is tested before CORRECT, which it contains."""
    up = F.upper(reply)
    return F.when(up.contains("INCORRECT"), "INCORRECT").when(up.contains("AMBIGUOUS"), "AMBIGUOUS").when(up.contains("CORRECT"), "CORRECT").otherwise("AMBIGUOUS")


def is_yes(reply: Column) -> Column:
    return contains_any(F.lower(reply), ["yes", "oui", "نعم"])
