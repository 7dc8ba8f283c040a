"""Queries over evaluation tables made from the given ones (``derived``): tiers of evaluation, grounding in several languages, gold sets, agent and strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grounding as g
from ..functions import language as la
from ..functions import lexicon as lx
from ..functions import metrics as m
from ..functions import text as t
from ..functions.scorers import extractive_answer
from ..operators import agent, curate, evaluate, gold, index, runs, sketches, strategies, verify
from ..session import Scratch
from ..streaming import events
from . import derived
from . import fixtures as fx
from .catalogue import BM25, query, r6, sql_norm, sql_strings, sql_strip, table

_RES, _GOLD = derived.RESULTS, derived.GOLD
_J = f"j AS (SELECT * FROM {_RES} r JOIN {_GOLD} g USING (item_id))"


def _joined(spark, sf):
    return evaluate.with_gold(derived.results(spark, sf), derived.gold(spark, sf))


def _rounded(df, keys=("system",)):
    return df.select(*[c if c in keys or kind in ("bigint", "int", "string", "boolean") else r6(c).alias(c) for c, kind in df.dtypes])


def _avg(value, applies="TRUE"):
    return f"round(avg(CASE WHEN {applies} THEN CAST({value} AS DOUBLE) END), 6)"


def _toks(c):
    return f"list_distinct(list_filter(string_split({sql_norm(c)}, ' '), lambda x: x <> ''))"


def _f1(a, b):
    x, y = _toks(a), _toks(b)
    return f"coalesce(2.0 * len(list_intersect({x}, {y})) / nullif(len({x}) + len({y}), 0), 0)"


def _hits(c, kw="gold_keywords"):
    return f"len(list_filter({kw}, lambda k: contains({c}, {sql_norm('k')}))) / nullif(len({kw}), 0)"


_CTX = "array_to_string(contexts, ' ')"
_SAID = sql_norm(sql_strip("answer"))
_NUMERIC = "list_filter(gold_keywords, lambda k: regexp_matches(k, '[0-9]'))"
_ARABIC_N = r"len(regexp_extract_all({}, '[\x{{0600}}-\x{{06FF}}]'))"
_NUMBERS = r"list_distinct(regexp_extract_all({}, '\b[0-9][0-9,.]*\b'))"
_ABSTAINS = f"list_bool_or(list_transform({sql_strings(lx.ABSTAIN_MARKERS)}, lambda k: contains(lower(answer), k)))"


@query(
    f"""WITH {_J}, p AS (SELECT *, {sql_norm(_CTX)} AS c, list_transform(contexts, lambda x: {_toks('x')}) AS sets,
      list_position(list_transform(contexts, lambda x: len(list_filter(gold_keywords, lambda k: contains({sql_norm('x')}, {sql_norm('k')}))) > 0), TRUE) AS place FROM j)
    SELECT system, {_avg(_hits('c'), 'len(contexts) > 0 AND len(gold_keywords) > 0')} AS context_coverage,
      {_avg('list_avg(list_transform(range(1, len(sets)), lambda i: len(list_intersect(sets[i], sets[i + 1])) / len(list_distinct(list_concat(sets[i], sets[i + 1])))))', 'len(contexts) >= 2')} AS context_redundancy,
      {_avg('coalesce(1.0 / nullif(place, 0), 0)', 'len(contexts) > 0 AND len(gold_keywords) > 0')} AS mean_reciprocal_rank,
      {_avg(f"len(list_intersect({_toks('answer')}, {_toks(_CTX)})) / nullif(len({_toks(_CTX)}), 0)", "len(contexts) > 0 AND answer <> ''")} AS context_utilization
    FROM p GROUP BY system"""
)
def retrieval_quality(spark, sf):
    return _rounded(evaluate.retrieval_quality(_joined(spark, sf), ["system"]))


@query(
    f"""WITH {_J} SELECT system, {_avg(_f1('answer', 'gold_answer'), 'len(contexts) >= 3')} AS noise_robustness,
      {_avg(f'is_outscope OR {_ABSTAINS}', "category = 'OUTSCOPE'")} AS negative_rejection_rate, {_avg(_f1('answer', 'gold_answer'), "category = 'MULTIHOP'")} AS information_integration,
      {_avg(f"{_hits(sql_norm('answer'))} > 0", "category = 'LEGAL' AND len(gold_keywords) > 0")} AS counterfactual_robustness FROM j GROUP BY system"""
)
def robustness(spark, sf):
    return _rounded(evaluate.robustness(_joined(spark, sf), ["system"]))


@query(
    f"""WITH {_J}, p AS (SELECT *, {_SAID} AS said, {_NUMBERS.format(sql_strip('answer'))} AS mine, {_NUMBERS.format(_CTX)} AS theirs FROM j)
    SELECT system, {_avg(_hits('said') + ' > 0', "category = 'LEGAL' AND len(gold_keywords) > 0")} AS legal_citation_hit, {_avg(_hits('said', _NUMERIC) + ' > 0', f'len({_NUMERIC}) > 0')} AS cost_deadline_hit,
      {_avg(f"{_ARABIC_N.format('answer')} >= 10 OR (language = 'Arabizi' AND regexp_matches(answer, '[a-zA-Z][2379]|[2379][a-zA-Z]'))", "language IN ('Darija', 'Arabizi')")} AS dialect_response_match,
      {_avg(_hits('said'), "category = 'MULTIHOP' AND len(gold_keywords) > 0")} AS multihop_keyword_hit,
      {_avg('len(list_filter(mine, lambda n: NOT list_contains(theirs, n))) / nullif(len(mine), 0)', 'len(mine) > 0 AND len(contexts) > 0')} AS hallucination_number_rate
    FROM p GROUP BY system"""
)
def domain_precision(spark, sf):
    return _rounded(evaluate.domain_precision(_joined(spark, sf), ["system"]))


@query(
    rf"""WITH {_J}, p AS (SELECT *, CASE WHEN coalesce(agent_steps, 0) > 0 THEN agent_steps ELSE coalesce(n_tool_calls, 0) END AS steps,
      lower(regexp_replace(answer, '(?i)\[Source:[^\]]*\]', '', 'g')) AS said FROM j WHERE category = 'MULTIHOP' OR is_multihop),
    c AS (SELECT *, steps >= 2 AS routed, CASE WHEN len(gold_keywords) > 0 THEN len(list_filter(gold_keywords, lambda k: contains(said, lower(k)))) / len(gold_keywords)
      ELSE CAST(len(list_filter(string_split_regex(said, '\s+'), lambda w: w <> '')) > 20 AS INTEGER) END >= 0.5 AS covered FROM p)
    SELECT system, {_avg('routed')} AS routing_rate, {_avg('covered')} AS coverage_rate, {_avg('routed AND covered')} AS success_rate, {_avg('steps')} AS avg_steps, count(*) AS items_n FROM c GROUP BY system"""
)
def multihop_success(spark, sf):
    return _rounded(evaluate.multihop_success(_joined(spark, sf), ["system"]))


@query(
    f"WITH {_J} SELECT system, {_avg('cfi')} AS cfi, {_avg('claim_ratio')} AS claim_ratio, {_avg('is_grounded', 'is_grounded IS NOT NULL')} AS is_grounded, {_avg('entity_ratio')} AS entity_ratio FROM j GROUP BY system"
)
def grounding_means(spark, sf):
    return _rounded(evaluate.grounding_means(_joined(spark, sf), ["system"]))


@query(
    f"""WITH {_J} SELECT system, count(*) AS count, {_avg('latency_sec')} AS avg_latency_sec, min(latency_sec) AS min_latency_sec, max(latency_sec) AS max_latency_sec,
      {_avg("is_outscope OR contains(answer, 'ERROR')")} AS abstain_rate, {_avg('len(contexts)')} AS avg_contexts FROM j GROUP BY system"""
)
def efficiency(spark, sf):
    return _rounded(evaluate.efficiency(_joined(spark, sf), ["system"]))


@query(
    f"""WITH {_J} SELECT system, {_avg(f"{_SAID} = {sql_norm('gold_answer')}")} AS exact_match, {_avg(_f1(sql_strip('answer'), 'gold_answer'))} AS token_f1,
      {_avg(_hits(sql_norm('answer')), 'len(gold_keywords) > 0')} AS keyword_hit_rate FROM j GROUP BY system"""
)
def lexical_means(spark, sf):
    return _rounded(evaluate.lexical_means(_joined(spark, sf), ["system"]))


@query(
    f"""WITH {_J}, s AS (SELECT system, item_id, {_f1(sql_strip('answer'), 'gold_answer')} AS v FROM j), n AS (SELECT count(*) AS n FROM {_GOLD})
    SELECT x.system AS a, y.system AS b, CASE WHEN x.system = y.system THEN 0.5 ELSE round(sum(CASE WHEN x.v > y.v THEN 1.0 WHEN x.v = y.v THEN 0.5 ELSE 0.0 END) / (SELECT n FROM n), 6) END AS win_rate,
      count(*) AS n FROM s x JOIN s y USING (item_id) GROUP BY 1, 2"""
)
def win_rate_over_gold(spark, sf):
    """Pairs of systems over all gold items, whether or not both answered them."""
    f1 = m.token_f1(F.col("answer"), F.col("gold_answer"))
    scored = _joined(spark, sf).select("system", "item_id", f1.alias("v"))
    return evaluate.win_rates(scored, "system", "item_id", "v", derived.gold(spark, sf)).withColumn("win_rate", r6("win_rate"))


@query(
    f"""WITH {_J}, s AS (SELECT source, language, arg_max({_f1(sql_strip('answer'), 'gold_answer')}, item_id) AS v FROM j WHERE system = 'agentic' AND source <> '' GROUP BY ALL)
    SELECT x.language AS lang_a, y.language AS lang_b, round(avg(1 - abs(x.v - y.v)), 6) AS consistency, count(*) AS n FROM s x JOIN s y ON x.source = y.source AND x.language < y.language GROUP BY 1, 2"""
)
def cross_lingual_last_item(spark, sf):
    """Of several items of a source in a language the last one counts."""
    rows = _joined(spark, sf).where("system = 'agentic' and source <> ''").withColumn("v", m.token_f1(F.col("answer"), F.col("gold_answer")))
    return evaluate.consistency(rows, "source", "language", "v", "item_id").withColumn("consistency", r6("consistency"))


@query(
    f"""WITH {_J}, s AS (SELECT system, unnest(['latency', 'f1']) AS metric, unnest([avg(latency_sec), avg({_f1(sql_strip('answer'), 'gold_answer')})]) AS value FROM j GROUP BY system),
    t AS (SELECT *, CASE WHEN metric = 'latency' THEN -value ELSE value END AS v FROM s), b AS (SELECT *, v >= max(v) OVER (PARTITION BY metric) - 1e-6 AS best FROM t)
    SELECT system, count(*) FILTER (best) AS n_best FROM b GROUP BY system"""
)
def first_places(spark, sf):
    f1 = m.token_f1(F.col("answer"), F.col("gold_answer"))
    means = _joined(spark, sf).groupBy("system").agg(F.avg("latency_sec").alias("latency"), F.avg(f1).alias("f1")).unpivot(["system"], ["latency", "f1"], "metric", "value")
    return evaluate.first_places(evaluate.best_per_metric(means, F.col("metric") != "latency"))


@query(
    rf"""SELECT system, round(avg((rating - 1) / 4.0), 6) AS g_eval, round(avg(supported / nullif(facts, 0)), 6) AS fact_score,
      round(avg(TRY_CAST(nullif(regexp_extract(reply, '0?\.[0-9]+|[01]'), '') AS DOUBLE)), 6) AS judge FROM {derived.JUDGED} GROUP BY system"""
)
def judge_means(spark, sf):
    return _rounded(evaluate.judge_means(derived.judged(spark, sf), ["system"]))


@query(
    """WITH p AS (SELECT lang, source, CASE WHEN text LIKE '%the %' THEN 'en' ELSE 'other' END AS said, CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS want FROM documents),
    c AS (SELECT source, count(*) AS n, count(*) FILTER (said = want) AS correct FROM p WHERE source IS NOT NULL AND lang IS NOT NULL AND said IS NOT NULL GROUP BY source)
    SELECT source, n, correct, round(correct / n, 6) AS accuracy, CASE WHEN correct / n >= 0.8 THEN 'GO' WHEN correct / n >= 0.7 THEN 'MARGINAL' ELSE 'NO-GO' END AS verdict FROM c"""
)
def class_accuracy(spark, sf):
    """A one-word rule for English judged by source."""
    rows = table(spark, sf, "documents").where("source is not null and lang is not null").select(
        "source", F.when(F.col("text").contains("the "), "en").otherwise("other").alias("said"), F.when(F.col("lang") == "en", "en").otherwise("other").alias("want")
    )
    return _rounded(evaluate.class_accuracy(rows, "want", "said", "source"), ("source",))


@query(
    f"""WITH r AS MATERIALIZED (SELECT * FROM {_RES}), a AS (SELECT item_id AS query_id, CAST(unnest(range(len(contexts))) AS INTEGER) AS pos, unnest(contexts) AS context FROM r WHERE system = 'agentic'),
    n AS (SELECT item_id AS query_id, unnest(range(len(contexts))) + 1 AS rank, unnest(contexts) AS context FROM r WHERE system = 'naive'),
    s AS (SELECT query_id, context, arg_min(1.0 / rank, rank) AS score FROM n WHERE rank <= 2 GROUP BY ALL)
    SELECT query_id, pos, context, round(coalesce(score, 0), 6) AS score FROM a LEFT JOIN s USING (query_id, context)"""
)
def context_scores(spark, sf):
    """Contexts of one system scored by their rank among the first two of the other."""
    r = derived.results(spark, sf)
    asked = r.where("system = 'agentic'").select(F.col("item_id").alias("query_id"), "contexts")
    scored = r.where("system = 'naive'").select(F.col("item_id").alias("query_id"), F.posexplode("contexts").alias("rank", "text"))
    scored = scored.withColumn("rank", F.col("rank") + 1).withColumn("score", 1.0 / F.col("rank"))
    return evaluate.context_scores(asked, scored, 2).withColumn("score", r6("score"))


# ---- grounding in several languages

_TEXTS = derived.TEXTS
_LAT, _ARA = lx._LATIN_UNITS, lx._ARABIC_UNITS
_SQL_ENTITIES = [
    ("DATE", r"\b20[0-9]{2}\b"),
    ("DATE", r"\b[0-9]{1,2}[/-][0-9]{1,2}[/-]20[0-9]{2}\b"),
    ("DATE", "[٠-٩]{4}"),
    ("AMOUNT", r"(?i)\b[0-9]+(?:[,.][0-9]+)?\s*(?:(?:MAD|DH|dirhams?)\b|درهم)"),
    ("DURATION", rf"(?i)((?:\b[0-9]+|[٠-٩]+)\s*{_LAT})(?:[^\p{{L}}\p{{N}}_]|$)"),  # \b knows ASCII letters only
    ("DURATION", rf"\p{{Nd}}+\s*{_ARA}"),
    ("DURATION", rf"[٠-٩]+\s*{_ARA}"),
    ("LEGAL_REF", r"(?:مرسوم|قانون|قرار|ظهير|منشور|دورية)\s*(?:ملكي\s*)?(?:شريف\s*)?(?:رقم\s*)?[0-9٠-٩][0-9٠-٩./\-]*"),
    ("LEGAL_REF", r"(?i)(?:décret|loi|arrêté|dahir|circulaire)\s*(?:royal\s*)?n\s*[°ºo]?\s*[0-9][0-9./\-]*"),
]


@query(
    " UNION ALL ".join(f"SELECT id, '{kind}' AS type, trim(unnest(regexp_extract_all(text, '{pattern}', {int(pattern.endswith('|$)'))}))) AS entity FROM {_TEXTS}" for kind, pattern in _SQL_ENTITIES)
    + f" UNION ALL SELECT id, 'LOCATION', city FROM {_TEXTS}, (SELECT unnest({sql_strings(lx.CITIES)}) AS city) WHERE contains(text, city)"
)
def entities_of_all_scripts(spark, sf):
    """Upper-case French, amounts and dates in Arabic and Arabic-Indic digits."""
    found = derived.texts(spark, sf).select("id", F.explode(g.entities(F.col("text"))).alias("e"))
    return found.select("id", "e.type", "e.entity")


@query(
    rf"""SELECT id, coalesce(nullif(regexp_extract(text, '(?:المادة|الفصل|الباب|القسم)\s+(\p{{Nd}}+(?:\s*مكرر)?)', 1), ''), regexp_extract(text, '(?i)(?:Article|ART)\.?\s*(\p{{Nd}}+(?:\s*bis)?)', 1)) AS article_number,
    coalesce(nullif(regexp_extract(text, '(?:قانون|ظهير|مرسوم)\s+(?:رقم|شريف)?\s*[\p{{Nd}}.\-]+'), ''), regexp_extract(text, '(?i)(?:loi|décret|arrêté)\s+n[°.]?\s*[\p{{Nd}}\-]+')) AS law_name FROM {_TEXTS}"""
)
def article_metadata(spark, sf):
    return derived.texts(spark, sf).select("id", t.article_number(F.col("text")).alias("article_number"), t.law_name(F.col("text")).alias("law_name"))


def _sql_words(c):
    return rf"list_distinct(list_filter(string_split_regex(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s\x{{0600}}-\x{{06FF}}]', '', 'g'), '\s+'), lambda w: w <> ''))"


@query(
    f"""WITH w AS (SELECT conv_id, turn, chunks, list_filter({_sql_words('claim')}, lambda w: len(w) > 2 AND NOT list_contains({sql_strings(lx.CLAIM_STOPWORDS)}, w)) AS mine FROM {derived.PAIRS})
    SELECT conv_id, turn, round(CASE WHEN len(mine) = 0 THEN 1.0 ELSE coalesce(list_max(list_transform(chunks, lambda c: len(list_intersect(mine, {_sql_words('c')})) / len(mine))), 0.0) END, 6) AS overlap FROM w"""
)
def claims_against_chunks(spark, sf):
    """A claim's best single chunk; dialect stopwords don't count."""
    return derived.pairs(spark, sf).select("conv_id", "turn", r6(g.best_overlap(F.col("claim"), F.col("chunks"))).alias("overlap"))


# ---- gold sets

_RAW = derived.RAW
_CATEGORIES = ["SIMPLE", "MULTIHOP", "MULTIHOP_HARD", "OUTSCOPE", "LEGAL", "DARIJA", "ARABIZI", "EDGE"]
_ITEMS = rf"""items AS (SELECT trim(question) AS question, coalesce(language, 'arabic_msa') AS language, coalesce(gold_answer, '') AS gold_answer, is_multihop AS mh, should_abstain AS sa,
    CASE WHEN language = 'Darija' AND upper(coalesce(category, 'SIMPLE')) <> 'OUTSCOPE' THEN 'DARIJA' WHEN language = 'Arabizi' AND upper(coalesce(category, 'SIMPLE')) <> 'OUTSCOPE' THEN 'ARABIZI'
      ELSE upper(coalesce(category, 'SIMPLE')) END AS category FROM {_RAW} WHERE trim(coalesce(question, '')) <> '')"""


@query(
    rf"""WITH {_ITEMS}, f AS (SELECT question, category, language, gold_answer, coalesce(mh, FALSE) OR category = 'MULTIHOP' AS is_multihop, coalesce(sa, FALSE) OR category = 'OUTSCOPE' AS should_abstain,
      language = 'Arabizi' AND {_ARABIC_N.format('gold_answer')} < len(regexp_extract_all(gold_answer, '[A-Za-z]')) AS review_needed FROM items)
    SELECT *, array_to_string(list_filter({sql_strings(_CATEGORIES)}, lambda c: CASE WHEN c = 'MULTIHOP' THEN is_multihop ELSE category = c END), ',') AS expected_flags FROM f"""
)
def build_items(spark, sf):
    return gold.build_items(derived.raw(spark, sf)).select("question", "category", "language", "gold_answer", "is_multihop", "should_abstain", "review_needed", "expected_flags")


@query(
    f"""WITH o AS (SELECT item_id, CASE category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.CATEGORY_PREFIX.items())} ELSE 'Z' END AS order_prefix,
      coalesce(TRY_CAST(regexp_replace(item_id, '[^0-9]', '', 'g') AS BIGINT), 0) AS order_number FROM {_GOLD}) SELECT * FROM o"""
)
def gold_order(spark, sf):
    return gold.set_order(derived.gold(spark, sf), "item_id").select("item_id", "order_prefix", "order_number")


@query(f"SELECT 'category' AS dim, category AS value, count(*) AS n FROM {_GOLD} GROUP BY 2 UNION ALL SELECT 'language', language, count(*) FROM {_GOLD} GROUP BY 2")
def gold_summary(spark, sf):
    return gold.summary(derived.gold(spark, sf))


@query(
    f"""WITH {_ITEMS}, n AS (SELECT question, language, CASE WHEN language = 'Arabizi' THEN row_number() OVER (PARTITION BY language ORDER BY question) - 1 END AS n FROM items)
    SELECT coalesce(b.text, n.question) AS question, language FROM n LEFT JOIN benchmark b ON b.item_id * 3 = n.n"""
)
def replace_nth(spark, sf):
    """Every third dialect question, as far as there are benchmark items, gives way to one."""
    items = gold.build_items(derived.raw(spark, sf)).select("question", "language")
    fixes = table(spark, sf, "benchmark").select((F.col("item_id") * 3).alias("n"), F.col("text").alias("question"))
    return gold.replace_nth(items, fixes, "Arabizi", "question")


@query(
    r"""SELECT 0 AS priority, CAST(item_id AS VARCHAR) AS id, text FROM benchmark WHERE len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) >= 30
    UNION ALL SELECT 1, CAST(page_id AS VARCHAR), url FROM pages UNION ALL SELECT 2, CAST(doc_id AS VARCHAR), text FROM documents WHERE len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) >= 30"""
)
def sections_for_generation(spark, sf):
    """Benchmark passages as procedures, page addresses as pages, documents as administrations."""
    one = lambda name, id_col, text: table(spark, sf, name).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return gold.sections_for_generation(one("benchmark", "item_id", "text"), one("pages", "page_id", "url"), one("documents", "doc_id", "text"))


@query(
    f"""WITH d AS (SELECT procedure_id, string_agg('- ' || name, chr(10) ORDER BY pos) AS listed, count(*) AS n FROM {derived.NAMED} GROUP BY 1)
    SELECT procedure_id, CASE WHEN contains(body, '{lx.DOCUMENTS_HEADING}') OR listed IS NULL THEN body ELSE body || chr(10) || chr(10) || '{lx.DOCUMENTS_HEADING}:' || chr(10) || listed END AS body,
      coalesce(n, 0) AS n_documents, coalesce(a.name, '') AS administration FROM {derived.PROCEDURES.replace('{heading}', lx.DOCUMENTS_HEADING)} p LEFT JOIN d USING (procedure_id) LEFT JOIN {derived.OFFICES} a USING (administration_id)"""
)
def enrich_procedures(spark, sf):
    return gold.enrich(*derived.procedures(spark, sf, lx.DOCUMENTS_HEADING))


# ---- agent and strategies over documents, asked by benchmark items


def _asked(spark, sf):
    return derived.asked(spark, sf), fx.look_up(Scratch(spark, "keyed").keep(derived.keyed(spark, sf)))


def _agent_run(spark, sf):
    asked, retrieve = _asked(spark, sf)
    plan = agent.fallback_plan(asked.select("query_id", "intents"), "query_id")
    return agent.run(asked.select("query_id", "text", "language"), plan, agent.Tools(retrieve), extractive_answer, Scratch(spark, "agent").keep)


_PHRASE = "CASE intent " + " ".join(f"WHEN '{i}' THEN CASE WHEN language IN ('arabic_msa', 'Darija') THEN '{p[0]}' ELSE '{p[1]}' END" for i, p in lx.INTENT_PHRASES.items()) + " END"
_TOOL = "CASE intent " + " ".join(f"WHEN '{i}' THEN '{tool}'" for i, tool in lx.INTENT_TOOLS.items()) + " ELSE 'retrieve_kb' END"


@query(
    rf"""WITH k AS MATERIALIZED (SELECT * FROM {derived.KEYED}), u AS (SELECT query_id, text, language, list_filter(intents, lambda x, i: list_position(intents, x) = i)[1:3] AS steps FROM {derived.ASKED}),
    p AS (SELECT query_id, text, language, CAST(unnest(range(len(steps))) AS INTEGER) AS step, unnest(steps) AS intent FROM u),
    w AS (SELECT query_id, step, intent, {_TOOL} AS tool, list_distinct(string_split_regex(lower(concat_ws(' ', {_PHRASE}, text)), '\s+')) AS words FROM p),
    h AS (SELECT query_id, step, count(*) AS n FROM (SELECT query_id, step, unnest(words) AS key FROM w) JOIN k USING (key) GROUP BY ALL)
    SELECT query_id, step, intent, tool, least(coalesce(n, 0), 10) AS n_hits FROM w LEFT JOIN h USING (query_id, step)"""
)
def agent_tool_calls(spark, sf):
    """The planned tool calls of every question and how many chunks each found."""
    _, trace, _ = _agent_run(spark, sf)
    return trace.where("call = 'plan'").select("query_id", "step", "intent", "tool", "n_hits")


@query()
def agent_answers(spark, sf):
    """Answers after plan, tools, memory and reflection; the loop is checked against plain Python in the tests."""
    answers, _, _ = _agent_run(spark, sf)
    return answers.select("query_id", "n_steps", "answer", F.size(F.filter("facts", lambda f: f["fact"] != "")).alias("n_facts"))


def _words(c):
    return rf"unnest(list_distinct(string_split_regex(lower({c}), '\s+')))"


_STRATEGY = f"""q AS MATERIALIZED (SELECT * FROM {derived.ASKED}), k AS MATERIALIZED (SELECT * FROM {derived.KEYED}),
    w AS (SELECT query_id, 'mine' AS w, {_words('text')} AS key FROM q UNION ALL SELECT query_id, 'made', {_words("coalesce(made_up, '')")} FROM q),
    h AS (SELECT query_id, w, source, body, score, row_number() OVER (PARTITION BY query_id, w ORDER BY score DESC, chunk_id) AS rank FROM w JOIN k USING (key)),
    f AS (SELECT query_id, any_value(made_up) AS made_up, count(DISTINCT source || chr(9) || body) FILTER (w = 'mine' AND rank <= 5) AS mine, count(DISTINCT source || chr(9) || body) FILTER (rank <= 5 AND (w = 'mine' OR coalesce(made_up, '') <> '')) AS either,
      max(score) FILTER (w = 'mine') AS top FROM q LEFT JOIN h USING (query_id) GROUP BY query_id)"""


@query(
    f"""WITH {_STRATEGY} SELECT 'naive' AS strategy, query_id, mine AS n_contexts, 1 AS n_retrievals FROM f
    UNION ALL SELECT 'hyde', query_id, either, CASE WHEN coalesce(made_up, '') = '' THEN 1 ELSE 2 END FROM f
    UNION ALL SELECT 'crag', query_id, mine, CASE WHEN top >= 0.7 THEN 1 ELSE 2 END FROM f"""
)
def strategy_retrievals(spark, sf):
    """Contexts and retrievals of three comparison strategies."""
    asked, retrieve = _asked(spark, sf)
    s = strategies.Strategies(retrieve)
    runs = {"naive": s.naive(asked), "hyde": s.hyde(asked, F.col("made_up")), "crag": s.crag(asked)}
    out = None
    for name, rows in runs.items():
        part = rows.select(F.lit(name).alias("strategy"), "query_id", F.size("contexts").cast("long").alias("n_contexts"), "n_retrievals")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def strategy_answers(spark, sf):
    """Answers of the four strategies whose further queries depend on what was found; checked against plain Python in the tests."""
    asked, retrieve = _asked(spark, sf)
    s = strategies.Strategies(retrieve)
    runs = {"react": s.react(asked), "adaptive": s.adaptive(asked, F.col("parts")), "self_rag": s.self_rag(asked), "flare": s.flare(asked)}
    out = None
    for name, rows in runs.items():
        part = rows.select(F.lit(name).alias("strategy"), "query_id", F.size("contexts").alias("n_contexts"), "n_retrievals", "answer")
        out = part if out is None else out.unionByName(part)
    return out


# ---- tools: each changes what it finds

_TOOLS = ["retrieve_kb", "lookup_article", "calculate_deadline", "check_eligibility", "search_by_amount", "no_such_tool"]
_KB = """kb AS MATERIALIZED (SELECT doc_id, source, CAST(doc_id % 50 AS VARCHAR) AS article_number,
    'Article ' || CAST(doc_id % 50 AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN ' délai de ' || CAST(doc_id % 23 AS VARCHAR) || ' jours ' ELSE ' ' END || CASE WHEN doc_id % 3 = 0 THEN 'frais ' || CAST(n_chars AS VARCHAR) || ' DH ' ELSE '' END || text AS text FROM documents WHERE text IS NOT NULL)"""


def _kb(spark, sf):
    """Documents as chunks with an article, some with a delay or a fee."""
    d, n = table(spark, sf, "documents").where("text is not null"), F.col("doc_id")
    article = (n % 50).cast("string")
    delay = F.when(n % 2 == 0, F.concat(F.lit(" délai de "), (n % 23).cast("string"), F.lit(" jours "))).otherwise(" ")
    fee = F.when(n % 3 == 0, F.concat(F.lit("frais "), F.col("n_chars").cast("string"), F.lit(" DH "))).otherwise("")
    text = F.concat(F.lit("Article "), article, delay, fee, "text")
    return d.select(n.alias("chunk_id"), "source", text.alias("text"), article.alias("article_number"), F.lit("").alias("law_name"))


@query(
    rf"""WITH {BM25}, {_KB}, tools AS (SELECT item_id, {sql_strings(_TOOLS)}[item_id % 6 + 1] AS tool FROM benchmark),
    h AS (SELECT item_id, doc_id, rank, bm25 / (bm25 + 10) AS rrf FROM ranked WHERE rank <= 10),
    r AS (SELECT item_id, CASE WHEN tool = 'no_such_tool' THEN 'retrieve_kb' ELSE tool END AS tool, doc_id, rank, text,
      CASE WHEN tool = 'check_eligibility' AND list_bool_or(list_transform({sql_strings(lx.ELIGIBILITY_WORDS)}, lambda k: contains(text, k))) THEN least(rrf * CAST(1.3 AS DOUBLE), 1)
        WHEN tool = 'search_by_amount' AND list_bool_or(list_transform(regexp_extract_all(text, '(?i)([0-9][0-9\s]*)\s*(?:درهم|DH|MAD|dirhams?)', 1), lambda x: coalesce(TRY_CAST(regexp_replace(x, '\s', '', 'g') AS BIGINT) BETWEEN 0 AND 100000, false))) THEN least(rrf * CAST(1.4 AS DOUBLE), 1) ELSE rrf END AS rrf
      FROM h JOIN tools USING (item_id) JOIN kb USING (doc_id) WHERE tool <> 'lookup_article'),
    s AS (SELECT item_id, tool, doc_id, rrf, text, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN tool IN ('check_eligibility', 'search_by_amount') THEN -round(rrf, 12) END NULLS FIRST, rank) AS rank FROM r),
    n AS (SELECT item_id, arg_min(CAST(regexp_extract(text, '([0-9]+)\s+(?:يوم|jour)', 1) AS INTEGER), rank) AS days FROM s WHERE tool = 'calculate_deadline' AND rank <= 3 AND regexp_matches(text, '([0-9]+)\s+(?:يوم|jour)') GROUP BY 1),
    work AS (SELECT DATE '2024-03-01' + CAST(k AS INTEGER) AS day, row_number() OVER (ORDER BY k) AS n FROM range(1, 60) t(k) WHERE isodow(DATE '2024-03-01' + CAST(k AS INTEGER)) < 6),
    a AS (SELECT item_id, 'lookup_article' AS tool, doc_id, 0.9 AS rrf, text, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank
      FROM tools JOIN kb ON contains(article_number, CAST(item_id % 7 AS VARCHAR)) WHERE tool = 'lookup_article'),
    u AS (SELECT item_id, tool, doc_id, rrf, rank, CASE WHEN rank = 1 AND days > 0 THEN '[Délai calculé / المدة المحسوبة: ' || CAST(days AS VARCHAR) || ' jours ouvrables → ' || strftime(day, '%d/%m/%Y') || '] ' || text ELSE text END AS text
      FROM s LEFT JOIN n USING (item_id) LEFT JOIN work ON work.n = n.days UNION ALL SELECT item_id, tool, doc_id, rrf, rank, text FROM a WHERE rank <= 10)
    SELECT item_id, tool, CAST(rank AS INTEGER) AS rank, doc_id, round(rrf, 6) AS rrf, md5(text) AS text_md5 FROM u"""
)
def agent_tool_effects(spark, sf):
    """Every benchmark item through one tool (an unknown one among them): boosts, deadlines, articles found by substring."""
    kb = Scratch(spark, "kb").keep(_kb(spark, sf))
    items = table(spark, sf, "benchmark")
    path = index.write_lexical(table(spark, sf, "documents"), F.lower("text"), Scratch(spark, "lexical").path, "doc_id")

    def retrieve(asked):
        hits = index.search_lexical(spark, path, asked, t.french_tokens(F.col("text")), id_col="doc_id", query_col="query_id").join(kb.withColumnRenamed("chunk_id", "doc_id"), "doc_id")
        score = F.col("bm25") / (F.col("bm25") + 10)
        return hits.select("query_id", F.col("doc_id").alias("chunk_id"), "source", "text", score.alias("score"), score.alias("rrf"), "rank")

    tools = agent.Tools(retrieve, kb, as_of=F.to_date(F.lit("2024-03-01")))
    tool = F.element_at(F.array(*[F.lit(x) for x in _TOOLS]), (F.col("item_id") % 6 + 1).cast("int"))
    asked = items.select(F.col("item_id").alias("query_id"), "text", tool.alias("tool"), F.when(tool == "lookup_article", (F.col("item_id") % 7).cast("string")).otherwise("").alias("article"), F.lit("").alias("law"))
    found = tools.run(asked, Scratch(spark, "tools").keep)
    return found.select(F.col("query_id").alias("item_id"), "tool", "rank", F.col("chunk_id").alias("doc_id"), r6("rrf").alias("rrf"), F.md5("text").alias("text_md5"))


# ---- verification


def _sql_match(c):
    return rf"lower(trim(regexp_replace(regexp_replace(translate({c}, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '[\x{{064B}}-\x{{0652}}\x{{0670}}]', '', 'g'), '\s+', ' ', 'g')))"


_CHECKED = f"c AS MATERIALIZED (SELECT * FROM {derived.CHECKED} WHERE answer IS NOT NULL AND len(texts) > 0)"
_FOUND = "found AS (" + " UNION ALL ".join(f"SELECT conv_id, turn, '{kind}' AS type, trim(unnest(regexp_extract_all(answer, '{pattern}', {int(pattern.endswith('|$)'))}))) AS entity FROM c" for kind, pattern in _SQL_ENTITIES) + f"""
    UNION ALL SELECT conv_id, turn, 'LOCATION', city FROM c, (SELECT unnest({sql_strings(lx.CITIES)}) AS city) WHERE contains(answer, city)),
    placed AS (SELECT conv_id, turn, type, entity, list_position(list_transform(texts, lambda x: contains({_sql_match('x')}, {_sql_match('entity')}) AND entity <> ''), TRUE) AS place, sources FROM found JOIN c USING (conv_id, turn))"""


@query(f"WITH {_CHECKED}, {_FOUND} SELECT conv_id, turn, type, entity, coalesce(place, 0) > 0 AS matched, CASE WHEN place > 0 THEN sources[place] END AS source FROM placed")
def entity_sources(spark, sf):
    """Entities of answers and the first chunk that holds each."""
    rows = derived.checked(spark, sf).where("answer is not null and size(chunks) > 0")
    found = rows.select("conv_id", "turn", F.explode(g.entity_sources(g.entities(F.col("answer")), F.col("chunks"))).alias("e"))
    return found.select("conv_id", "turn", "e.type", "e.entity", "e.matched", "e.source")


def _sql_claims(c):
    bare = rf"regexp_replace(trim(x), '^[\",\[\]{{}}\s]+|[\",\[\]{{}}\s]+$', '', 'g')".replace('\"', '"')
    noise = rf"""(len({bare}) <= 10 OR regexp_matches({bare}, 'https?://\S+') OR regexp_matches({bare}, '^(\{{|\[|"claims"|"ادعاءات"|claims|ادعاءات|réponse|json|المصدر|الرابط|المرجع)') OR regexp_matches(lower({bare}), 'the source|source for|reference link|le source'))"""
    return f"list_filter(list_transform(string_split_regex(substr({sql_strip(c)}, 1, 600), '[.?!؟]'), lambda x: trim(x)), lambda x: NOT {noise})[1:5]"


def _sql_grounded(claims, texts):
    mine = f"list_filter({_sql_words('k')}, lambda w: len(w) > 2 AND NOT list_contains({sql_strings(lx.CLAIM_STOPWORDS)}, w))"
    best = f"coalesce(list_max(list_transform({texts}, lambda y: CASE WHEN len({mine}) = 0 THEN 1.0 ELSE len(list_intersect({mine}, {_sql_words('y')})) / len({mine}) END)), CASE WHEN len({mine}) = 0 THEN 1.0 ELSE 0.0 END)"
    return f"len(list_filter({claims}, lambda k: {best} >= 0.3))"


_CLAIMS = f"""claimed AS (SELECT conv_id, turn, texts, is_multihop, {_sql_claims('answer')} AS claims, flatten(list_transform(intermediate, lambda z: {_sql_claims('z')})) AS steps FROM (SELECT * REPLACE (coalesce(answer, '') AS answer) FROM {derived.CHECKED})),
    judged AS (SELECT conv_id, turn, len(texts) > 0 AS backed, coalesce({_sql_grounded('claims', 'texts')} / nullif(len(claims), 0), 0) AS claim_ratio, NOT is_multihop OR {_sql_grounded('steps', 'texts')} = len(steps) AS chain_verified FROM claimed),
    e AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (place > 0) AS held FROM placed GROUP BY ALL),
    joined AS (SELECT j.*, coalesce(n, 0) AS n, coalesce(held / n, 1.0) AS entity_ratio, CASE WHEN chain_verified THEN 1.0 ELSE 0.5 END AS relation FROM judged j LEFT JOIN e USING (conv_id, turn)),
    scored AS (SELECT *, round(CASE WHEN n > 0 THEN 0.5 * claim_ratio + 0.3 * entity_ratio + 0.2 * relation ELSE (0.5 * claim_ratio + 0.2 * relation) / 0.7 END, 4) AS cfi FROM joined)"""


@query(
    f"""WITH c AS MATERIALIZED (SELECT * REPLACE (coalesce(answer, '') AS answer) FROM {derived.CHECKED}), {_FOUND}, {_CLAIMS}, g AS (SELECT *, claim_ratio >= 0.8 AND entity_ratio >= 1 AND cfi >= 0.7 AS ok FROM scored)
    SELECT conv_id, turn, round(claim_ratio, 6) AS claim_ratio, round(entity_ratio, 6) AS entity_ratio, chain_verified, CAST(cfi AS DOUBLE) AS cfi, backed AND ok AS is_grounded, NOT backed AS is_abstained,
      CASE WHEN backed AND NOT ok THEN concat_ws(',', CASE WHEN claim_ratio < 0.8 THEN 'claims' END, CASE WHEN entity_ratio < 1 THEN 'entities' END, CASE WHEN cfi < 0.7 THEN 'fidelity' END, CASE WHEN NOT chain_verified THEN 'chain' END) ELSE '' END AS warnings FROM g"""
)
def verified_answers(spark, sf):
    """All layers of verification over answers in two languages."""
    v = verify.verify(derived.checked(spark, sf), F.lit("-"))
    return v.select("conv_id", "turn", r6("claim_ratio").alias("claim_ratio"), r6("entity_ratio").alias("entity_ratio"), "chain_verified", "cfi", "is_grounded", "is_abstained", F.array_join("warnings", ",").alias("warnings"))


# ---- gold sets end to end

_PREFIX = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.CATEGORY_PREFIX.items()) + " ELSE substr(category, 1, 1) END"


@query(
    f"""WITH RECURSIVE raw AS MATERIALIZED (SELECT * FROM {_RAW}), old AS MATERIALIZED (SELECT 'S' || CAST(conv_id AS VARCHAR) AS id, question, conv_id FROM raw WHERE turn = 1 AND trim(coalesce(question, '')) <> ''),
    items AS MATERIALIZED (SELECT row_number() OVER (ORDER BY conv_id, turn) AS pos, conv_id, turn, trim(question) AS question, coalesce(language, 'arabic_msa') AS language,
      CASE WHEN language = 'Darija' AND upper(coalesce(category, 'SIMPLE')) <> 'OUTSCOPE' THEN 'DARIJA' WHEN language = 'Arabizi' AND upper(coalesce(category, 'SIMPLE')) <> 'OUTSCOPE' THEN 'ARABIZI' ELSE upper(coalesce(category, 'SIMPLE')) END AS category
      FROM raw WHERE turn <> 1 AND trim(coalesce(question, '')) <> ''),
    sets AS MATERIALIZED (SELECT pos, list_sort({_toks('question')}) AS tk FROM (SELECT pos, question FROM items UNION ALL SELECT -1 - conv_id, question FROM old)),
    e AS MATERIALIZED (SELECT pos, len(tk) AS n, unnest(tk) AS w FROM sets),
    near AS MATERIALIZED (SELECT x.pos AS a, y.pos AS b FROM e x JOIN e y ON x.w = y.w AND x.pos < y.pos WHERE y.pos > 0 GROUP BY x.pos, y.pos, x.n, y.n HAVING count(*) / greatest(x.n, y.n) >= 0.85 - 1e-12),
    o AS MATERIALIZED (SELECT b AS id, list(a) AS before, row_number() OVER (ORDER BY b) AS i FROM near GROUP BY b),
    g(i, dropped) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
      SELECT o.i, CASE WHEN len(list_filter(o.before, lambda x: NOT list_contains(g.dropped, x))) > 0 THEN list_append(g.dropped, o.id) ELSE g.dropped END FROM g JOIN o ON o.i = g.i + 1),
    last AS (SELECT dropped FROM g ORDER BY i DESC LIMIT 1), kept AS (SELECT items.*, {_PREFIX} AS p FROM items, last WHERE NOT list_contains(dropped, pos)),
    taken AS (SELECT 'S' AS p, max(CAST(substr(id, 2) AS BIGINT)) AS most FROM old)
    SELECT conv_id, turn, category, language, p || CAST(row_number() OVER (PARTITION BY p ORDER BY pos) + coalesce(most, 0) AS VARCHAR) AS item_key FROM kept LEFT JOIN taken USING (p)"""
)
def gold_build(spark, sf):
    """Raw rows to new items: blank ones go, near copies of the set (first exchanges) and of each other go, the rest get ids."""
    raw = Scratch(spark, "raw").keep(derived.raw(spark, sf))
    old = raw.where("turn = 1 and trim(coalesce(question, '')) <> ''").select(F.concat(F.lit("S"), F.col("conv_id").cast("string")).alias("id"), "question")
    return gold.build_set(raw.where("turn <> 1"), old, ["conv_id", "turn"]).select("conv_id", "turn", "category", "language", "item_key")


# ---- scores by vectors of tokens


def _place(c):
    return f"CAST('0x' || substr(md5({c}), 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings)"


@query(
    f"""WITH x AS MATERIALIZED (SELECT system, item_id, answer, gold_answer FROM {_RES} r JOIN {_GOLD} g USING (item_id) WHERE language <> 'Arabizi'),
    w AS (SELECT system, item_id, 0 AS side, unnest(list_filter(string_split({sql_norm(sql_strip('answer'))}, ' '), lambda t: t <> '')) AS token FROM x
      UNION ALL SELECT system, item_id, 1, unnest(list_filter(string_split({sql_norm('gold_answer')}, ' '), lambda t: t <> '')) FROM x),
    p AS (SELECT system, item_id, side, {_place('token')} AS vec_id, count(*) AS n FROM w GROUP BY ALL),
    v AS MATERIALIZED (SELECT p.*, list_transform(CAST(embedding AS DOUBLE[]), lambda a: a / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u FROM p JOIN embeddings USING (vec_id)),
    s AS (SELECT a.system, a.item_id, a.vec_id AS i, b.vec_id AS j, a.n AS na, b.n AS nb, list_inner_product(a.u, b.u) AS s FROM v a JOIN v b ON a.system = b.system AND a.item_id = b.item_id AND a.side = 0 AND b.side = 1),
    pr AS (SELECT system, item_id, sum(n * m) / sum(n) AS p FROM (SELECT system, item_id, i, any_value(na) AS n, max(s) AS m FROM s GROUP BY ALL) GROUP BY ALL),
    re AS (SELECT system, item_id, sum(n * m) / sum(n) AS r FROM (SELECT system, item_id, j, any_value(nb) AS n, max(s) AS m FROM s GROUP BY ALL) GROUP BY ALL)
    SELECT system, round(avg(coalesce(p, 0)), 5) AS precision, round(avg(coalesce(r, 0)), 5) AS recall, round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 5) AS f1, count(*) AS n
    FROM x LEFT JOIN pr USING (system, item_id) LEFT JOIN re USING (system, item_id) GROUP BY system"""
)
def embedding_scores(spark, sf):
    """Means of greedy token matching over answers but those to Arabizi; a token's vector is a hashed row of ``embeddings``."""
    rows = _joined(spark, sf).where("language <> 'Arabizi'")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("place"), F.col("embedding").alias("vector"))
    n = vectors.count()
    place = lambda tokens: F.transform(tokens, lambda w: F.pmod(F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(n)))
    pairs = rows.select("system", "item_id", place(m.metric_tokens(t.strip_citations(F.col("answer")))).alias("said"), place(m.metric_tokens(F.col("gold_answer"))).alias("meant"))
    scored = evaluate.token_matching(Scratch(spark, "pairs").keep(pairs), vectors, ["system", "item_id"])
    return scored.groupBy("system").agg(*[F.round(F.avg(c), 5).alias(c) for c in ("precision", "recall", "f1")], F.count("*").alias("n"))


# ---- runs, streams, sketches


@query(f"WITH {_J} SELECT system, item_id, round({_f1(sql_strip('answer'), 'gold_answer')}, 6) AS token_f1 FROM j")
def resumed_scores(spark, sf):
    """Results and scores of two systems from a run that was taken up again after its first system."""
    path, items = Scratch(spark, "run").path, Scratch(spark, "items").keep(derived.gold(spark, sf))
    results = Scratch(spark, "results").keep(derived.results(spark, sf))
    answer = lambda system, left: results.where(F.col("system") == system).join(left.select("item_id"), "item_id", "left_semi").drop("system")
    runs.Run(spark, path).advance("results", ["agentic"], items, "item_id", answer)
    run = runs.Run(spark, path)
    run.advance("results", ["agentic", "naive"], items, "item_id", answer)

    def score(system, left):
        rows = run.rows("results", system).join(left.select("item_id", "gold_answer"), "item_id")
        return rows.select("item_id", r6(m.token_f1(F.col("answer"), F.col("gold_answer"))).alias("token_f1"))

    run.advance("scores", ["agentic", "naive"], items, "item_id", score)
    return run.rows("scores").select("system", "item_id", "token_f1")


@query(
    """WITH e AS (SELECT *, event_id % 10 = 0 AS late, date_trunc('day', ts) AS start FROM events), w AS (SELECT max(ts) FILTER (NOT late) - INTERVAL 1 HOUR AS first, max(ts) - INTERVAL 1 HOUR AS last FROM e)
    SELECT strftime(start, '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e, w
    WHERE (NOT late OR start + INTERVAL 1 DAY > first) AND start + INTERVAL 1 DAY <= last GROUP BY 1, 2"""
)
def streaming_windows(spark, sf):
    """Daily counts by a watermarked stream. A tenth of the events comes in a later batch, where those of closed days are too late."""
    work, e = Scratch(spark, "stream").path, table(spark, sf, "events")
    source, sink, check = (f"{work}/{x}" for x in ("in", "out", "state"))
    for late in (False, True):
        e.where((F.col("event_id") % 10 == 0) == late).write.mode("append").parquet(source)
        events.run_to_end(events.tumbling(events.read_events(spark, source, 1_000_000)), sink, check)
    out = spark.read.schema("start timestamp, event_type string, n long, total double").parquet(sink)
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o),
    g AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k)
    SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, n FROM g WHERE stop <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
)
def streaming_sessions(spark, sf):
    """Sessions of users that a stream has closed: its state holds the open ones."""
    work = Scratch(spark, "stream").path
    table(spark, sf, "events").write.parquet(f"{work}/in")
    events.run_to_end(events.sessions(events.read_events(spark, f"{work}/in", 1_000_000)), f"{work}/out", f"{work}/state")
    out = spark.read.schema("user_id long, start timestamp, end timestamp, n long").parquet(f"{work}/out")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(
    """SELECT event_type, pct, round(v[least(CAST(floor(len(v) * pct / 100) AS INTEGER) + 1, len(v))], 6) AS exact, TRUE AS within_bound FROM
    (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type), (VALUES (1), (50), (95), (99)) p(pct)"""
)
def approx_quantiles(spark, sf):
    """Quantiles from merged sketches of ten parts of the events, beside the exact ones; they may differ by a hundredth."""
    e, percents = table(spark, sf, "events"), [1, 50, 95, 99]
    parts = sketches.quantile_sketch(e.withColumn("part", F.col("event_id") % 10), ["part", "event_type"], "value")
    found = sketches.sketch_quantiles(sketches.merge_sketches(parts, ["event_type"]), ["event_type"], percents)
    exact = evaluate.nearest_rank(e, ["event_type"], "value", percents).withColumnRenamed("value", "exact")
    near = F.abs(F.col("value") - F.col("exact")) <= (sketches.ACCURACY + 1e-9) * F.abs("exact")
    return exact.join(found, ["event_type", "pct"], "left").select("event_type", "pct", r6("exact").alias("exact"), F.coalesce(near, F.lit(False)).alias("within_bound"))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 0.005 * (SELECT count(*) FROM lineitem WHERE l_suppkey IS NOT NULL)")
def heavy_suppliers(spark, sf):
    """Suppliers of more than one in 200 order lines: candidates from bounded counters, counted exactly."""
    return sketches.heavy_items(table(spark, sf, "lineitem"), "l_suppkey", 0.005)


# ---- audits of items


def _sql_any_of(c, items):
    return f"list_bool_or(list_transform({sql_strings(items)}, lambda k: contains({c}, k)))"


def _sql_script(c):
    letters, arabic = rf"len(regexp_extract_all({c}, '\p{{L}}'))", rf"len(regexp_extract_all({c}, '[\x{{0620}}-\x{{064A}}\x{{066E}}-\x{{06D3}}]'))"
    return f"CASE WHEN {letters} = 0 THEN 'none' WHEN {arabic} / {letters} > 0.6 THEN 'arabic' WHEN {arabic} / {letters} < 0.2 THEN 'latin' ELSE 'mixed' END"


def _sql_has(c, pattern):
    quoted = pattern.replace("'", "''")
    return f"regexp_matches({c}, '{quoted}')"


_AR = r"[\x{0600}-\x{06FF}]"
_LATIN, _SCRIPTED = "coalesce(language IN ('Arabizi', 'french'), FALSE)", "coalesce(language IN ('arabic_msa', 'Darija'), FALSE)"
_RULES = [
    ("expected <> '' AND expected <> language", "LANG_FIELD_MISMATCH"),
    (f"{_LATIN} AND {_sql_has('q', _AR)}", "Q_HAS_ARABIC"),
    (f"{_SCRIPTED} AND {_sql_script('q')} = 'latin'", "Q_WRONG_SCRIPT"),
    (f"NOT abstain AND {_LATIN} AND {_sql_script('a')} = 'arabic'", "A_IS_ARABIC"),
    (f"NOT abstain AND {_LATIN} AND {_sql_script('a')} = 'mixed'", "A_MIXED_SCRIPT"),
    (f"NOT abstain AND {_SCRIPTED} AND {_sql_script('a')} = 'latin'", "A_IS_LATIN"),
    (f"len(keywords) > 0 AND {_LATIN} AND {_sql_has('kw', _AR)}", "KW_HAS_ARABIC"),
    (f"len(keywords) > 0 AND {_SCRIPTED} AND {_sql_has('kw', '[a-zA-Z]')} AND NOT {_sql_has('kw', _AR)}", "KW_IS_LATIN"),
    ("len(keywords) = 0 AND NOT abstain", "KW_EMPTY"),
    (f"language = 'Arabizi' AND {_sql_has('lower(q)', f'[{lx.TRANSLITERATION_MARKS}]')}", "ARABIZI_IPA_IN_Q"),
    (f"language = 'Arabizi' AND {_sql_has('lower(a)', f'[{lx.TRANSLITERATION_MARKS}]')}", "ARABIZI_IPA_IN_A"),
    ("NOT abstain AND trim(a) = ''", "ANSWER_EMPTY"),
    ("NOT abstain AND trim(a) <> '' AND says_so", "ANSWER_LOOKS_ABSTAIN"),
    ("abstain AND trim(a) <> '' AND NOT says_so", "OUTSCOPE_NOT_ABSTAINING"),
    (f"CASE WHEN {_LATIN} THEN {_sql_has('q', '(?i)' + '|'.join(lx.DANGLING['latin']))} ELSE {_sql_has('q', '|'.join(lx.DANGLING['arabic']))} END", "MAYBE_NOT_SELF_CONTAINED"),
]
_AUDIT = f"""x AS (SELECT *, coalesce(question, '') AS q, coalesce(answer, '') AS a, array_to_string(keywords, ' ') AS kw, {_sql_any_of("lower(coalesce(answer, ''))", lx.AUDIT_ABSTAIN_MARKERS)} AS says_so FROM {derived.AUDITED}),
    codes AS (SELECT conv_id, turn, list_filter([{', '.join(f"CASE WHEN {rule} THEN '{code}' END" for rule, code in _RULES)}], lambda c: c IS NOT NULL) AS codes FROM x)"""


def _codes(spark, sf):
    rows = derived.audited(spark, sf)
    return rows.select("conv_id", "turn", curate.audit_codes(F.col("language"), F.col("expected"), F.col("question"), F.col("answer"), F.col("keywords"), F.col("abstain")).alias("codes"))


@query(f"WITH {_AUDIT} SELECT conv_id, turn, array_to_string(codes, ',') AS issues FROM codes")
def audit_codes(spark, sf):
    """Issue codes of every item, in the order of the rules."""
    return _codes(spark, sf).select("conv_id", "turn", F.array_join("codes", ",").alias("issues"))


@query(f"WITH {_AUDIT} SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM codes) GROUP BY code")
def issue_counts(spark, sf):
    return _codes(spark, sf).select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def _sql_count_of(c, pattern):
    return f"len(regexp_extract_all({c}, '{pattern}'))"


_HEAD_AR, _HEAD_LA = _sql_count_of("substr(answer, 1, 80)", _AR), _sql_count_of("substr(answer, 1, 80)", "[A-Za-z]")
_N = r"len(list_filter(string_split_regex({}, '\s+'), lambda w: w <> ''))"


@query(
    f"""SELECT conv_id, turn, coalesce(category IS NOT NULL AND language IS NOT NULL AND question IS NOT NULL AND answer IS NOT NULL
      AND NOT (contains(answer, '...') OR contains(question, '...') OR len(list_filter(keywords, lambda k: contains(k, '...'))) > 0) AND NOT (contains(answer, '[exact') OR contains(question, '[exact'))
      AND NOT ({_sql_any_of('lower(question)', [p.lower() for p in lx.NON_ATOMIC])} OR {_sql_any_of('answer', ['باقي الوثائق المذكورة', 'الوثائق المذكورة أعلاه'])})
      AND NOT (language IN ('Arabizi', 'Darija') AND ({_HEAD_LA} > {_HEAD_AR} OR {_HEAD_AR} < 5)) AND len(keywords) BETWEEN 1 AND 8 AND {_N.format('question')} >= 4
      AND {_N.format('answer')} >= CASE WHEN upper(category) = 'OUTSCOPE' THEN 3 ELSE 10 END AND list_contains({sql_strings(list(lx.CATEGORY_PREFIX))}, upper(category)) AND list_contains({sql_strings(list(lx.EXPECTED_SCRIPT))}, language), FALSE) AS valid
    FROM {derived.AUDITED}"""
)
def valid_items(spark, sf):
    rows = derived.audited(spark, sf)
    ok = curate.is_valid_item(F.col("category"), F.col("language"), F.col("question"), F.col("answer"), F.col("keywords"), F.lit("x"))
    return rows.select("conv_id", "turn", ok.alias("valid"))


# ---- language by several votes


def _sql_held(c, items):
    return f"len(list_filter({sql_strings(items)}, lambda k: contains({c}, k)))"


def _sql_ensemble(keys, source):
    pick = lambda name: f"CASE WHEN sl = '{name}' THEN sc ELSE 0 END + 1.5 * CASE WHEN kl = '{name}' THEN kc ELSE 0 END"
    count = lambda pattern: f"len(regexp_extract_all(text, '{pattern}'))"
    return rf"""WITH c AS (SELECT {keys}, text, {count(r'[^\s0-9]')} AS n, {count(r'[\x{0600}-\x{06FF}]')} AS ar, {count('[A-Za-z]')} AS la, {_sql_held('text', lx.MSA_PHRASES)} AS ka, {_sql_held('lower(text)', lx.FRENCH_PHRASES)} AS kf,
      {_sql_held('text', lx.ENSEMBLE_DARIJA)} AS darija, {_sql_held('lower(text)', lx.ENSEMBLE_ARABIZI)} AS arabizi FROM {source}),
    r AS (SELECT *, ar / nullif(n, 0) AS a, la / nullif(n, 0) AS b FROM c),
    v AS (SELECT *, CASE WHEN n < 3 THEN 'unknown' WHEN a > 0.55 THEN 'arabic_msa' WHEN b > 0.65 THEN 'french' WHEN a > b THEN 'arabic_msa' ELSE 'french' END AS sl,
      CASE WHEN n < 3 THEN 0 WHEN a > 0.55 THEN least(1, (a - 0.55) / 0.45 + 0.5) WHEN b > 0.65 THEN least(1, (b - 0.65) / 0.35 + 0.5) ELSE 0.4 END AS sc,
      CASE WHEN ka + kf = 0 THEN 'unknown' WHEN ka >= kf THEN 'arabic_msa' ELSE 'french' END AS kl, CASE WHEN ka + kf = 0 THEN 0 ELSE least(1, 0.5 + greatest(ka, kf) / (2.0 * (ka + kf))) END AS kc FROM r),
    w AS (SELECT *, ({pick('arabic_msa')}) AS wa, ({pick('french')}) AS wb FROM v), s AS (SELECT *, wa / nullif(wa + wb, 0) AS share FROM w)
    SELECT {keys}, CASE WHEN trim(text) = '' THEN 'unknown' WHEN darija >= 2 THEN 'Darija' WHEN arabizi >= 2 THEN 'Arabizi' WHEN share IS NULL THEN 'arabic_msa' WHEN share > 0.25 AND share < 0.75 THEN 'mixed' WHEN share >= 0.75 THEN 'arabic_msa' ELSE 'french' END AS language,
      round(CAST(CASE WHEN trim(text) = '' THEN 0 WHEN darija >= 2 THEN least(0.85 + 0.03 * (darija - 2), 0.95) WHEN arabizi >= 2 THEN least(0.80 + 0.03 * (arabizi - 2), 0.92) WHEN share IS NULL THEN 0.3
        WHEN share > 0.25 AND share < 0.75 THEN 2 * least(share, 1 - share) WHEN share >= 0.75 THEN share ELSE 1 - share END AS DOUBLE), 6) AS confidence FROM s"""


@query(_sql_ensemble("conv_id, turn", "conversations"))
def ensemble_language(spark, sf):
    v = la.ensemble_language(table(spark, sf, "conversations"), "text")
    return v.select("conv_id", "turn", "language", r6("confidence").alias("confidence"))


@query(_sql_ensemble("conv_id, turn", f"(SELECT conv_id, turn, CASE WHEN turn = 1 THEN split_part(question, '?', 1) ELSE question END AS text FROM {_RAW} WHERE question IS NOT NULL)"))
def ensemble_dialects(spark, sf):
    """The same over raw questions in Arabic, dialect and French, some without the exchange's own words."""
    rows = derived.raw(spark, sf).where("question is not null")
    text = F.when(F.col("turn") == 1, F.split_part("question", F.lit("?"), F.lit(1))).otherwise(F.col("question"))
    v = la.ensemble_language(rows.select("conv_id", "turn", text.alias("text")), "text")
    return v.select("conv_id", "turn", "language", r6("confidence").alias("confidence"))
