"""Evaluation tables made from the given ones: conversations, documents and pages, each row joined to a template row.

The given tables hold no Arabic, dialect, amounts or scores, so every exchange (or document) takes a template of
``fixtures`` by its number and puts its own text behind the template's. Each table comes twice: as a DataFrame, and as
a SQL subquery of the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as fx

_EXCHANGES = """(SELECT a.conv_id, a.turn, a.conv_id * 7 + a.turn AS k, coalesce(a.text, '') AS said, coalesce(q.text, '') AS asked FROM conversations a
    JOIN conversations q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE a.role = 'assistant' AND q.role = 'user')"""


def exchanges(spark, sf):
    """(conv_id, turn, k, said, asked): answers with the question before them."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    a = c.where("role = 'assistant'").select("conv_id", "turn", (F.col("conv_id") * 7 + F.col("turn")).alias("k"), F.coalesce("text", F.lit("")).alias("said"))
    return a.join(c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.coalesce("text", F.lit("")).alias("asked")), ["conv_id", "turn"])


def _numbered(rows, schema):
    return [(i, *r) for i, r in enumerate(rows)], f"tn int, {schema}"


def _sql(rows, schema):
    return fx.values(*_numbered(rows, schema))


def templates(spark, rows, schema, key, n=None):
    """The small table of templates under the name of the key they are joined by."""
    made = fx.frame(spark, *_numbered(rows, schema))
    return made, F.pmod(key, F.lit(n or len(rows))).cast("int")


_NAME = "'-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)"
_name = lambda: F.concat(F.lit("-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
_word = lambda c: F.split_part(c, F.lit(" "), F.lit(1))

GOLD = f"""(SELECT item_id || {_NAME} AS item_id, category, language, CASE WHEN source = '' THEN '' ELSE source || '-' || CAST(conv_id % 20 AS VARCHAR) END AS source, gold_answer || ' ' || asked AS gold_answer,
    CASE WHEN len(gold_keywords) = 0 THEN gold_keywords ELSE list_append(gold_keywords, split_part(asked, ' ', 1)) END AS gold_keywords, is_multihop
  FROM {_EXCHANGES} x JOIN {_sql(fx.GOLD, fx.GOLD_SCHEMA)} g ON x.k % {len(fx.GOLD)} = tn)"""


def gold(spark, sf):
    """An item for every exchange; its own question ends the gold answer, and a word of it is a keyword."""
    t, at = templates(spark, fx.GOLD, fx.GOLD_SCHEMA, F.col("k"))
    rows = exchanges(spark, sf).withColumn("tn", at).join(t, "tn")
    return rows.select(
        F.concat("item_id", _name()).alias("item_id"), "category", "language", F.when(F.col("source") == "", "").otherwise(F.concat("source", F.lit("-"), (F.col("conv_id") % 20).cast("string"))).alias("source"),
        F.concat("gold_answer", F.lit(" "), "asked").alias("gold_answer"),
        F.when(F.size("gold_keywords") == 0, F.col("gold_keywords")).otherwise(F.concat("gold_keywords", F.array(_word("asked")))).alias("gold_keywords"), "is_multihop",
    )


RESULTS = f"""(SELECT r.system, r.item_id || {_NAME} AS item_id, CASE WHEN k % 11 = 0 THEN g.gold_answer || ' ' || asked WHEN r.answer = '' THEN '' WHEN k % 3 = 0 THEN r.answer || ' ' || said ELSE r.answer || ' ' || asked END AS answer,
    CASE WHEN len(contexts) = 0 THEN contexts ELSE list_append(contexts, asked) END AS contexts, latency_sec + turn / 8.0 AS latency_sec, is_outscope, agent_steps, n_tool_calls, cfi, claim_ratio, entity_ratio, is_grounded
  FROM {_EXCHANGES} x JOIN {_sql(fx.GOLD, fx.GOLD_SCHEMA)} g ON x.k % {len(fx.GOLD)} = g.tn JOIN {fx.values(fx.RESULTS, fx.RESULT_SCHEMA)} r ON r.item_id = g.item_id)"""


def results(spark, sf):
    """Two systems' answers to the items; every eleventh is the gold answer."""
    t, at = templates(spark, fx.GOLD, fx.GOLD_SCHEMA, F.col("k"))
    r = fx.frame(spark, fx.RESULTS, fx.RESULT_SCHEMA)
    rows = exchanges(spark, sf).withColumn("tn", at).join(t.select("tn", "item_id", "gold_answer"), "tn").join(r, "item_id")
    more = lambda c: F.concat(c, F.lit(" "), F.when(F.col("k") % 3 == 0, F.col("said")).otherwise(F.col("asked")))
    answer = F.when(F.col("k") % 11 == 0, F.concat("gold_answer", F.lit(" "), "asked")).when(F.col("answer") == "", "").otherwise(more(F.col("answer")))
    return rows.select(
        "system", F.concat("item_id", _name()).alias("item_id"), answer.alias("answer"), F.when(F.size("contexts") == 0, F.col("contexts")).otherwise(F.concat("contexts", F.array("asked"))).alias("contexts"),
        (F.col("latency_sec") + F.col("turn") / 8.0).alias("latency_sec"), "is_outscope", "agent_steps", "n_tool_calls", "cfi", "claim_ratio", "entity_ratio", "is_grounded",
    )


TEXTS = f"(SELECT doc_id AS id, t.text || ' ' || d.text AS text FROM documents d JOIN {_sql(fx.TEXTS, fx.TEXT_SCHEMA)} t ON d.doc_id % {len(fx.TEXTS)} = tn)"


def texts(spark, sf):
    t, at = templates(spark, fx.TEXTS, fx.TEXT_SCHEMA, F.col("doc_id"))
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("own")).withColumn("tn", at)
    return d.join(t, "tn").select(F.col("doc_id").alias("id"), F.concat("text", F.lit(" "), "own").alias("text"))


PAIRS = f"""(SELECT conv_id, turn, claim || ' ' || asked AS claim, CASE WHEN len(chunks) > 0 THEN list_append(chunks, said) ELSE chunks END AS chunks FROM {_EXCHANGES} x JOIN {_sql(fx.PAIRS, fx.PAIR_SCHEMA)} p ON x.k % {len(fx.PAIRS)} = tn)"""


def pairs(spark, sf):
    t, at = templates(spark, fx.PAIRS, fx.PAIR_SCHEMA, F.col("k"))
    rows = exchanges(spark, sf).withColumn("tn", at).join(t, "tn")
    return rows.select("conv_id", "turn", F.concat("claim", F.lit(" "), "asked").alias("claim"), F.when(F.size("chunks") > 0, F.concat("chunks", F.array("said"))).otherwise(F.col("chunks")).alias("chunks"))


RAW = f"""(SELECT conv_id, turn, CASE WHEN trim(question) <> '' THEN question || ' ' || asked ELSE question END AS question, category, language, gold_answer || ' ' || said AS gold_answer, is_multihop, should_abstain
  FROM {_EXCHANGES} x JOIN {_sql(fx.RAW, fx.RAW_SCHEMA)} r ON x.k % {len(fx.RAW)} = tn)"""


def raw(spark, sf):
    """Raw question-answer rows, some blank, some without a category or language."""
    t, at = templates(spark, fx.RAW, fx.RAW_SCHEMA, F.col("k"))
    rows = exchanges(spark, sf).withColumn("tn", at).join(t, "tn")
    question = F.when(F.trim("question") != "", F.concat("question", F.lit(" "), "asked")).otherwise(F.col("question"))
    return rows.select("conv_id", "turn", question.alias("question"), "category", "language", F.concat("gold_answer", F.lit(" "), "said").alias("gold_answer"), "is_multihop", "should_abstain")


JUDGED = f"(SELECT system, rating - quality AS rating, supported, facts, reply FROM labels JOIN {_sql(fx.JUDGED, fx.JUDGED_SCHEMA)} j ON doc_id % {len(fx.JUDGED)} = tn)"


def judged(spark, sf):
    t, at = templates(spark, fx.JUDGED, fx.JUDGED_SCHEMA, F.col("doc_id"))
    return spark.read.parquet(f"{sf}/labels.parquet").withColumn("tn", at).join(t, "tn").select("system", (F.col("rating") - F.col("quality")).alias("rating"), "supported", "facts", "reply")


ASKED = f"""(SELECT 'q' || CAST(b.item_id AS VARCHAR) AS query_id, split_part(b.text, '.', 1) AS text, language, intents, parts || chr(10) || '1. ' || split_part(b.text, '.', 2) AS parts, made_up || ' ' || split_part(b.text, '.', 3) AS made_up
  FROM benchmark b JOIN {_sql(fx.ASKED, fx.ASKED_SCHEMA)} a ON b.item_id % {len(fx.ASKED)} = tn)"""


def asked(spark, sf):
    """Questions: the first sentence of each benchmark item, with the template's language, intents, parts and hypothetical answer."""
    t, at = templates(spark, fx.ASKED, fx.ASKED_SCHEMA, F.col("item_id"))
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.col("text").alias("own")).withColumn("tn", at)
    part = lambda i: F.split_part("own", F.lit("."), F.lit(i))
    return b.join(t, "tn").select(
        F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), part(1).alias("text"), "language", "intents", F.concat("parts", F.lit("\n1. "), part(2)).alias("parts"), F.concat("made_up", F.lit(" "), part(3)).alias("made_up"),
    )


KEYED_K = 10
KEYED = f"""(SELECT lower(split_part(d.text, ' ', 2)) AS key, 'c' || CAST(doc_id AS VARCHAR) AS chunk_id, source, substr(d.text, 1, 400) AS body, (doc_id % 10) / 10.0 AS score FROM documents d WHERE d.text IS NOT NULL)"""


def keyed(spark, sf):
    """Chunks: the start of each document under its second word."""
    d = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    key = F.lower(F.split_part("text", F.lit(" "), F.lit(2)))
    return d.select(key.alias("key"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), "source", F.substring("text", 1, 400).alias("body"), ((F.col("doc_id") % 10) / 10.0).alias("score"))


_CHUNKED = [(a, None if c is None else [x for x, _ in c], None if c is None else [x for _, x in c], i, m) for a, c, i, m in fx.CHECKED]
_CHUNKED_SCHEMA = "answer string, sources array<string>, texts array<string>, intermediate array<string>, is_multihop boolean"
CHECKED = f"""(SELECT conv_id, turn, answer || replace(asked, chr(10), ' ') AS answer, CASE WHEN len(texts) > 0 THEN list_append(sources, 'conv') ELSE [] END AS sources,
    CASE WHEN len(texts) > 0 THEN list_append(texts, said) ELSE [] END AS texts, coalesce(intermediate, []) AS intermediate, is_multihop FROM {_EXCHANGES} x JOIN {_sql(_CHUNKED, _CHUNKED_SCHEMA)} c ON x.k % {len(fx.CHECKED)} = tn)"""


def checked(spark, sf):
    """Answers of one line with their evidence: the template's chunks and the exchange's own answer."""
    t, at = templates(spark, fx.CHECKED, fx.CHECKED_SCHEMA, F.col("k"))
    rows = exchanges(spark, sf).withColumn("tn", at).join(t, "tn")
    own = F.array(F.struct(F.lit("conv").alias("source"), F.col("said").alias("text")))
    return rows.select(
        "conv_id", "turn", F.concat("answer", F.translate("asked", "\n", " ")).alias("answer"), F.when(F.size("chunks") > 0, F.concat("chunks", own)).otherwise(F.slice(own, 1, 0)).alias("chunks"), "intermediate", "is_multihop",
    )


PROCEDURES = f"""(SELECT 'p' || CAST(page_id AS VARCHAR) AS procedure_id, CASE WHEN page_id % 3 = 0 THEN url || chr(10) || '{{heading}}' ELSE url END AS body, CASE WHEN page_id % 7 = 0 THEN NULL ELSE 'a' || CAST(page_id % 40 AS VARCHAR) END AS administration_id FROM pages)"""
NAMED = "(SELECT 'p' || CAST(doc_id // 3 AS VARCHAR) AS procedure_id, doc_id AS pos, source || ' ' || CAST(n_chars AS VARCHAR) AS name FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL)"
OFFICES = "(SELECT 'a' || CAST(n_nationkey AS VARCHAR) AS administration_id, n_name AS name FROM nation)"


def procedures(spark, sf, heading):
    """(procedures, their documents, offices): pages, three documents each, nations; every third page lists documents already."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    body = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("\n" + heading))).otherwise(F.col("url"))
    p = read("pages").select(name("p", F.col("page_id")).alias("procedure_id"), body.alias("body"), F.when(F.col("page_id") % 7 != 0, name("a", F.col("page_id") % 40)).alias("administration_id"))
    d = read("documents").where("source is not null and n_chars is not null")
    d = d.select(name("p", F.floor(F.col("doc_id") / 3)).alias("procedure_id"), F.col("doc_id").alias("pos"), F.concat("source", F.lit(" "), F.col("n_chars").cast("string")).alias("name"))
    return p, d, read("nation").select(name("a", F.col("n_nationkey")).alias("administration_id"), F.col("n_name").alias("name"))


_K = "(conv_id * 7 + turn)"
AUDITED = f"""(SELECT conv_id, turn, category, language, CASE {_K} % 4 WHEN 0 THEN language WHEN 1 THEN 'french' WHEN 2 THEN '' ELSE 'Darija' END AS expected,
    CASE WHEN {_K} % 6 = 0 THEN question || ' cette procédure ā' WHEN {_K} % 7 = 0 THEN question || ' المذكورة' ELSE question END AS question,
    CASE WHEN {_K} % 9 = 0 THEN '' WHEN {_K} % 5 = 0 THEN 'غير متوفر' ELSE gold_answer END AS answer,
    CASE {_K} % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['75 درهم', 'frais'] ELSE ['frais', 'photos'] END AS keywords, coalesce(should_abstain, FALSE) OR {_K} % 8 = 0 AS abstain FROM {RAW})"""


def audited(spark, sf):
    """Items with faults of every kind: wrong languages and scripts, empty or evasive answers, words that refer elsewhere."""
    k, words = F.col("conv_id") * 7 + F.col("turn"), lambda *x: F.array(*[F.lit(w) for w in x]).cast("array<string>")
    question = F.when(k % 6 == 0, F.concat("question", F.lit(" cette procédure ā"))).when(k % 7 == 0, F.concat("question", F.lit(" المذكورة"))).otherwise(F.col("question"))
    return raw(spark, sf).select(
        "conv_id", "turn", "category", "language", F.when(k % 4 == 0, F.col("language")).when(k % 4 == 1, "french").when(k % 4 == 2, "").otherwise("Darija").alias("expected"), question.alias("question"),
        F.when(k % 9 == 0, "").when(k % 5 == 0, "غير متوفر").otherwise(F.col("gold_answer")).alias("answer"),
        F.when(k % 3 == 0, words()).when(k % 3 == 1, words("75 درهم", "frais")).otherwise(words("frais", "photos")).alias("keywords"), (F.coalesce("should_abstain", F.lit(False)) | (k % 8 == 0)).alias("abstain"),
    )
