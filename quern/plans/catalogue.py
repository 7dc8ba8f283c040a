"""Registered queries and, for each that SQL can express, the SQL it must agree with (DuckDB dialect)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import grounding as g
from ..functions import language as la
from ..functions import lexicon as lx
from ..functions import metrics as m
from ..functions import text as t
from ..operators import agent, chunking, curate, evaluate, index, relational, vectors
from ..session import Scratch
from ..sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


def turns(spark, sf):
    """Answers with the question before them: an equi-join on conversation and turn, so no conversation is gathered."""
    c = table(spark, sf, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    q = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return a.join(q, ["conv_id", "turn"])


# SQL pieces shared by oracles.
_FROM, _TO = lx.FRENCH_FOLD
_STOP = "[" + ", ".join(f"'{w}'" for w in lx.FRENCH_STOPWORDS) + "]"


def sql_tokens(c):
    return f"list_filter(string_split_regex(translate(lower({c}), '{_FROM}', '{_TO}'), '[^a-z0-9]+'), lambda x: len(x) >= 2 AND NOT list_contains({_STOP}, x))"


def sql_words(c):
    return rf"list_filter(string_split_regex({c}, '\s+'), lambda x: x <> '')"


def sql_count(c, pattern):
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def sql_norm(c):
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s\x{{0600}}-\x{{06FF}}]', ' ', 'g'), '\s+', ' ', 'g'))"


def sql_metric_tokens(c):
    return f"list_filter(string_split({sql_norm(c)}, ' '), lambda x: x <> '')"


def sql_strip(c):
    return rf"regexp_replace(regexp_replace({c}, '(?i)\[Source:[^\]]*\]', '', 'g'), 'https?://\S+', '', 'g')"


def sql_strings(items):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


TURNS = """turns AS (SELECT a.conv_id, a.turn, a.text AS answer, q.text AS question FROM conversations a
  JOIN conversations q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE a.role = 'assistant' AND q.role = 'user')"""

BM25 = f"""toks AS MATERIALIZED (SELECT doc_id, {sql_tokens('text')} AS t FROM documents),
d AS (SELECT doc_id, len(t) AS dl, t FROM toks),
post AS MATERIALIZED (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(t) AS term FROM d) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(dl) AS mean FROM d),
idf0 AS MATERIALIZED (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY term, n),
idf AS MATERIALIZED (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM idf0) ELSE raw END AS idf FROM idf0),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({sql_tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT item_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS bm25
  FROM post JOIN idf USING (term) JOIN q USING (term), st GROUP BY item_id, doc_id),
ranked AS MATERIALIZED (SELECT item_id, doc_id, bm25, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 9) DESC, doc_id DESC) AS rank FROM scored)"""


def _bm25(spark, sf):
    return index.bm25(
        table(spark, sf, "documents"), table(spark, sf, "benchmark"), F.lower("text"), t.french_tokens(F.col("text")), id_col="doc_id", query_col="item_id"
    )


@query(f"WITH {BM25} SELECT item_id, doc_id, round(bm25, 6) AS bm25, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def bm25_topk(spark, sf):
    """Top 10 documents of each benchmark passage."""
    return _bm25(spark, sf).select("item_id", "doc_id", r6("bm25").alias("bm25"), "rank")


DENSE = """s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)"""


def _dense(spark, sf):
    e = table(spark, sf, "embeddings")
    return index.dense_topk(e, e.where("vec_id % 20 = 0"), id_col="vec_id", vec_col="embedding", k=10)


@query(f"WITH {DENSE} SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def dense_topk(spark, sf):
    """Exact inner-product neighbours; queries are the ids divisible by 20, against all rows."""
    return _dense(spark, sf).select("query_id", "vec_id", r6("score").alias("score"), "rank")


def _kept_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    path = vectors.write_vectors(e, Scratch(spark, "vectors").path, "vec_id", "embedding")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.search_vectors(spark, path, asked, query_col="query_id", vec_col="embedding", id_col="vec_id", k=10)


@query(f"WITH {DENSE} SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def vector_index_topk(spark, sf):
    """The same neighbours from a kept index of cells, read as far as radius bounds ask."""
    return _kept_vectors(spark, sf)[0].select("query_id", "vec_id", r6("score").alias("score"), "rank")


@query()
def vector_index_reading(spark, sf):
    """Blocks that each query read of those the index has."""
    return _kept_vectors(spark, sf)[1]


@query(
    f"""WITH {DENSE}, kept AS (SELECT * FROM r WHERE rank <= 10 AND score >= 0.2),
    b AS (SELECT query_id, count(*) AS n, CAST(max(rank) AS INTEGER) AS last_rank, round(min(score), 6) AS least FROM kept GROUP BY query_id) SELECT * FROM b"""
)
def dense_floor(spark, sf):
    """Neighbours above the score floor; ranks are those before it."""
    kept = _dense(spark, sf).where(F.col("score") >= lx.DENSE_FLOOR)
    return kept.groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("last_rank"), r6(F.min("score")).alias("least"))


LEAD = """nd AS (SELECT doc_id, count(*) AS nd FROM post GROUP BY doc_id),
lead AS MATERIALIZED (SELECT item_id, doc_id, overlap, row_number() OVER (PARTITION BY item_id ORDER BY round(overlap, 9) DESC, doc_id) AS rank FROM (
  SELECT item_id, doc_id, count(*) / any_value(nd) AS overlap FROM post JOIN q USING (term) JOIN nd USING (doc_id) GROUP BY item_id, doc_id))"""
FUSED = f"""{BM25}, {LEAD},
parts AS (SELECT item_id, doc_id, 0 AS l, rank, 0.6 / (60 + rank) AS p FROM lead WHERE rank <= 10
  UNION ALL SELECT item_id, doc_id, 1, rank, 0.4 / (60 + rank) FROM ranked WHERE rank <= 10),
fused AS (SELECT item_id, doc_id, sum(p) AS rrf, min(l * 1000 + rank) AS first FROM parts GROUP BY item_id, doc_id),
fr AS MATERIALIZED (SELECT item_id, doc_id, rrf, row_number() OVER (PARTITION BY item_id ORDER BY round(rrf, 12) DESC, first, doc_id) AS rank FROM fused)"""


def _fused(spark, sf):
    """Both lists come from one index."""
    items, tokens = table(spark, sf, "benchmark"), t.french_tokens(F.col("text"))
    path = index.write_lexical(table(spark, sf, "documents"), F.lower("text"), Scratch(spark, "lexical").path, "doc_id")
    found = [f(spark, path, items, tokens, id_col="doc_id", query_col="item_id") for f in (index.search_share, index.search_lexical)]
    return index.fuse(*found, query_col="item_id", id_col="doc_id")


@query(f"WITH {FUSED} SELECT item_id, doc_id, round(rrf, 6) AS rrf, CAST(rank AS INTEGER) AS rank FROM fr WHERE rank <= 10")
def rrf_fusion(spark, sf):
    """Fusion of BM25 with a second list: the share of a document's distinct tokens that are asked for."""
    return _fused(spark, sf).where(F.col("rank") <= lx.RETRIEVE_K).select("item_id", "doc_id", r6("rrf").alias("rrf"), "rank")


SQL_GARBAGE = rf"""(len({sql_words('text')}) < 5 OR ({sql_count('text', r'[\x{0600}-\x{06FF}]')} / greatest(len(text), 1) < 0.1 AND {sql_count('text', '[a-z]')} / greatest(len(text), 1) < 0.15
  AND {sql_count('text', r'[0-9/\\(),;:]')} / greatest(len(text), 1) > 0.15))"""


@query(
    f"""WITH {FUSED}, h AS (SELECT item_id, doc_id, rrf, rank, text, source, {SQL_GARBAGE} AS bad FROM fr JOIN documents USING (doc_id) WHERE rank <= 10),
    k AS (SELECT *, min(CAST(bad AS INTEGER)) OVER (PARTITION BY item_id) AS all_bad FROM h)
    SELECT item_id, md5(string_agg('[Source: ' || source || ' | Page: 1]' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS context_md5, round(max(rrf), 6) AS top_rrf,
    count(*) AS n_chunks, max(rrf) < 0.002 AS out_of_scope FROM k WHERE (NOT bad OR all_bad = 1) AND rank <= 5 GROUP BY item_id"""
)
def hybrid_retrieve(spark, sf):
    """Flagship: two ranked lists, fusion, garbage filter with fallback, context in rank order, out-of-scope gate."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source", F.lit(1).alias("page"))
    hits = index.with_documents(_fused(spark, sf).where(F.col("rank") <= lx.RETRIEVE_K), docs, "doc_id")
    out = index.context_of(index.drop_garbage(hits, F.col("text"), "item_id"), "item_id")
    return out.select("item_id", F.md5("context").alias("context_md5"), r6("top_rrf").alias("top_rrf"), "n_chunks", "out_of_scope")


@query(
    f"""WITH {BM25}, v AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    f AS (SELECT v.item_id, min(rank) AS first_rank FROM v LEFT JOIN ranked r ON r.item_id = v.item_id AND r.doc_id = v.doc_id AND rank <= 10 GROUP BY v.item_id)
    SELECT count(*) AS n_items, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr, round(avg(CASE WHEN first_rank IS NULL THEN 0 ELSE 1 END), 6) AS recall_at_10 FROM f"""
)
def retrieval_mrr(spark, sf):
    """Reciprocal rank of documents that hold a benchmark passage verbatim; candidates share the passage's rarest token."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    tokens = lambda df, i: df.select(i, "text", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("term"))
    held = tokens(docs, "doc_id").select("doc_id", "term")
    df = held.groupBy("term").count()
    inner = tokens(items.withColumn("text", F.regexp_replace("text", r"^\S+|\S+$", " ")), "item_id").select("item_id", "term").where("term <> ''")
    rarest = inner.join(df, "term").groupBy("item_id").agg(F.min_by("term", F.struct("count", "term")).alias("term"))
    pairs = held.join(rarest, "term").join(items.select("item_id", F.col("text").alias("passage")), "item_id").join(docs.select("doc_id", "text"), "doc_id")
    verbatim = pairs.where(F.contains("text", "passage")).select("item_id", "doc_id")
    ranks = verbatim.join(_bm25(spark, sf).select("item_id", "doc_id", "rank"), ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.min("rank").alias("first_rank"))
    return ranks.agg(
        F.count("*").alias("n_items"), r6(F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))).alias("mrr"), r6(F.avg(F.col("first_rank").isNotNull().cast("double"))).alias("recall_at_10")
    )


@query(f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def token_stats(spark, sf):
    """Document and corpus frequencies of every token."""
    p = index.postings(table(spark, sf, "documents"), t.french_tokens(F.col("text")), "doc_id")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"SELECT lang, count(*) AS n, round(avg(len({sql_tokens('text')})), 6) AS avg_tokens, CAST(max(len({sql_tokens('text')})) AS INTEGER) AS max_tokens FROM documents GROUP BY lang")
def doc_length_stats(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.size(t.french_tokens(F.col("text"))).alias("n"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), r6(F.avg("n")).alias("avg_tokens"), F.max("n").alias("max_tokens"))


_AR, _LA = sql_count("text", r"[\x{0600}-\x{06FF}]"), sql_count("text", "[A-Za-z]")


@query(
    rf"""SELECT CASE WHEN {_AR} / greatest(n, 1) > 0.55 THEN 'arabic_msa' WHEN {_LA} / greatest(n, 1) > 0.65 THEN 'french'
    WHEN {_AR} / greatest(n, 1) > 0.2 AND {_LA} / greatest(n, 1) > 0.2 THEN 'mixed' ELSE 'arabic_msa' END AS language, count(*) AS n FROM (SELECT text, {sql_count('text', r'[^\s]')} AS n FROM documents) GROUP BY 1"""
)
def chunk_by_language(spark, sf):
    return table(spark, sf, "documents").select(t.chunk_language(F.col("text")).alias("language")).groupBy("language").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {SQL_GARBAGE} AS garbage FROM documents")
def garbage_filter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.is_garbage(F.col("text")).alias("garbage"))


@query("SELECT CASE WHEN regexp_matches(url, '^(?i)https?://') THEN regexp_extract(url, '^(?i:https?)://([^/]+)', 1) ELSE url END AS source, count(*) AS n FROM pages GROUP BY 1")
def short_source_counts(spark, sf):
    return table(spark, sf, "pages").select(t.short_source(F.col("url")).alias("source")).groupBy("source").agg(F.count("*").alias("n"))


@query()
def html_sections(spark, sf):
    """Headed sections of at least 10 words."""
    return files.sections_of(table(spark, sf, "pages"), 10).select("page_id", "ord", "heading", F.md5("body").alias("body_md5"), t.n_words(F.col("body")).alias("n_words"))


@query(r"""SELECT page_id, CASE WHEN l IN ('ar', 'fr') THEN l ELSE '' END AS lang_hint FROM (SELECT page_id, lower(regexp_extract(html, '(?i)<html[^>]*\blang=["'']?([a-zA-Z]{2})', 1)) AS l FROM pages)""")
def html_lang_hint(spark, sf):
    return table(spark, sf, "pages").select("page_id", files.html_language(F.col("html")).alias("lang_hint"))


@query(
    r"""SELECT page_id, count(*) AS n_links, count(*) FILTER (WHERE regexp_matches(lower(href), '\.pdf([?#].*)?$')) AS n_pdf FROM
    (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?href=["'']([^"'']+)["'']', 1)) AS href FROM pages) GROUP BY page_id"""
)
def page_links(spark, sf):
    """Links and PDF links of each page that has any."""
    found = table(spark, sf, "pages").select("page_id", F.explode(files.links(F.col("html"))).alias("href"))
    return found.groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_if(F.lower("href").rlike(r"\.pdf([?#].*)?$")).alias("n_pdf"))


_CRAWLED = r"""l AS (SELECT DISTINCT url AS src, regexp_extract(url, '^(https?://[^/]+)', 1) || href AS dst FROM (SELECT url, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?href=["'']([^"'']+)["'']', 1)) AS href FROM pages)
      WHERE starts_with(href, '/') AND NOT regexp_matches(lower(href), '(""" + "|".join(x.replace(".", "\\.") for x in lx.SKIP_SUFFIXES) + r""")([?#].*)?$')),
    r(url, depth) AS (SELECT min(url), 0 FROM pages GROUP BY regexp_extract(url, '^(?i:https?)://([^/]+)', 1) UNION SELECT dst, depth + 1 FROM r JOIN l ON src = r.url WHERE depth < 3),
    c AS (SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY url)"""


def _crawl(spark, sf, per_host=None):
    pages = table(spark, sf, "pages")
    hrefs = pages.select("url", F.explode(files.links(F.col("html"))).alias("href"))
    edges = hrefs.select(F.col("url").alias("src"), files.absolute(F.col("url"), F.col("href")).alias("dst"))
    seeds = pages.groupBy(t.short_source(F.col("url")).alias("host")).agg(F.min("url").alias("url"))
    return files.crawl(edges, seeds, 3, Scratch(spark, "crawl"), per_host)


@query(f"WITH RECURSIVE {_CRAWLED} SELECT url, depth FROM c")
def crawl_depths(spark, sf):
    """Pages within three links of each host's root, over the pages' own links."""
    return _crawl(spark, sf)


@query(
    f"""WITH RECURSIVE {_CRAWLED}, o AS (SELECT *, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/]+)', 1)
      ORDER BY depth, NOT list_bool_or(list_transform({sql_strings(lx.FOLLOW_WORDS)}, lambda w: contains(lower(url), w))), url) AS r FROM c) SELECT url, depth FROM o WHERE r <= 4"""
)
def crawl_budget(spark, sf):
    """The same with a budget of four pages a host."""
    return _crawl(spark, sf, 4)


@query(
    rf"""SELECT doc_id, 1 AS n_sections, md5(trim(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS body_md5 FROM documents WHERE len({sql_words('text')}) >= 10"""
)
def sectioned_text_roundtrip(spark, sf):
    """Documents written as sections and parsed back."""
    d = table(spark, sf, "documents").where(t.n_words(F.col("text")) >= files.MIN_SECTION_WORDS)
    text = files.render_section(F.lit("T"), F.concat(F.lit("https://x/"), F.col("doc_id").cast("string")), F.col("text"))
    s = d.select("doc_id", files.parse_sections(text, F.lit("f")).alias("s")).where(F.size("s") > 0)
    return s.select("doc_id", F.size("s").alias("n_sections"), F.md5(F.regexp_replace(F.col("s")[0]["body"], r"^\s+|\s+$", "")).alias("body_md5"))


@query(r"""SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[.!?\n]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')) AS INTEGER) AS n_sentences FROM documents""")
def sentence_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(t.sentences(F.col("text"), F.lit(False))).alias("n_sentences"))


@query()
def sentence_pack_chunks(spark, sf):
    """Chunks of documents, with a global ordinal."""
    out = chunking.number_chunks(chunking.chunk_pages(table(spark, sf, "documents")))
    return out.select("chunk_id", "ord", "doc_id", "seg", "pos", "language", "lang_bucket", t.n_words(F.col("text")).alias("n_words"), F.md5("text").alias("text_md5"))


@query()
def deloop(spark, sf):
    """Texts after repeated words and lines are collapsed (back-references)."""
    return table(spark, sf, "documents").select("doc_id", F.md5(t.deloop(F.col("text"))).alias("text_md5"))


@query(
    rf"""SELECT doc_id, CASE WHEN n = 0 THEN 'none' WHEN a / n > 0.6 THEN 'arabic' WHEN a / n < 0.2 THEN 'latin' ELSE 'mixed' END AS script FROM
    (SELECT doc_id, {sql_count('text', r'\p{L}')} AS n, {sql_count('text', r'[\x{0620}-\x{064A}\x{066E}-\x{06D3}]')} AS a FROM documents)"""
)
def script_of(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.script_of(F.col("text")).alias("script"))


_VOTE = sql_count("text", r"[^\s0-9]")


@query(
    rf"""SELECT doc_id, CASE WHEN n < 3 THEN 'unknown' WHEN a > 0.55 THEN 'arabic_msa' WHEN b > 0.65 THEN 'french' WHEN a > b THEN 'arabic_msa' ELSE 'french' END AS language,
    round(CASE WHEN n < 3 THEN 0 WHEN a > 0.55 THEN least(1, (a - 0.55) / 0.45 + 0.5) WHEN b > 0.65 THEN least(1, (b - 0.65) / 0.35 + 0.5) ELSE 0.4 END, 6) AS confidence FROM
    (SELECT doc_id, n, ar / greatest(n, 1) AS a, la / greatest(n, 1) AS b FROM (SELECT doc_id, {_VOTE} AS n, {_AR} AS ar, {_LA} AS la FROM documents))"""
)
def lang_script_vote(spark, sf):
    v = table(spark, sf, "documents").select("doc_id", la.script_vote(F.col("text")).alias("v"))
    return v.select("doc_id", "v.language", r6("v.confidence").alias("confidence"))


@query(
    rf"""SELECT conv_id, turn, CASE WHEN a >= l AND a > 0 THEN CASE WHEN list_bool_or(list_transform({sql_strings(lx.DARIJA_MARKERS)}, lambda x: contains(text, x))) THEN 'Darija' ELSE 'arabic_msa' END
    WHEN l > 0 THEN CASE WHEN regexp_matches(text, '{la.ARABIZI_DIGIT}') OR list_has_any(string_split_regex(lower(text), '[^a-z0-9]+'), {sql_strings(lx.ARABIZI_MARKERS)}) THEN 'Arabizi' ELSE 'french' END
    ELSE 'unknown' END AS language FROM (SELECT *, {_AR} AS a, {_LA} AS l FROM conversations)"""
)
def script_marker_language(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", la.script_marker_language(F.col("text")).alias("language"))


@query()
def multihop_votes(spark, sf):
    """Five signs of a multi-hop question (look-around)."""
    v = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", la.multihop(F.col("text")).alias("v"))
    return v.select("conv_id", "turn", "v.votes", "v.is_multihop", "v.hop_count")


def _sql_any(c, arabic, french):
    has = lambda x, items: f"list_bool_or(list_transform({sql_strings(items)}, lambda k: contains({x}, k)))"
    return f"({has(c, arabic)} OR {has(f'lower({c})', french)})"


@query(f"SELECT conv_id, turn, {_sql_any('text', lx.OOS_ARABIC, lx.OOS_FRENCH)} AS oos, {_sql_any('text', lx.LEGAL_ARABIC, lx.LEGAL_FRENCH)} AS legal FROM conversations")
def oos_keywords(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", la.is_out_of_scope(F.col("text")).alias("oos"), la.is_legal(F.col("text")).alias("legal"))


@query(
    r"""SELECT conv_id, turn, 'DATE' AS type, unnest(regexp_extract_all(text, '\b20[0-9]{2}\b')) AS entity FROM conversations
    UNION ALL SELECT conv_id, turn, 'DATE', unnest(regexp_extract_all(text, '\b[0-9]{1,2}[/-][0-9]{1,2}[/-]20[0-9]{2}\b')) FROM conversations
    UNION ALL SELECT conv_id, turn, 'AMOUNT', trim(unnest(regexp_extract_all(text, '(?i)\b[0-9]+(?:[,.][0-9]+)?\s*(?:MAD|DH|dirhams?)'))) FROM conversations
    UNION ALL SELECT conv_id, turn, 'AMOUNT', trim(unnest(regexp_extract_all(text, '(?i)(?:dirhams?)\s*[0-9]+(?:[,.][0-9]+)?\b'))) FROM conversations
    UNION ALL SELECT conv_id, turn, 'DURATION', trim(unnest(regexp_extract_all(text, '(?i)\b[0-9]+\s*(?:jours?|semaines?|mois|ans?|années?|heures?|days?|weeks?|months?|years?|hours?)\b'))) FROM conversations
    UNION ALL SELECT conv_id, turn, 'LEGAL_REF', trim(unnest(regexp_extract_all(text, '(?i)(?:décret|loi|arrêté|dahir|circulaire)\s*(?:royal\s*)?n\s*[°ºo]?\s*[0-9][0-9./\-]*'))) FROM conversations
    UNION ALL SELECT conv_id, turn, 'LOCATION', city FROM conversations, (SELECT unnest("""
    + sql_strings(lx.CITIES)
    + ") AS city) WHERE contains(text, city)"
)
def entity_extract(spark, sf):
    """Dates, amounts, places, durations and legal references, as a bag."""
    found = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(g.entities(F.col("text"))).alias("e"))
    return found.select("conv_id", "turn", "e.type", "e.entity")


_CW = rf"list_distinct(list_filter(string_split_regex(regexp_replace(lower(answer), '[^\p{{L}}\p{{N}}_\s\x{{0600}}-\x{{06FF}}]', '', 'g'), '\s+'), lambda w: w <> ''))"
_CLAIM = f"list_filter({_CW}, lambda w: len(w) > 2 AND NOT list_contains({sql_strings(lx.CLAIM_STOPWORDS)}, w))"
_OVERLAP = f"""o AS (SELECT conv_id, turn, CASE WHEN len({_CLAIM}) = 0 THEN 1.0 ELSE len(list_intersect({_CLAIM}, {_CW.replace('answer', 'question')})) / len({_CLAIM}) END AS overlap FROM turns)"""


@query(f"WITH {TURNS}, {_OVERLAP} SELECT conv_id, turn, round(overlap, 6) AS overlap, overlap >= 0.3 AS grounded FROM o")
def claims_overlap(spark, sf):
    """An answer as one claim against the turn before it."""
    o = turns(spark, sf).select("conv_id", "turn", g.overlap_share(F.col("answer"), F.col("question")).alias("o"))
    return o.select("conv_id", "turn", r6("o").alias("overlap"), (F.col("o") >= lx.CLAIM_GROUNDED).alias("grounded"))


@query(
    f"""WITH {TURNS}, {_OVERLAP}, c AS (SELECT conv_id, turn, overlap, round((0.5 * overlap + 0.2 * 1.0) / 0.7, 4) AS cfi FROM o)
    SELECT conv_id, turn, round(cfi, 4) AS cfi, overlap >= 0.8 AND cfi >= 0.7 AS grounded FROM c"""
)
def grounded_decision(spark, sf):
    """Fidelity and decision of an answer's claim share, without entities, with a verified chain."""
    o = turns(spark, sf).select("conv_id", "turn", g.overlap_share(F.col("answer"), F.col("question")).alias("o"))
    c = o.withColumn("cfi", g.fidelity(F.col("o"), F.lit(1.0), F.lit(0), F.lit(True)))
    return c.select("conv_id", "turn", "cfi", g.is_grounded(F.col("o"), F.lit(1.0), F.col("cfi")).alias("grounded"))


@query()
def verify_answers(spark, sf):
    """Claims by sentence, entities and citations of every answer against the turn before it, as one audit row."""
    a = turns(spark, sf).withColumn("claims", g.split_claims(F.col("answer"))).withColumn("found", g.entities(F.col("answer")))
    shares = F.transform("claims", lambda c: (g.overlap_share(c, F.col("question")) >= lx.CLAIM_GROUNDED).cast("int"))
    ratio = F.coalesce(F.try_divide(F.aggregate(shares, F.lit(0), lambda x, y: x + y), F.size("claims")), F.lit(0.0))
    a = a.withColumn("claim_ratio", ratio).withColumn("entity_ratio", g.entity_match_ratio(F.col("found"), F.col("question")))
    a = a.withColumn("cfi", g.fidelity(F.col("claim_ratio"), F.col("entity_ratio"), F.size("found"), F.lit(True)))
    return a.select(
        "conv_id", "turn", F.size("claims").alias("n_claims"), F.size("found").alias("n_entities"), r6("claim_ratio").alias("claim_ratio"), r6("entity_ratio").alias("entity_ratio"),
        "cfi", g.is_grounded(F.col("claim_ratio"), F.col("entity_ratio"), F.col("cfi")).alias("grounded"),
        F.array_join(g.warnings(F.col("claim_ratio"), F.col("entity_ratio"), F.col("cfi")), ",").alias("warnings"), F.md5(g.clean_answer(F.col("answer"))).alias("answer_md5"),
    )


_A, _Q = sql_metric_tokens(sql_strip("answer")), sql_metric_tokens("question")


@query(
    f"""WITH {TURNS}, s AS (SELECT conv_id, turn, list_distinct({_A}) AS a, list_distinct({_Q}) AS q, {sql_norm(sql_strip('answer'))} = {sql_norm('question')} AS em FROM turns)
    SELECT conv_id, turn, CASE WHEN len(a) + len(q) = 0 THEN 0.0 ELSE round(2 * len(list_intersect(a, q)) / (len(a) + len(q)), 6) END AS token_f1, CAST(em AS DOUBLE) AS exact_match FROM s"""
)
def lexical_scores(spark, sf):
    """Token F1 and exact match of an answer with the turn before it."""
    a, q = F.col("answer"), F.col("question")
    return turns(spark, sf).select("conv_id", "turn", r6(m.token_f1(a, q)).alias("token_f1"), m.exact_match(a, q).alias("exact_match"))


@query()
def rouge_l(spark, sf):
    a, q = F.col("answer"), F.col("question")
    return turns(spark, sf).select("conv_id", "turn", r6(m.rouge_l(m.metric_tokens(t.strip_citations(a)), m.metric_tokens(q))).alias("rouge_l"))


def _sql_arabizi(c):
    out = rf"regexp_replace(regexp_replace(translate(lower({c}), '372985', 'ahqakh'), '[0-9]', '', 'g'), '[^a-z]+', ' ', 'g')"
    for letter in "abcdefghijklmnopqrstuvwxyz":
        out = f"regexp_replace({out}, '{letter}+', '{letter}', 'g')"
    return f"list_distinct(list_filter(string_split(regexp_replace({out}, '[aeiouy]', '', 'g'), ' '), lambda x: len(x) >= 2))"


@query(
    f"""WITH {TURNS}, s AS (SELECT conv_id, turn, {_sql_arabizi('answer')} AS a, {_sql_arabizi('question')} AS q FROM turns)
    SELECT conv_id, turn, round(coalesce(2.0 * len(list_intersect(a, q)) / nullif(len(a) + len(q), 0), 0), 6) AS arabizi_f1 FROM s"""
)
def arabizi_f1(spark, sf):
    a, q = F.col("answer"), F.col("question")
    return turns(spark, sf).select("conv_id", "turn", r6(m.arabizi_f1(a, q)).alias("arabizi_f1"))


@query(
    f"""WITH {FUSED}, c AS (SELECT item_id, list(text ORDER BY rank) AS c FROM fr JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY item_id),
    s AS (SELECT item_id, list_transform(c, lambda x: list_distinct({sql_metric_tokens('x')})) AS s FROM c),
    p AS (SELECT item_id, CASE WHEN len(s) < 2 THEN 0.0 ELSE list_avg(list_transform(range(1, len(s)), lambda i: CASE WHEN len(list_distinct(list_concat(s[i], s[i + 1]))) = 0 THEN 0
      ELSE len(list_intersect(s[i], s[i + 1])) / len(list_distinct(list_concat(s[i], s[i + 1]))) END)) END AS redundancy FROM s)
    SELECT item_id, round(redundancy, 6) AS redundancy, round(len(list_intersect(list_distinct({sql_metric_tokens('b.text')}), list_distinct(flatten(s.s)))) / len(list_distinct(flatten(s.s))), 6) AS utilisation
    FROM p JOIN s USING (item_id) JOIN benchmark b USING (item_id)"""
)
def context_metrics(spark, sf):
    """Redundancy of retrieved contexts and how much of them the passage uses."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    top = index.with_documents(_fused(spark, sf).where(F.col("rank") <= lx.FINAL_K), docs, "doc_id")
    c = top.groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("contexts"))
    c = c.join(table(spark, sf, "benchmark"), "item_id")
    return c.select("item_id", r6(m.context_redundancy(F.col("contexts"))).alias("redundancy"), r6(m.utilisation(F.col("text"), F.col("contexts"))).alias("utilisation"))


@query(
    rf"""WITH {TURNS}, s AS (SELECT conv_id, turn, list_distinct(regexp_extract_all({sql_strip('answer')}, '\b[0-9][0-9,.]*\b')) AS a, list_distinct(regexp_extract_all(question, '\b[0-9][0-9,.]*\b')) AS q FROM turns)
    SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN 0.0 ELSE round(len(list_filter(a, lambda x: NOT list_contains(q, x))) / len(a), 6) END AS rate FROM s"""
)
def invented_numbers(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", r6(m.invented_numbers(F.col("answer"), F.col("question"))).alias("rate"))


@query(
    f"""WITH p AS (SELECT NOT {SQL_GARBAGE} AND len({sql_words('text')}) >= 20 AS p, quality = 1 AS a FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE p AND NOT a) AS fp, count(*) FILTER (WHERE NOT p AND a) AS fn, count(*) FILTER (WHERE NOT p AND NOT a) AS tn FROM p)
    SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy FROM c"""
)
def confusion_quality(spark, sf):
    """Labelled quality against not garbage and at least 20 words."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    out = evaluate.confusion(d, ~t.is_garbage(F.col("text")) & (t.n_words(F.col("text")) >= 20), F.col("quality") == 1)
    return out.select("tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query(
    """SELECT event_type, pct, round(v[least(CAST(floor(len(v) * pct / 100) AS INTEGER) + 1, len(v))], 6) AS value FROM
    (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type), (VALUES (50), (95), (99)) p(pct)"""
)
def latency_percentiles(spark, sf):
    """Nearest-rank percentiles of values by event type."""
    return evaluate.nearest_rank(table(spark, sf, "events"), ["event_type"], "value", [50, 95, 99]).withColumn("value", r6("value"))


@query(
    """SELECT 'all' AS dim, NULL AS dim_value, count(*) AS n, round(avg(n_chars), 6) AS avg_chars FROM documents UNION ALL
    SELECT 'lang', lang, count(*), round(avg(n_chars), 6) FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*), round(avg(n_chars), 6) FROM documents GROUP BY source"""
)
def breakdown_by_lang_source(spark, sf):
    return evaluate.breakdown(table(spark, sf, "documents"), ["lang", "source"], avg_chars=r6(F.avg("n_chars")))


@query(
    """WITH s AS (SELECT event_type AS system, user_id AS item, avg(value) AS v FROM events GROUP BY ALL)
    SELECT x.system AS a, y.system AS b, round(avg(CASE WHEN x.v > y.v THEN 1.0 WHEN x.v = y.v THEN 0.5 ELSE 0.0 END), 6) AS win_rate, count(*) AS n FROM s x JOIN s y USING (item) GROUP BY 1, 2"""
)
def win_rate_matrix(spark, sf):
    """Event types as systems, users as items."""
    s = table(spark, sf, "events").groupBy(F.col("event_type").alias("system"), F.col("user_id").alias("item")).agg(F.avg("value").alias("v"))
    return evaluate.win_rates(s, "system", "item", "v").withColumn("win_rate", r6("win_rate"))


@query(
    """WITH s AS (SELECT event_type AS system, unnest(['mean', 'max', 'n']) AS metric, unnest([avg(value), max(value), CAST(count(*) AS DOUBLE)]) AS value FROM events GROUP BY event_type),
    t AS (SELECT *, CASE WHEN metric = 'n' THEN -value ELSE value END AS sv FROM s)
    SELECT system, metric, round(value, 6) AS value, sv >= max(sv) OVER (PARTITION BY metric) - 1e-6 AS is_best FROM t"""
)
def best_per_metric(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("system")).agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.count("*").cast("double").alias("n"))
    return evaluate.best_per_metric(e.unpivot(["system"], ["mean", "max", "n"], "metric", "value"), F.col("metric") != "n").withColumn("value", r6("value"))


@query(
    """WITH p AS (SELECT source, lang, avg(n_chars / 10000.0) AS v FROM documents GROUP BY ALL)
    SELECT x.lang AS lang_a, y.lang AS lang_b, round(avg(1 - abs(x.v - y.v)), 6) AS consistency, count(*) AS n FROM p x JOIN p y ON x.source = y.source AND x.lang < y.lang GROUP BY 1, 2"""
)
def cross_lingual_pairs(spark, sf):
    d = table(spark, sf, "documents").withColumn("v", F.col("n_chars") / 10000.0)
    return evaluate.consistency(d, "source", "lang", "v").withColumn("consistency", r6("consistency"))


@query("SELECT source FROM documents WHERE lang IN ('en', 'fr', 'de', 'es') GROUP BY source HAVING count(DISTINCT lang) = 4")
def relational_division(spark, sf):
    return curate.divides(table(spark, sf, "documents"), "source", "lang", ["en", "fr", "de", "es"])


CLASSES = f"""c0 AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct({sql_metric_tokens('text')})) AS tk FROM documents),
c AS MATERIALIZED (SELECT min(doc_id) AS doc_id, tk FROM c0 WHERE len(tk) > 0 GROUP BY tk),
e AS (SELECT doc_id, len(tk) AS n, unnest(tk) AS w FROM c),
near AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) / greatest(any_value(x.n), any_value(y.n)) AS overlap FROM e x JOIN e y ON x.w = y.w AND x.doc_id < y.doc_id GROUP BY 1, 2)"""


def _near(spark, sf):
    sets = curate.token_sets(table(spark, sf, "documents"), "doc_id", F.col("text"))
    classes = curate.set_classes(sets, "doc_id")
    firsts = curate.class_sets(sets, classes, "doc_id")
    return sets, classes, firsts, curate.overlap_pairs(firsts, "doc_id")


@query(f"WITH {CLASSES} SELECT a, b, round(overlap, 6) AS overlap FROM near WHERE overlap >= 0.85")
def near_dup_pairs(spark, sf):
    """Pairs of distinct token sets that overlap by 0.85 of the larger one; ``near_dup_members`` has the rows of each set."""
    return _near(spark, sf)[3].select("a", "b", r6("overlap").alias("overlap"))


@query(
    f"""WITH c0 AS (SELECT doc_id, list_sort(list_distinct({sql_metric_tokens('text')})) AS tk FROM documents)
    SELECT doc_id, CASE WHEN len(tk) > 0 THEN min(doc_id) OVER (PARTITION BY tk) END AS class_id FROM c0"""
)
def near_dup_members(spark, sf):
    """The token set of every row, named by its first row: membership for ``near_dup_pairs``."""
    sets = curate.token_sets(table(spark, sf, "documents"), "doc_id", F.col("text"))
    return sets.join(curate.set_classes(sets, "doc_id"), "key", "left").select("doc_id", F.col("first").alias("class_id"))


@query(
    f"""WITH RECURSIVE {CLASSES}, b AS (SELECT b AS id, list(a) AS before FROM near WHERE overlap >= 0.85 - 1e-12 GROUP BY b),
    o AS (SELECT id, before, row_number() OVER (ORDER BY id) AS i FROM b),
    g(i, dropped) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
      SELECT o.i, CASE WHEN len(list_filter(o.before, lambda x: NOT list_contains(g.dropped, x))) > 0 THEN list_append(g.dropped, o.id) ELSE g.dropped END FROM g JOIN o ON o.i = g.i + 1),
    last AS (SELECT dropped FROM g ORDER BY i DESC LIMIT 1)
    SELECT doc_id, len(tk) = 0 OR (doc_id = min(doc_id) OVER (PARTITION BY tk) AND NOT list_contains(dropped, doc_id)) AS kept FROM c0, last"""
)
def near_dup_greedy(spark, sf):
    """Order-dependent removal: dropped items don't drop others."""
    sets, classes, firsts, pairs = _near(spark, sf)
    return curate.kept_rows(sets, classes, "doc_id", curate.greedy_keep(firsts, pairs, "doc_id"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY trim(text)")
def exact_dedup(spark, sf):
    return curate.exact_dedup(table(spark, sf, "documents"), "doc_id", F.col("text"))


@query(
    """SELECT c_custkey, CASE WHEN n.o_custkey IS NULL THEN c_name ELSE 'updated' END AS c_name, CASE WHEN n.o_custkey IS NULL THEN round(c_acctbal, 2) ELSE round(n.total, 2) END AS c_acctbal
    FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) n ON c_custkey = o_custkey"""
)
def merge_upsert(spark, sf):
    """Customers with orders are replaced by rows of their totals."""
    old = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.lit("updated").alias("c_name"), F.sum("o_totalprice").alias("c_acctbal"))
    return curate.upsert(old, new, "c_custkey").withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, sf):
    return curate.resume(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('s' || CAST(doc_id AS VARCHAR))) AS r FROM documents) WHERE r <= 28")
def stratified_sample(spark, sf):
    """28 documents of each language by hash order (a sampling operator)."""
    return curate.stratified_sample(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], F.col("doc_id"), 28, "s")


@query("SELECT doc_id, upper(lang[1]) || CAST(row_number() OVER (PARTITION BY upper(lang[1]) ORDER BY doc_id) AS VARCHAR) AS item_key FROM documents")
def next_ids(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.upper("lang").alias("category"))
    return curate.next_ids(d, "category", ["doc_id"]).select("doc_id", "item_key")


@query()
def memory_bounded(spark, sf):
    """Bounded memory fed with each passage's hits in rank order."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    hits = _fused(spark, sf).join(docs, "doc_id").select("item_id", F.col("doc_id").cast("string").alias("chunk_id"), "source", "text", F.col("rrf").alias("score"), "rank")
    return agent.memory(hits, query_col="item_id", order=["rank"]).withColumn("score", r6("score"))


@query(
    """WITH RECURSIVE d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderkey % 31 AS INTEGER) AS n FROM orders),
    w AS (SELECT o_orderkey, s, n, unnest(range(1, 60)) AS k FROM d), b AS (SELECT o_orderkey, n, s + CAST(k AS INTEGER) AS day, row_number() OVER (PARTITION BY o_orderkey ORDER BY k) AS r FROM w WHERE isodow(s + CAST(k AS INTEGER)) < 6)
    SELECT d.o_orderkey, CAST(coalesce(b.day, d.s) AS DATE) AS due FROM d LEFT JOIN b ON d.o_orderkey = b.o_orderkey AND b.r = d.n"""
)
def deadline_workdays(spark, sf):
    """Order dates plus 0 to 30 working days."""
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("s"), (F.col("o_orderkey") % 31).cast("int").alias("n"))
    return o.select("o_orderkey", t.add_workdays(F.col("s"), F.col("n")).alias("due"))


@query(
    rf"""SELECT doc_id, round(CASE WHEN list_bool_or(list_transform({sql_strings(lx.ELIGIBILITY_WORDS)}, lambda k: contains(text, k))) THEN CAST(0.65 AS DOUBLE) ELSE 0.5 END, 6) AS eligibility,
    round(CASE WHEN list_bool_or(list_transform(regexp_extract_all(text, '(?i)([0-9][0-9\s]*)\s*(?:درهم|DH|MAD|dirhams?)', 1), lambda x: coalesce(TRY_CAST(regexp_replace(x, '\s', '', 'g') AS BIGINT) BETWEEN 0 AND 100000, false))) THEN CAST(0.7 AS DOUBLE) ELSE 0.5 END, 6) AS amount FROM documents"""
)
def tool_boosts(spark, sf):
    """Eligibility and amount boosts on a score of one half."""
    text, half = F.col("text"), F.lit(0.5)
    return table(spark, sf, "documents").select("doc_id", r6(agent.eligibility_boost(text, half)).alias("eligibility"), r6(agent.amount_boost(text, half)).alias("amount"))


@query(
    f"""WITH {TURNS} SELECT conv_id, turn, contains(lower(answer), 'not available') OR list_bool_or(list_transform({sql_strings(lx.ABSTAIN_MARKERS)}, lambda k: contains(lower(answer), k))) AS abstains,
    md5({sql_strip('answer')}) AS bare_md5 FROM turns"""
)
def abstain_markers(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", t.has_abstain_marker(F.col("answer")).alias("abstains"), F.md5(t.strip_citations(F.col("answer"))).alias("bare_md5"))


for _name, (_run, _sql) in relational.PACK.items():
    QUERIES[_name] = _run
    ORACLES[_name] = _sql


from . import suites  # noqa: E402, F401  it registers more queries
