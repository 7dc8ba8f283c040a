"""Readers and writers: sectioned text, HTML pages, JSON sets, indexes, audits."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import lexicon as lx
from ..functions.text import n_words

RULE = "-" * 60
SECTION = StructType([StructField("heading", StringType()), StructField("body", StringType())])
MIN_SECTION_WORDS = 10


def parse_sections(text: Column, fallback_source: Column) -> Column:
    """array of struct(title, source, body) of a sectioned text; a text without one is a section of its own."""
    header = lambda part, name: F.trim(F.regexp_extract(part, rf"(?m)^{name}: (.*)$", 1))
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    body = lambda part: bare(F.regexp_replace(part, r"(?m)^(Title: .*|URL: .*|---)$\n?", ""))
    parts = F.transform(
        F.split(text, RULE),
        lambda p: F.struct(
            header(p, "Title").alias("title"), F.coalesce(F.nullif(header(p, "URL"), F.lit("")), fallback_source).alias("source"), body(p).alias("body")
        ),
    )
    kept = F.filter(parts, lambda s: n_words(s["body"]) >= MIN_SECTION_WORDS)
    whole = F.array(F.struct(F.lit("").alias("title"), fallback_source.alias("source"), bare(text).alias("body")))
    return F.when(F.size(kept) > 0, kept).when(n_words(text) >= MIN_SECTION_WORDS, whole).otherwise(F.slice(kept, 1, 0))


def render_section(title: Column, url: Column, body: Column) -> Column:
    return F.concat(F.lit("Title: "), title, F.lit("\nURL: "), url, F.lit("\n---\n"), body, F.lit(f"\n{RULE}\n"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, title, text) of sectioned text files below a folder."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").withColumn("file", F.input_file_name())
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return raw.select(F.explode(parse_sections(F.col("value"), stem)).alias("s")).select("s.source", "s.title", F.col("s.body").alias("text"))


def read_items(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON array of items, or an object that holds one in ``items``."""
    root = StructType([*schema.fields, StructField("items", ArrayType(schema))])
    raw = spark.read.schema(root).json(path, multiLine=True)
    nested = raw.where(F.col("items").isNotNull()).select(F.inline("items"))
    return raw.where(F.col("items").isNull()).select(*schema.names).unionByName(nested)


def write_index(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").partitionBy("lang_bucket").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_audits(audits: DataFrame, path: str) -> None:
    """Audits of a run (``operators.verify.audit_rows``), a row per answer, behind those under ``path``; one folder per day."""
    audits.withColumn("day", F.current_date()).write.mode("append").partitionBy("day").parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    flat = df.select(*[F.translate(F.col(c).cast("string"), "\t\n", "  ").alias(c) for c in df.columns])
    flat.write.mode("overwrite").csv(path, sep="\t", header=True)


class _Sections(HTMLParser):
    """Headed sections of a page's content; list items inside paragraphs count for both, as text of descendants does."""

    SKIP = {"nav", "header", "footer", "aside", "script", "style", "noscript", "form", "iframe"}
    HEADS, TEXT = {"h2", "h3", "h4"}, {"p", "li", "td", "dd"}
    VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.open, self.title, self.h1, self.lang = 0, [], "", "", ""
        self.sections, self.head, self.parts = [], None, []

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            self.lang = dict(attrs).get("lang") or ""
        if tag in self.SKIP:
            self.skip += 1
        if tag in self.VOID:
            return
        if tag in self.HEADS and not self.skip:
            self.flush()
        self.open.append([tag, ""])

    def handle_endtag(self, tag):
        if tag in self.SKIP and self.skip:
            self.skip -= 1
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            name, text = self.open.pop()
            self.close_one(name, " ".join(text.split()))
            if name == tag:
                break

    def close_one(self, tag, text):
        if tag == "title":
            self.title = self.title or text
        elif self.skip or not text:
            return
        elif tag == "h1":
            self.h1 = self.h1 or text
        elif tag in self.HEADS:
            self.head = text
        elif tag in self.TEXT:
            self.parts.append(text)

    def handle_data(self, data):
        if not self.skip:
            for frame in self.open:
                frame[1] += data

    def flush(self):
        if self.parts:
            self.sections.append((self.head or self.h1 or self.title, "\n".join(self.parts)))
        self.parts, self.head = [], None

    def done(self):
        while self.open:
            self.close_one(*(lambda f: (f[0], " ".join(f[1].split())))(self.open.pop()))
        self.flush()
        return self.sections


def html_sections(html: str | None, least: int = 80) -> list[tuple[str, str]]:
    """(heading, body) of sections with enough words; one of the whole content if none has them."""
    parser = _Sections()
    parser.feed(html or "")
    found = parser.done()
    kept = [s for s in found if len(s[1].split()) >= least]
    whole = "\n".join(b for _, b in found)
    if not kept and len(whole.split()) >= least:
        kept = [(parser.h1 or parser.title, whole)]
    return kept


def sections_of(pages: DataFrame, least: int = 80) -> DataFrame:
    """(page_id, url, ord, heading, body)."""

    def run(html: pd.Series) -> pd.Series:
        return html.map(lambda h: [{"heading": a, "body": b} for a, b in html_sections(h, least)])

    parse = F.pandas_udf(run, ArrayType(SECTION))
    return pages.select("page_id", "url", F.posexplode(parse("html")).alias("ord", "s")).select("page_id", "url", "ord", "s.heading", "s.body")


def html_language(html: Column) -> Column:
    tag = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?([a-zA-Z]{2})", 1))
    return F.when(tag.isin("ar", "fr"), tag).otherwise("")


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?href=[\"']([^\"']+)[\"']"), F.lit(1))


def absolute(base: Column, href: Column) -> Column:
    def run(b: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else urljoin(x, y) for x, y in zip(b, h, strict=True)])

    return F.pandas_udf(run, StringType())(base, href)


def is_content_url(url: Column) -> Column:
    return F.lower(url).rlike("|".join(re.escape(w) for w in lx.FOLLOW_WORDS))


def is_skipped_url(url: Column) -> Column:
    return F.lower(url).rlike("(" + "|".join(re.escape(s) for s in lx.SKIP_SUFFIXES) + r")([?#].*)?$")


def crawl(edges: DataFrame, seeds: DataFrame, max_depth: int, scratch, per_host: int | None = None) -> DataFrame:
    """(url, depth): pages within ``max_depth`` links of the seeds, same host, over a table of (src, dst) links.

    ``per_host`` is a crawl's budget of pages: nearer ones first, and of those at one depth pages that look like content.
    """
    host = lambda c: F.regexp_extract(c, "^https?://([^/]+)", 1)
    inside = scratch.keep(edges.where((host("src") == host("dst")) & ~is_skipped_url(F.col("dst"))).distinct())
    seen = scratch.keep(seeds.select("url", F.lit(0).alias("depth")).distinct())
    for depth in range(max_depth):
        front = seen.where(F.col("depth") == depth)
        new = inside.join(front, inside["src"] == front["url"]).select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti")
        seen = scratch.keep(seen.unionByName(new.withColumn("depth", F.lit(depth + 1))))
    if per_host is None:
        return seen
    order = Window.partitionBy(host("url")).orderBy("depth", (~is_content_url(F.col("url"))).cast("int"), "url")
    return seen.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_host).drop("_r")
