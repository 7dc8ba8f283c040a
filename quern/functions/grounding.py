"""Claims, entities, citations and the fidelity score, as column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .text import NOT_WORD, match_text, n_words, strip_citations


def is_noise_claim(claim: Column) -> Column:
    c = F.regexp_replace(F.trim(claim), r'^[",\[\]{}\s]+|[",\[\]{}\s]+$', "")
    return (
        (F.length(c) <= 10)
        | c.rlike(r"https?://\S+")
        | c.rlike(r'^(\{|\[|"claims"|"ادعاءات"|claims|ادعاءات|réponse|json|المصدر|الرابط|المرجع)')
        | F.lower(c).rlike("the source|source for|reference link|le source")
    )


def split_claims(answer: Column, limit: int = 5, scope: int = 600) -> Column:
    """The first claims of an answer by sentence; a model's decomposition may replace this column."""
    text = F.substring(strip_citations(answer), 1, scope)
    return F.slice(F.filter(F.transform(F.split(text, "[.?!؟]"), F.trim), lambda c: ~is_noise_claim(c)), 1, limit)


def content_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), NOT_WORD, ""), r"\s+"), lambda w: w != ""))


def claim_words(claim: Column, stopwords: list[str] = lx.CLAIM_STOPWORDS) -> Column:
    return F.filter(content_words(claim), lambda w: (F.length(w) > 2) & ~w.isin(stopwords))


def overlap_share(claim: Column, evidence: Column) -> Column:
    """Share of the claim's words in the evidence; 1 for a claim of no words."""
    mine = claim_words(claim)
    return F.when(F.size(mine) == 0, 1.0).otherwise(F.size(F.array_intersect(mine, content_words(evidence))) / F.size(mine))


def best_overlap(claim: Column, chunks: Column, share=overlap_share) -> Column:
    """The largest share over single chunks (an array of texts); words scattered over several chunks don't add up."""
    none = F.when(F.size(claim_words(claim)) == 0, 1.0).otherwise(0.0)
    return F.coalesce(F.array_max(F.transform(chunks, lambda c: share(claim, c))), none)


def chain_verified(claims: Column, chunks: Column, is_multihop: Column) -> Column:
    """Whether every intermediate claim is grounded; always so for questions of one step."""
    return ~is_multihop | F.forall(F.coalesce(claims, F.array().cast("array<string>")), lambda c: best_overlap(c, chunks) >= lx.CLAIM_GROUNDED)


def entity_sources(found: Column, chunks: Column) -> Column:
    """Of each entity whether some chunk holds it and the source of the first that does; chunks are struct(source, text) in rank order."""

    def first(e: Column) -> Column:
        key = match_text(e["entity"])
        return F.try_element_at(F.filter(chunks, lambda c: match_text(c["text"]).contains(key) & (key != "")), F.lit(1))

    return F.transform(found, lambda e: F.struct(e["type"].alias("type"), e["entity"].alias("entity"), first(e).isNotNull().alias("matched"), first(e)["source"].alias("source")))


def entities(text: Column, dedup: bool = False) -> Column:
    """array of struct(type, entity), as a bag in pattern order."""

    def typed(kind: str, pattern: str) -> Column:
        # case, digits and word boundaries of all scripts
        found = F.regexp_extract_all(text, F.lit("(?iU)" + pattern), F.lit(0))
        return F.transform(found, lambda e: F.struct(F.lit(kind).alias("type"), F.trim(e).alias("entity")))

    kinds = [(kind, typed(kind, pattern)) for kind, pattern in lx.ENTITY_PATTERNS]
    cities = F.transform(
        F.filter(F.array(*[F.lit(c) for c in lx.CITIES]), lambda c: text.contains(c)), lambda c: F.struct(F.lit("LOCATION").alias("type"), c.alias("entity"))
    )
    at = next(i for i, (k, _) in enumerate(kinds) if k == "DURATION")
    out = F.concat(*[c for _, c in kinds[:at]], cities, *[c for _, c in kinds[at:]])
    return F.array_distinct(out) if dedup else out


def entity_match_ratio(found: Column, context: Column) -> Column:
    held = match_text(context)
    matched = F.filter(found, lambda e: held.contains(match_text(e["entity"])) & (match_text(e["entity"]) != ""))
    return F.when(F.size(found) == 0, 1.0).otherwise(F.size(matched) / F.size(found))


def fidelity(claim_ratio: Column, entity_ratio: Column, n_entities: Column, chain_verified: Column) -> Column:
    """Composite fidelity: claims, entities (left out without any) and relation, weighted."""
    relation = F.when(chain_verified, 1.0).otherwise(0.5)
    bare = (lx.W_CLAIM * claim_ratio + lx.W_RELATION * relation) / (lx.W_CLAIM + lx.W_RELATION)
    whole = (lx.W_CLAIM * claim_ratio + lx.W_ENTITY * entity_ratio + lx.W_RELATION * relation) / (lx.W_CLAIM + lx.W_ENTITY + lx.W_RELATION)
    return F.round(F.when(n_entities > 0, whole).otherwise(bare), 4)


def is_grounded(claim_ratio: Column, entity_ratio: Column, cfi: Column, exact_entities: bool = True) -> Column:
    return (claim_ratio >= lx.RATIO_GROUNDED) & (entity_ratio >= (1.0 if exact_entities else 0.8)) & (cfi >= lx.CFI_GROUNDED)


def warnings(claim_ratio: Column, entity_ratio: Column, cfi: Column) -> Column:
    tests = [(claim_ratio < lx.RATIO_GROUNDED, "claims"), (entity_ratio < 1.0, "entities"), (cfi < lx.CFI_GROUNDED, "fidelity")]
    return F.array_compact(F.array(*[F.when(t, w) for t, w in tests]))


def is_valid_citation(cited: Column, sources: Column) -> Column:
    """Equal to a source, or one stem within the other where both have six characters."""
    stem = lambda s: F.regexp_replace(F.lower(F.trim(s)), r"\.[a-z0-9]{2,4}$", "")
    both = lambda s: (F.length(stem(s)) >= 6) & (F.length(stem(cited)) >= 6) & (stem(s).contains(stem(cited)) | stem(cited).contains(stem(s)))
    return F.exists(sources, lambda s: (F.lower(F.trim(s)) == F.lower(F.trim(cited))) | both(s))


def validate_citations(answer: Column, sources: Column) -> Column:
    """Citations of unknown sources become UNVERIFIED."""
    tags = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"(?i)\[Source:[^\]]*\]"), F.lit(0)))
    name = lambda t: F.trim(F.regexp_extract(t, r"(?i)\[Source:\s*([^\]|]*)", 1))
    return F.aggregate(tags, answer, lambda acc, t: F.when(is_valid_citation(name(t), sources), acc).otherwise(F.replace(acc, t, F.lit("[UNVERIFIED]"))))


def inject_citations(answer: Column, chunks: Column, limit: int = 8) -> Column:
    """Content lines without a citation get the source of the chunk with most common words, ``limit`` at most.

    ``chunks`` is an array of struct(source, text) in rank order.
    """
    best = lambda line: F.aggregate(
        chunks,
        F.struct(F.lit(0).alias("n"), F.lit("").alias("source")),
        lambda acc, c: F.when(
            F.size(F.array_intersect(content_words(line), content_words(c["text"]))) > acc["n"],
            F.struct(F.size(F.array_intersect(content_words(line), content_words(c["text"]))).alias("n"), c["source"].alias("source")),
        ).otherwise(acc),
    )
    eligible = lambda line: (
        (line.rlike(r"^\s*([-*•]|[0-9]+[.)])") | (F.length(F.trim(line)) > 40))
        & (F.length(F.trim(line)) >= 15)
        & ~line.rlike(r":\s*$")
        & ~line.rlike(r"(?i)\[Source:")
    )
    step = lambda acc, line: F.when(
        eligible(line) & (acc["n"] < limit) & (best(line)["n"] > 0),
        F.struct((acc["n"] + 1).alias("n"), F.concat(acc["lines"], F.array(F.concat(line, F.lit(" [Source: "), best(line)["source"], F.lit("]")))).alias("lines")),
    ).otherwise(F.struct(acc["n"].alias("n"), F.concat(acc["lines"], F.array(line)).alias("lines")))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("lines"))
    return F.array_join(F.aggregate(F.split(answer, "\n"), start, step)["lines"], "\n")


def citation_coverage(answer: Column) -> Column:
    """Cited content lines among content lines."""
    lines = F.filter(F.split(answer, "\n"), lambda x: (F.length(F.trim(x)) >= 15) & ~x.rlike(r":\s*$"))
    return F.try_divide(F.size(F.filter(lines, lambda x: x.rlike(r"(?i)\[Source:"))), F.size(lines))


def clean_answer(answer: Column) -> Column:
    """Drops citation-only lines, adjacent equal lines and long lines seen before; squeezes blank lines and score tags."""
    key = lambda x: F.lower(F.regexp_replace(F.trim(x), r"\s+", " "))
    keep = lambda acc, x: ~(
        x.rlike(r"(?i)^\s*(\[Source:[^\]]*\]\s*)+$")
        | ((key(x) != "") & (F.coalesce(F.try_element_at(acc["lines"], F.lit(-1)), F.lit("\0")) == x))
        | ((F.length(key(x)) > 15) & F.array_contains(acc["seen"], key(x)))
    )
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.array().cast("array<string>").alias("seen"))
    out = F.aggregate(
        F.split(answer, "\n"),
        start,
        lambda acc, x: F.when(keep(acc, x), F.struct(F.concat(acc["lines"], F.array(x)).alias("lines"), F.concat(acc["seen"], F.array(key(x))).alias("seen"))).otherwise(acc),
    )
    text = F.regexp_replace(F.array_join(out["lines"], "\n"), r"(?i)[ \t]*\(?score\s*:\s*[0-9.]+\)?", "")
    text = F.regexp_replace(text, r"\[(?!Source|UNVERIFIED)([^\]]*)\]", "$1")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def diagnose(claim_ratio: Column, entity_ratio: Column, coverage: Column, n_chunks: Column) -> Column:
    """Root causes by rule."""
    rules = [
        (n_chunks == 0, "no_evidence"),
        (claim_ratio < 0.5, "claims_ungrounded"),
        (entity_ratio < 0.5, "entities_missing"),
        (coverage < 0.5, "citations_missing"),
    ]
    return F.array_compact(F.array(*[F.when(t, c) for t, c in rules]))


def content_line_count(answer: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.size(F.filter(F.split(answer, "\n"), lambda x: n_words(x) > 0))])
