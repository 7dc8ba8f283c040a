"""Building evaluation sets: items from raw question-answer rows, their order, fixes, and the sections that feed generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import n_words
from ..session import Scratch
from . import curate


def category_of(category: Column, language: Column) -> Column:
    """Dialect questions get the dialect's category unless they are out of scope."""
    upper = F.upper(F.coalesce(category, F.lit("SIMPLE")))
    return F.when((language == "Darija") & (upper != "OUTSCOPE"), "DARIJA").when((language == "Arabizi") & (upper != "OUTSCOPE"), "ARABIZI").otherwise(upper)


def needs_review(language: Column, gold_answer: Column) -> Column:
    """An answer to an Arabizi question that is in Latin letters rather than Arabic."""
    arabic, latin = (F.regexp_count(gold_answer, F.lit(p)) for p in (r"[\x{0600}-\x{06FF}]", "[A-Za-z]"))
    return F.coalesce((language == "Arabizi") & (latin > arabic), F.lit(False))


def build_items(raw: DataFrame) -> DataFrame:
    """Rows with defaults and derived flags; blank questions go. ``raw``: question, category, language, gold_answer, is_multihop, should_abstain and any more."""
    language = F.coalesce("language", F.lit("arabic_msa"))
    rows = raw.withColumn("question", F.trim(F.coalesce("question", F.lit("")))).where("question <> ''")
    rows = rows.withColumns({"language": language, "category": category_of(F.col("category"), language), "gold_answer": F.coalesce("gold_answer", F.lit(""))})
    hops = F.coalesce("is_multihop", F.lit(False)) | (F.col("category") == "MULTIHOP")
    rows = rows.withColumns(
        {
            "is_multihop": hops,
            "should_abstain": F.coalesce("should_abstain", F.lit(False)) | (F.col("category") == "OUTSCOPE"),
            "review_needed": needs_review(F.col("language"), F.col("gold_answer")),
        }
    )
    flags = [F.when(hops if c == "MULTIHOP" else F.col("category") == c, c) for c in ("SIMPLE", "MULTIHOP", "MULTIHOP_HARD", "OUTSCOPE", "LEGAL", "DARIJA", "ARABIZI", "EDGE")]
    return rows.withColumn("expected_flags", F.array_join(F.array_compact(F.array(*flags)), ","))


def build_set(raw: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Items of ``build_items`` that are near no existing question and no earlier accepted one, each with its id in ``item_key``.

    ``existing``: id, question. Questions are near at ``DEDUP_OVERLAP`` of their token sets; dropped ones don't drop others.
    Numbers go on from the largest that an existing id has behind its prefix.
    """
    keep = Scratch(raw.sparkSession, "gold").keep
    new = keep(curate.numbered(build_items(raw), order, name="_at"))
    old = existing.select((-1 - F.monotonically_increasing_id()).alias("_at"), "question")
    sets = curate.token_sets(keep(old.unionByName(new.select("_at", "question"))), "_at", F.col("question"))
    classes = curate.set_classes(sets, "_at")
    firsts = curate.class_sets(sets, classes, "_at")
    near = curate.overlap_pairs(firsts, "_at").where("b >= 0")  # existing ones stay
    kept = curate.kept_rows(sets, classes, "_at", curate.greedy_keep(firsts, near, "_at")).where("kept")
    items = new.join(kept.select("_at"), "_at", "left_semi")
    number = F.substring("id", F.lit(2), F.length("id"))
    taken = existing.where(number.rlike("^[0-9]+$")).groupBy(F.substring("id", 1, 1).alias("prefix")).agg(F.max(number.cast("long")).alias("n"))
    letters = sorted({*lx.CATEGORY_PREFIX.values(), "X"})
    most = dict(taken.where(F.col("prefix").isin(letters)).collect())  # at most one row a prefix
    return curate.next_ids(items, "category", ["_at"], most).drop("_at")


def set_order(items: DataFrame, id_col: str = "id") -> DataFrame:
    """``items`` in the order of a set: the category's prefix, then the number in the id."""
    prefix = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in lx.CATEGORY_PREFIX.items() for x in pair]), F.col("category")), F.lit("Z"))
    number = F.coalesce(F.try_to_number(F.nullif(F.regexp_replace(id_col, r"\D", ""), F.lit("")), F.lit("999999999999")).cast("long"), F.lit(0))
    return items.withColumns({"order_prefix": prefix, "order_number": number}).orderBy("order_prefix", "order_number", id_col)


def summary(items: DataFrame) -> DataFrame:
    """(dim, value, n): counts by category and by language, from one pass over grouping sets."""
    sets = items.groupingSets([[F.col("category")], [F.col("language")]], "category", "language").agg(F.count("*").alias("n"), F.grouping("category").alias("_c"))
    return sets.select(F.when(F.col("_c") == 0, "category").otherwise("language").alias("dim"), F.when(F.col("_c") == 0, F.col("category")).otherwise(F.col("language")).alias("value"), "n")


def replace_nth(items: DataFrame, fixes: DataFrame, language: str, order: str) -> DataFrame:
    """The question of the n-th item (from 0, by ``order``) of a language replaced; ``fixes`` is (n, question). Only the items of that language are numbered."""
    mine = items.where(F.col("language") == language).withColumn("n", F.row_number().over(Window.partitionBy("language").orderBy(order)) - 1)
    fixed = mine.join(fixes.select("n", F.col("question").alias("fix")), "n", "left").withColumn("question", F.coalesce("fix", "question")).drop("n", "fix")
    return items.where(~F.coalesce(F.col("language") == language, F.lit(False))).unionByName(fixed.select(items.columns))


def sections_for_generation(procedures: DataFrame, pages: DataFrame, administrations: DataFrame, least_words: int = 30, limit: int | None = None) -> DataFrame:
    """(priority, id, text): procedures with enough words, then pages, then administrations with enough words; the first ``limit`` of them."""
    enough = n_words(F.col("text")) >= least_words
    parts = [(0, procedures.where(enough)), (1, pages), (2, administrations.where(enough))]
    out = None
    for priority, part in parts:
        rows = part.select(F.lit(priority).alias("priority"), F.col("id").cast("string").alias("id"), "text")
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("priority", "id").limit(limit) if limit else out


def is_enriched(body: Column) -> Column:
    return body.contains(lx.DOCUMENTS_HEADING)


def enrich(procedures: DataFrame, documents: DataFrame, administrations: DataFrame) -> DataFrame:
    """Procedures with the names of their documents appended under a heading, and their administration; enriched ones stay as they are.

    ``procedures``: procedure_id, body, administration_id; ``documents``: procedure_id, pos, name; ``administrations``: administration_id, name.
    """
    named = documents.groupBy("procedure_id").agg(
        F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda d: F.concat(F.lit("- "), d["name"]))).alias("listed"),
        F.count("*").alias("n_documents"),
    )
    rows = procedures.join(named, "procedure_id", "left").join(administrations.select("administration_id", F.col("name").alias("administration")), "administration_id", "left")
    body = F.when(is_enriched(F.col("body")) | F.col("listed").isNull(), F.col("body")).otherwise(F.concat("body", F.lit(f"\n\n{lx.DOCUMENTS_HEADING}:\n"), "listed"))
    return rows.select("procedure_id", body.alias("body"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("administration", F.lit("")).alias("administration"))
