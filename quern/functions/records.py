"""Assembly and repair of records: bodies, contexts, evaluation rows, model output."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def labelled(*pairs: tuple[str, Column]) -> Column:
    """``label: value`` lines of the values that aren't empty."""
    return F.concat_ws("\n", *[F.when(F.trim(v) != "", F.concat(F.lit(f"{name}: "), v)) for name, v in pairs])


def numbered_documents(documents: Column) -> Column:
    """Titles numbered within their section, sections and titles in their sort order.

    ``documents`` is array of struct(section, section_sort, sort, title).
    """
    ordered = F.array_sort(F.transform(documents, lambda d: F.struct(d["section_sort"].alias("a"), d["section"].alias("s"), d["sort"].alias("b"), d["title"].alias("t"))))
    step = lambda acc, d: F.struct(
        F.when(acc["section"] == d["s"], acc["n"] + 1).otherwise(1).alias("n"),
        d["s"].alias("section"),
        F.concat(
            acc["lines"],
            F.when(acc["section"] == d["s"], F.array().cast("array<string>")).otherwise(F.array(F.concat(d["s"], F.lit(":")))),
            F.array(F.concat(F.when(acc["section"] == d["s"], acc["n"] + 1).otherwise(1).cast("string"), F.lit(". "), d["t"])),
        ).alias("lines"),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit("\0").alias("section"), F.array().cast("array<string>").alias("lines"))
    return F.array_join(F.aggregate(ordered, start, step)["lines"], "\n")


def first_contexts(*candidates: Column) -> Column:
    """The first list with a non-empty context, without its empty ones."""
    kept = [F.filter(c, lambda x: F.trim(x) != "") for c in candidates]
    return F.coalesce(*[F.when(F.size(k) > 0, k) for k in kept], F.array().cast("array<string>"))


def explode_contexts(df: DataFrame, contexts: str, keep: list[str], cap: int = 5) -> DataFrame:
    """A row per context, the first ``cap`` of them; a row with an empty one where there are none."""
    return df.select(*keep, F.explode_outer(F.slice(contexts, 1, cap)).alias("document")).withColumn("document", F.coalesce("document", F.lit("")))


def repair_json(reply: str | None) -> list[str]:
    """Items of the first array that can be read in a model's reply, as JSON strings."""
    text = re.sub(r"(?s)<think>.*?</think>|```(?:json)?", "", reply or "")
    end = text.rfind("]")
    for start in (k.start() for k in re.finditer(r"\[", text)):
        if start < end:
            try:
                found = json.loads(re.sub(r",\s*([\]}])", r"\1", text[start : end + 1]))
            except ValueError:
                continue
            return [json.dumps(x, ensure_ascii=False) for x in found if isinstance(x, dict)]
    return []


def repaired_items(reply: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(repair_json), ArrayType(StringType()))(reply)


def category_tree(categories: DataFrame) -> DataFrame:
    """(thematic_id, path) of a table of nested categories: title, subs[title, thematics[id, title]]."""
    a = categories.select(F.col("title").alias("c"), F.explode("subs").alias("s"))
    b = a.select("c", F.col("s.title").alias("s"), F.explode("s.thematics").alias("t"))
    return b.select(F.col("t.id").alias("thematic_id"), F.concat_ws(" > ", "c", "s", "t.title").alias("path"))


def first_by_id(pages: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Paginated rows without repeats: the first of each id; rows without an id all stay."""
    w = Window.partitionBy(id_col).orderBy(*order)
    known = pages.where(F.col(id_col).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return known.unionByName(pages.where(F.col(id_col).isNull()))


def best_run(manifests: DataFrame) -> DataFrame:
    """The run to resume: most procedures among the incomplete, or among all."""
    order = F.struct((~F.col("completed")).cast("int"), F.col("n"), F.col("dir"))
    return manifests.agg(F.max_by("dir", order).alias("dir"))


def blind_sheet(results: DataFrame, systems: str, item: str, language: str, per_language: int, seed: str = "") -> tuple[DataFrame, DataFrame]:
    """(sheet, key): the same items of each language for every system in hash order, and what each row was."""
    h = lambda *c: F.md5(F.concat(F.lit(seed), *[F.col(x).cast("string") for x in c]))
    items = results.select(item, language).distinct()
    chosen = items.withColumn("_r", F.row_number().over(Window.partitionBy(language).orderBy(h(item)))).where(F.col("_r") <= per_language)
    rows = results.join(chosen.select(item), item).withColumn("row_id", F.row_number().over(Window.orderBy(h(systems, item))))
    return rows.drop(systems, item), rows.select("row_id", systems, item)


def mean_scores(rows: DataFrame, by: list[str], scores: list[str], language: str, without: str = "Arabizi") -> DataFrame:
    """Means that skip NaN; similarity, relevancy and correctness leave out rows of one language."""
    def one(name: str) -> Column:
        value = F.nanvl(F.col(name), F.lit(None).cast("double"))
        if any(w in name for w in ("similarity", "relevancy", "correctness")):
            value = F.when(F.col(language) != without, value)
        return F.avg(value).alias(name)

    return rows.groupBy(*by).agg(*[one(s) for s in scores])
