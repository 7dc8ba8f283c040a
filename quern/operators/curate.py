"""Curation of evaluation sets and corpora: audits, validators, duplicates, samples, merges."""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.metrics import metric_tokens
from ..functions.text import ARABIC, contains_any, count, n_words, script_of
from ..session import Scratch
from .chunking import numbered

log = logging.getLogger(__name__)


def audit_codes(language, expected, question, answer, keywords, should_abstain) -> Column:
    """Issue codes of a gold item, in the order of the rules."""
    script = F.create_map(*[F.lit(x) for kv in lx.EXPECTED_SCRIPT.items() for x in kv])
    want = F.try_element_at(script, language)
    latin, arabic = F.coalesce(want == "latin", F.lit(False)), F.coalesce(want == "arabic", F.lit(False))
    q, a = F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit(""))
    kw = F.coalesce(keywords, F.array().cast("array<string>"))
    kw_text = F.array_join(kw, " ")
    abstain = F.coalesce(should_abstain, F.lit(False))
    says_so = contains_any(F.lower(a), lx.AUDIT_ABSTAIN_MARKERS)
    filled = F.trim(a) != ""
    dangling = F.when(latin, q.rlike("(?i)" + "|".join(lx.DANGLING["latin"]))).otherwise(q.rlike("|".join(lx.DANGLING["arabic"])))
    marks = f"[{lx.TRANSLITERATION_MARKS}]"
    rules = [
        ((expected != "") & (expected != language), "LANG_FIELD_MISMATCH"),
        (latin & q.rlike(ARABIC), "Q_HAS_ARABIC"),
        (arabic & (script_of(q) == "latin"), "Q_WRONG_SCRIPT"),
        (~abstain & latin & (script_of(a) == "arabic"), "A_IS_ARABIC"),
        (~abstain & latin & (script_of(a) == "mixed"), "A_MIXED_SCRIPT"),
        (~abstain & arabic & (script_of(a) == "latin"), "A_IS_LATIN"),
        ((F.size(kw) > 0) & latin & kw_text.rlike(ARABIC), "KW_HAS_ARABIC"),
        ((F.size(kw) > 0) & arabic & kw_text.rlike("[a-zA-Z]") & ~kw_text.rlike(ARABIC), "KW_IS_LATIN"),
        ((F.size(kw) == 0) & ~abstain, "KW_EMPTY"),
        ((language == "Arabizi") & F.lower(q).rlike(marks), "ARABIZI_IPA_IN_Q"),
        ((language == "Arabizi") & F.lower(a).rlike(marks), "ARABIZI_IPA_IN_A"),
        (~abstain & ~filled, "ANSWER_EMPTY"),
        (~abstain & filled & says_so, "ANSWER_LOOKS_ABSTAIN"),
        (abstain & filled & ~says_so, "OUTSCOPE_NOT_ABSTAINING"),
        (dangling, "MAYBE_NOT_SELF_CONTAINED"),
    ]
    return F.array_compact(F.array(*[F.when(c, code) for c, code in rules]))


def is_valid_item(category, language, question, answer, keywords, source) -> Column:
    """Whether a generated question and answer pass all rules for a gold item."""
    present = category.isNotNull() & language.isNotNull() & question.isNotNull() & answer.isNotNull() & keywords.isNotNull() & source.isNotNull()
    head = F.substring(answer, 1, 80)
    arabic, latin = count(head, ARABIC), count(head, "[A-Za-z]")
    cut = answer.contains("...") | question.contains("...") | F.exists(keywords, lambda k: k.contains("..."))
    refers = contains_any(F.lower(question), [p.lower() for p in lx.NON_ATOMIC]) | contains_any(answer, ["باقي الوثائق المذكورة", "الوثائق المذكورة أعلاه"])
    least = F.when(F.upper(category) == "OUTSCOPE", 3).otherwise(10)
    return F.coalesce(
        present
        & ~cut
        & ~(answer.contains("[exact") | question.contains("[exact"))
        & ~refers
        & ~(language.isin("Arabizi", "Darija") & ((latin > arabic) | (arabic < 5)))
        & F.size(keywords).between(1, 8)
        & (n_words(question) >= 4)
        & (n_words(answer) >= least)
        & F.upper(category).isin(list(lx.CATEGORY_PREFIX))
        & language.isin(list(lx.EXPECTED_SCRIPT)),
        F.lit(False),
    )


def exact_dedup(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """The smallest id of each distinct trimmed text, with the number of copies."""
    keyed = df.select(id_col, F.sha2(F.trim(text).cast("binary"), 256).alias("key"))
    return keyed.groupBy("key").agg(F.min(id_col).alias(id_col), F.count("*").alias("copies")).drop("key")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; others stay or are added."""
    flag = new.withColumn("_new", F.lit(True)).alias("n")
    joined = old.alias("o").join(flag, key, "full_outer")
    return joined.select(key, *[F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns if c != key])


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def next_ids(items: DataFrame, category: str, order: list[str], taken: dict[str, int] | None = None) -> DataFrame:
    """An id of prefix and number for each item, from the largest number taken in its prefix."""
    prefix = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in lx.CATEGORY_PREFIX.items() for x in kv]), F.col(category)), F.substring(category, 1, 1))
    placed = numbered(items.withColumn("prefix", prefix), order, ["prefix"], "_n")
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in (taken or {"": 0}).items() for x in kv]), F.col("prefix")), F.lit(0))
    return placed.withColumn("item_key", F.concat("prefix", (F.col("_n") + 1 + base).cast("string"))).drop("_n", "prefix")


def stratified_sample(df: DataFrame, strata: list[str], key: Column, quota: int, seed: str = "") -> DataFrame:
    """``quota`` rows of each stratum by hash order: a feature of the operator, the same on any cluster."""
    order = F.md5(F.concat(F.lit(seed), key.cast("string")))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy(order))).where(F.col("_r") <= quota).drop("_r")


def divides(df: DataFrame, group: str, member: str, required: list[str]) -> DataFrame:
    """Groups that have every required member."""
    held = df.where(F.col(member).isin(required)).select(group, member).distinct()
    return held.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") == len(set(required))).select(group)


def token_sets(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, tokens, n, key) of every row, written once; the key is null without a token."""
    sets = df.select(F.col(id_col), F.array_sort(F.array_distinct(F.coalesce(metric_tokens(text), F.array().cast("array<string>")))).alias("tokens"))
    key = F.when(F.size("tokens") > 0, F.unhex(F.sha2(F.array_join("tokens", " ").cast("binary"), 256)))
    return Scratch(df.sparkSession, "token-sets").keep(sets.select(id_col, "tokens", F.size("tokens").alias("n"), key.alias("key")))


def set_classes(sets: DataFrame, id_col: str) -> DataFrame:
    """(key, first, copies): a row per distinct token set, with its smallest id."""
    return Scratch(sets.sparkSession, "set-classes").keep(sets.where("key is not null").groupBy("key").agg(F.min(id_col).alias("first"), F.count("*").alias("copies")))


def class_sets(sets: DataFrame, classes: DataFrame, id_col: str) -> DataFrame:
    """(id, tokens, n) of the first row of each class; of rows that repeat an id, one."""
    first = sets.join(classes.select(F.col("first").alias(id_col), F.col("key")), [id_col, "key"], "left_semi")
    return Scratch(sets.sparkSession, "class-sets").keep(first.dropDuplicates([id_col, "key"]).select(id_col, "tokens", "n"))


def kept_rows(sets: DataFrame, classes: DataFrame, id_col: str, kept: DataFrame) -> DataFrame:
    """(id, kept) of every row: copies of an earlier token set go, the first of a set follows ``kept`` (from ``greedy_keep``), rows without a token stay."""
    decided = classes.select("key", "first").join(kept.select(F.col(id_col).alias("first"), "kept"), "first", "left")
    rows = sets.select(id_col, "key").join(decided, "key", "left")
    return rows.select(id_col, (F.col("key").isNull() | ((F.col(id_col) == F.col("first")) & F.coalesce("kept", F.lit(True)))).alias("kept"))


COUNTERS = 1 << 20  # tokens are counted in so many slots, whatever the vocabulary
SHARED = 4  # tokens that the prefixes of a pair must share before the pair is counted in full


def _prefixes(counts, threshold: float):
    """(id, n, token) of the tokens each set is looked up under: those of the least count first."""

    def run(batches):
        count = counts.value
        for batch in batches:
            n, lists = batch.column(1).to_numpy(), batch.column(2)
            size = lists.value_lengths().to_numpy()
            row, token = np.repeat(np.arange(len(n)), size), lists.flatten().to_numpy()
            order = np.lexsort((token, count[token % len(count)], row))
            nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            kept = order[nth < (n - np.ceil(threshold * n - 1e-9) + SHARED)[row]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[kept])), pa.array(n[row[kept]]), pa.array(token[kept])], [batch.schema.names[0], "n", "token"])

    return run


def overlap_pairs(classes: DataFrame, id_col: str, threshold: float = lx.DEDUP_OVERLAP) -> DataFrame:
    """(a, b, overlap), a < b: pairs of token sets with |A & B| / max(|A|, |B|) at the threshold or above.

    Such a pair shares at least ``least = ceil(threshold * max)`` tokens. Each set is looked up under the first
    ``n - ceil(threshold * n) + SHARED`` of its tokens in an order that all sets share. Of the two prefixes one ends first; tokens
    shared beyond it number at most ``least - SHARED``, so the prefixes share ``min(SHARED, least)``; such pairs are then counted in full.
    The order is by the count of a token's slot, then by the token: rare tokens come first, and the counts broadcast have a fixed size.
    """
    spark = classes.sparkSession
    hashed = classes.select(id_col, "n", F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"))
    slot = F.pmod("token", F.lit(COUNTERS)).cast("int")
    counted = hashed.select(F.explode("tokens").alias("token")).groupBy(slot.alias("slot")).count().where("count > 1").toArrow()
    count = np.ones(COUNTERS, np.int64)
    count[counted.column("slot").to_numpy()] = counted.column("count").to_numpy()
    prefix = hashed.mapInArrow(_prefixes(spark.sparkContext.broadcast(count), threshold), f"{id_col} {classes.schema[id_col].dataType.simpleString()}, n int, token long")
    prefix = Scratch(spark, "prefixes").keep(prefix)
    x = prefix.select(F.col(id_col).alias("a"), F.col("n").alias("na"), "token")
    y = prefix.select(F.col(id_col).alias("b"), F.col("n").alias("nb"), "token")
    near = F.expr(f"a < b and na >= {threshold} * nb - 1e-9 and nb >= {threshold} * na - 1e-9")
    met = x.join(y, "token").where(near).groupBy("a", "b", "na", "nb").count()
    pairs = met.where(f"count >= least({SHARED}, ceil({threshold} * greatest(na, nb) - 1e-9))").select("a", "b").distinct()
    left = classes.select(F.col(id_col).alias("a"), F.col("tokens").alias("ta"))
    right = classes.select(F.col(id_col).alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    overlap = F.size(F.array_intersect("ta", "tb")) / F.greatest(F.size("ta"), F.size("tb"))
    return both.select("a", "b", overlap.alias("overlap")).where(F.col("overlap") >= threshold - 1e-12)


AT_ONCE = 1 << 18  # pairs that one task settles


def _settle(batches):
    """Ids dropped, from pairs in order of (b, a)."""
    dropped, last, hit = set(), None, False
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if b != last:
                last, hit = b, False
            if not hit and a not in dropped:  # an earlier one that stays
                hit = True
                dropped.add(b)
        kind = batch.column(0).type
    if dropped:
        yield pa.RecordBatch.from_arrays([pa.array(sorted(dropped), kind)], ["id"])


def greedy_keep(ids: DataFrame, pairs: DataFrame, id_col: str, at_once: int = AT_ONCE) -> DataFrame:
    """(id, kept): in id order an item goes if it is near an earlier kept one.

    While over ``at_once`` pairs are open, rounds settle them: an item with no open earlier neighbour stays, those near
    it go, and their pairs close. One task settles a remainder of that bounded size. Each round is logged.
    """
    cut, kind = Scratch(ids.sparkSession, "greedy").keep, ids.schema[id_col].dataType.simpleString()
    open_pairs, gone, turn = cut(pairs.select("a", "b").distinct()), [], 0
    while (left := open_pairs.count()) > at_once:
        turn += 1
        log.info("round %d: %d pairs are open", turn, left)
        heads = open_pairs.select("a").distinct().join(open_pairs.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        dropped = cut(open_pairs.join(heads, "a").select(F.col("b").alias("id")).distinct())
        gone.append(dropped)
        rest = open_pairs.join(dropped.withColumnRenamed("id", "b"), "b", "left_anti").join(dropped.withColumnRenamed("id", "a"), "a", "left_anti")
        open_pairs = cut(rest.select("a", "b"))
    gone.append(open_pairs.repartition(1).sortWithinPartitions("b", "a").mapInArrow(_settle, f"id {kind}"))
    dropped = gone[0]
    for more in gone[1:]:
        dropped = dropped.unionAll(more)
    dropped = cut(dropped.withColumnRenamed("id", id_col).withColumn("dropped", F.lit(True)))
    return ids.select(id_col).distinct().join(dropped, id_col, "left").select(id_col, F.col("dropped").isNull().alias("kept"))
