"""Verification of answers against their evidence, layer by layer, for whole tables of answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grounding as g
from ..functions import lexicon as lx

#: rows: answer, chunks array<struct<source, text>> in rank order, intermediate array<string>, is_multihop
LAYERS = ["claims", "entities", "chain", "fidelity", "citations", "audit"]


def share_of(claims: Column, texts: Column, entail: Callable[[Column, Column], Column]) -> Column:
    """Grounded claims among claims; 0 without claims."""
    held = F.filter(claims, lambda c: g.best_overlap(c, texts, entail) >= lx.CLAIM_GROUNDED)
    return F.coalesce(F.try_divide(F.size(held), F.nullif(F.size(claims), F.lit(0))), F.lit(0.0))


def verify(rows: DataFrame, abstain: Column, entail: Callable[[Column, Column], Column] = g.overlap_share, exact_entities: bool = True) -> DataFrame:
    """``rows`` with the cleaned and cited answer, claim and entity ratios, chain flag, fidelity, decision, abstention and warnings.

    An answer without evidence becomes the abstention. Each layer is one projection, so nothing is shuffled.
    """
    some = F.coalesce(F.size("chunks") > 0, F.lit(False))
    texts = F.transform("chunks", lambda c: c["text"])
    steps = F.flatten(F.transform(F.coalesce("intermediate", F.array().cast("array<string>")), lambda a: g.split_claims(a)))
    found = rows.withColumn("answer", g.clean_answer(F.coalesce("answer", F.lit(""))))
    found = found.withColumns({"claims": g.split_claims(F.col("answer")), "entities": g.entity_sources(g.entities(F.col("answer")), F.col("chunks")), "step_claims": steps})
    matched = F.size(F.filter("entities", lambda e: e["matched"]))
    found = found.withColumns(
        {
            "claim_ratio": share_of(F.col("claims"), texts, entail),
            "entity_ratio": F.when(F.size("entities") == 0, 1.0).otherwise(matched / F.size("entities")),
            "chain_verified": g.chain_verified(F.col("step_claims"), texts, F.col("is_multihop")),
        }
    )
    found = found.withColumn("cfi", g.fidelity(F.col("claim_ratio"), F.col("entity_ratio"), F.size("entities"), F.col("chain_verified")))
    grounded = g.is_grounded(F.col("claim_ratio"), F.col("entity_ratio"), F.col("cfi"), exact_entities)
    told = F.array_compact(F.concat(g.warnings(F.col("claim_ratio"), F.col("entity_ratio"), F.col("cfi")), F.array(F.when(~F.col("chain_verified"), "chain"))))
    cited = g.validate_citations(g.inject_citations(F.col("answer"), F.col("chunks")), F.transform("chunks", lambda c: c["source"]))
    found = found.withColumns(
        {
            "is_grounded": some & grounded,
            "is_abstained": ~some,
            "warnings": F.when(some & ~grounded, told).otherwise(F.array().cast("array<string>")),
            "coverage": g.citation_coverage(cited),
            "answer": F.when(some, cited).otherwise(abstain),
        }
    )
    return found.drop("step_claims")


def audit_rows(verified: DataFrame, id_col: str) -> DataFrame:
    """What an audit keeps: the answer's first 500 characters, ratios to three places, entities with their sources; keyed by a hash of the id."""
    r3 = lambda c: F.round(c, 3).alias(c)
    return verified.select(
        F.xxhash64(id_col).alias("audit_key"), id_col, F.substring("answer", 1, 500).alias("answer"), "is_grounded", "is_abstained", "chain_verified", "warnings",
        r3("claim_ratio"), r3("entity_ratio"), r3("cfi"), F.size("claims").alias("n_claims"), "entities",
    )


def debug_report(verified: DataFrame, id_col: str) -> DataFrame:
    """(id, layer, passed, preview): claim, entity and citation layers pass from a half, the rest by their flags."""
    at_least = lambda c: F.coalesce(c >= 0.5, F.lit(False))
    rows = [
        ("claims", at_least(F.col("claim_ratio")), F.substring(F.array_join("claims", " | "), 1, 300)),
        ("entities", at_least(F.col("entity_ratio")), F.substring(F.array_join(F.transform("entities", lambda e: e["entity"]), " | "), 1, 200)),
        ("chain", F.col("chain_verified"), F.lit("")),
        ("fidelity", F.col("cfi") >= lx.CFI_GROUNDED, F.col("cfi").cast("string")),
        ("citations", at_least(F.col("coverage")), F.substring("answer", 1, 400)),
        ("audit", F.size("warnings") == 0, F.array_join("warnings", ",")),
    ]
    each = F.array(*[F.struct(F.lit(n).alias("layer"), p.alias("passed"), t.alias("preview")) for n, p, t in rows])
    return verified.select(id_col, F.explode(each).alias("r")).select(id_col, "r.layer", "r.passed", "r.preview")
