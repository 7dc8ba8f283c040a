"""Stages of ``corpus_pipeline``; each takes (spark, docs, sf_dir) and works on all that the one before kept.

Quality rules drop documents; language ID drops those in no determined language; near-dedup leaves one document
of each component; decontamination drops those that hold a benchmark item; the last stage encodes what is left.

All but the last keep the columns of their input, whatever they are named.  Nulls: a null, empty or wordless text goes
with the first stage (fewer than ten words); a row with a null id is judged by its text like any other, and near-dedup
keeps it, as it names no class.  Repeated rows: one stays.  Ties: the smallest id of a class stays.  A very long text is
one document.  Empty tables of documents, benchmark or labels give empty output, or no rejections on their account.
"""

from __future__ import annotations

from .bpe import bpe_stage
from .common import documents, materialise, workspace
from .decontaminate import decontaminate_stage
from .language_id import language_stage
from .near_dup import near_dup_stage
from .quality import quality_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("near_dup", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", bpe_stage),
]


def run(spark, sf_dir):
    """Apply all stages to ``documents``, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), workspace(spark, name))
    return docs
