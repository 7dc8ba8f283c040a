import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer
import public_tokenizers

import corpus_pipeline
from quern.llm.common import materialise, workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), workspace(spark, name))
        if name != "bpe":
            assert docs.columns == COLUMNS
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(seen, seen[1:], strict=False)) and len(seen[2]) < len(seen[1]) and len(seen[3]) < len(seen[2])
    clean = [d for d, x in labels.items() if x == (1, 0)]
    assert sum(d in seen[1] for d in clean) > 0.96 * len(clean)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = dict(zip(*(pq.read_table(f"{sf}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text")), strict=True))
    for r in docs.limit(20).collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)


WORDS = np.array([a + b + c for a in ("ter", "mal", "sor", "qui") for b in ("an", "el", "or") for c in ("ta", "mi", "no", "sel", "ru")])
EXTRA = "kept_id long, rows int, n string, kept string, ids int, node long, class_node long, component_id long, lang_pred string, label int"


def text_of(seed, n=80):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def made(spark, tmp_path, rows, items):
    """A folder of tables whose documents have columns with names that the stages use."""
    docs = [(i, t, "en", "s", len(t or ""), 1, 2, "x", "y", 3, 4, 5, 6, "z", 7) for i, t in rows]
    sf = str(tmp_path / "tables")
    spark.createDataFrame(docs, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in rows[:3] if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf


def test_every_case_at_once(spark, tmp_path):
    leak = text_of(900, 30)
    rows = [(i, text_of(i)) for i in range(12)]
    rows += [(50, text_of(3)), (51, text_of(3) + " mala"), (52, text_of(4)), (5, text_of(5)), (5, text_of(5))]  # copies, near copies, repeated rows
    rows += [(60, None), (61, ""), (62, " \n "), (63, "too few words"), (None, text_of(70)), (None, text_of(71)), (80, text_of(80, 30_000)), (90, text_of(91, 40) + " " + leak + " " + text_of(92, 40))]
    sf = made(spark, tmp_path, rows, [(1, leak), (2, None), (3, "")])
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), workspace(spark, name))
        assert name == "bpe" or docs.columns == columns
        seen.append(sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.select("doc_id").collect()))
    assert not {60, 61, 62, 63} & set(seen[0]) and seen[0].count(5) == 3 and seen[0].count(-1) == 2
    assert seen[2] == [-1, -1, *range(12), 80, 90] and seen[3] == [-1, -1, *range(12), 80] and seen[4] == seen[3]
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in corpus_pipeline.run(spark, sf).collect()) == seen[4]


@pytest.mark.parametrize("items", [[], [(1, "some item of a benchmark")]])
def test_empty_tables(spark, tmp_path, items):
    assert corpus_pipeline.run(spark, made(spark, tmp_path, [], items)).count() == 0
