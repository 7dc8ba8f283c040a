import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from quern.llm import token_store as ts

SCHEMA = "doc_id long, text string, n string"


def brute(rows):
    library, out, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip(spark, tmp_path):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").slice(0, 80).to_pylist()
    rows = [(r["doc_id"] * 3 % 251, r["text"]) for r in texts] + [(None, "null id"), (9001, None), (9002, ""), (9003, "word " * 9000), (9004, "word " * 9000), (9005, texts[0]["text"]), (9005, texts[0]["text"])]
    path = ts.write_store(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3), f"file://{tmp_path}/store")
    got = [tuple(r) for r in ts.verify(spark, path).orderBy("start").collect()]
    assert got == brute(rows)
    rebuilt = {r.start: r.ids for r in ts.read_documents(spark, path).collect()}
    assert [(len(rebuilt[s]), zlib.crc32(np.array(rebuilt[s], "<u4").tobytes())) for _, s, _, _ in got] == [g[2:] for g in got]
    chunks = [r.address for r in ts._chunks(spark, path).collect()]
    assert len(chunks) == len(set(chunks))
    recipes = spark.read.parquet(f"{path}/recipes").orderBy("start").collect()
    assert len({r.recipe for r in recipes if r.doc_id in (0, 9005)}) == 1  # equal texts, equal chunks

    smaller = f"file://{tmp_path}/smaller"
    for name in ("objects", "recipes"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{smaller}/{name}")
    spark.read.parquet(f"{path}/manifest").limit(0).write.parquet(f"{smaller}/manifest")
    with pytest.raises(ValueError, match="manifest"):
        ts.verify(spark, smaller)

    (spark.read.parquet(f"{path}/objects").where("kind = 'recipe' or n > 64").write.parquet(f"file://{tmp_path}/broken/objects"))
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"file://{tmp_path}/broken/{name}")
    with pytest.raises(Exception, match="chunks don't hold"):
        ts.verify(spark, f"file://{tmp_path}/broken").collect()


def test_mixed_white_space(spark, tmp_path):
    texts = ["x y\tz", "a b\u00a0c", "a\u00a0b ", "a\n\n\nb\u00a0c\u00a0d", "a  b\tc", "a\n\nb\u2003c"]
    path = ts.write_store(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA), f"file://{tmp_path}/store")
    assert [tuple(r) for r in ts.verify(spark, path).orderBy("start").collect()] == brute(list(enumerate(texts)))


def test_empty(spark, tmp_path):
    path = ts.write_store(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/store")
    assert ts.verify(spark, path).count() == 0 and ts.read_documents(spark, path).count() == 0


def test_chunking():
    ids = np.random.default_rng(1).integers(0, 50000, 20000)
    ends = ts.boundaries(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == 20000 and sizes[:-1].min() >= ts.MIN_CHUNK and sizes.max() <= ts.MAX_CHUNK
    moved = ts.boundaries(np.concatenate([ids[:37], ids]))
    assert len({e - 37 for e in moved} & set(ends)) > 0.9 * len(ends)  # cuts follow the content
    assert ts.boundaries(np.zeros(5000, int))[-1] == 5000
    streams = [ids[a:b].astype("<u2") for a, b in ((0, 1), (1, 4), (4, 2000), (2000, 2000 + 64), (2064, 9000), (9000, 20000))]
    assert ts.boundaries_of(streams) == [ts.boundaries(x) for x in streams]


def test_crc_join():
    a, b = b"left part", b"the right part" * 9
    assert ts.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_files_in_ascending_order(spark, tmp_path):
    ids = np.random.default_rng(5).permutation(700).tolist()
    docs = spark.createDataFrame([(i, f"text number {i} " * (1 + i % 7), "x") for i in ids], SCHEMA).repartition(5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        path = ts.write_store(docs, f"file://{tmp_path}/store")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = sorted((tmp_path / "store" / "recipes").glob("*.parquet"))
    rows = [r for f in files for r in pq.read_table(f).to_pylist()]
    assert len(files) > 4 and [r["ordinal"] for r in rows] == list(range(700)) and [r["doc_id"] for r in rows] == sorted(ids)
    starts = np.cumsum([0, *(r["n_tokens"] for r in rows)])
    assert [r["start"] for r in rows] == starts[:-1].tolist()
