import math
import re
from collections import Counter

import numpy as np
import pytest

from quern.llm import ranked_search
from quern.llm.common import workspace

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k=20):
    """Sorted rows of (item, rank, doc, score)."""
    held = [(d, Counter(t), len(t)) for d, text in docs if (t := terms(text))]
    n_all, l_all = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in {i for i in items if i[1] is not None}:
        asked, scored = Counter(terms(text)), []
        for d, c, n in held:
            m = 75 + 25 * n * n_all // l_all
            score = sum(times * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        scored.sort(key=lambda r: r[:3])
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, monkeypatch=None, **sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(ranked_search, name, value)
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, term string, item long, score int").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    shards, n_all, _ = ranked_search.build_index(d, workspace(spark, "test-ranked"))
    return sorted((tuple(r) for r in ranked_search.search(shards, n_all, q).collect()), key=str)


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(8)
    words = np.array(["w%d" % i for i in range(300)] + ["Été", "水", "x1y"])
    p = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rng.choice(words, n, p=p / p.sum())) + rng.choice([".", "!", ""])
    docs = [(int(i), text(rng.integers(1, 80))) for i in rng.permutation(400)]
    docs += [(1000 + i, docs[0][1]) for i in range(60)]  # ties beyond k
    docs += [docs[3], docs[3], (None, docs[0][1]), (None, None), (2000, ""), (2001, " -,"), (2002, text(20_000)), (2003, None)]
    items = [(i, text(12)) for i in range(25)] + [(25, docs[0][1]), (25, docs[0][1]), (26, None), (27, ""), (28, "nowhere"), (None, "w1 W1 w200"), (29, text(3000))]
    return docs, items


def test_a_task_holds_one_shard(spark, tables, tmp_path, monkeypatch):
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    shards, n_all, _ = ranked_search.build_index(d, workspace(spark, "test-ranked"))
    assert shards.count() == 5
    shards.repartition(1).write.parquet(str(tmp_path / "one"))
    made = ranked_search._search

    def one_by_one(*a):
        def run(batches):
            def seen():
                for b in batches:
                    assert b.num_rows == 1
                    yield b

            yield from made(*a)(seen())

        return run

    monkeypatch.setattr(ranked_search, "_search", one_by_one)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = ranked_search.search(spark.read.parquet(str(tmp_path / "one")), n_all, q)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_brute_force(spark, tables):
    assert found(spark, *tables) == brute(*tables)


def test_small_shards_slices_and_rounds(spark, tables, monkeypatch):
    # workers read the module's own sizes, so small shards are made by many partitions; slices and rounds on the driver
    docs, items = tables
    assert found(spark, docs, items, monkeypatch, SLICE_TERMS=300) == brute(docs, items)


def test_one_document_and_empty(spark):
    assert found(spark, [(5, "a b a")], [(1, "a"), (2, "c")]) == brute([(5, "a b a")], [(1, "a"), (2, "c")])
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []


@pytest.mark.parametrize("n_docs", [1, 2, 3, 17, 64])
def test_tree_finds_each_document(n_docs):
    rng = np.random.default_rng(n_docs)
    tf = rng.integers(0, 4, (5, n_docs))
    lists = [sorted(np.flatnonzero(row), key=lambda d, row=row: (-row[d], d)) for row in tf]
    docs, impact = np.concatenate(lists).astype(np.int64), np.concatenate([row[list(g)] for row, g in zip(tf, lists, strict=True)])
    starts, bits = np.cumsum([0, *map(len, lists)]), b""
    at = docs
    for level in range(ranked_search.levels(n_docs) - 1, -1, -1):
        one = (at >> level & 1).astype(bool)
        bits += np.packbits(one).tobytes()
        at = np.concatenate([at[~one], at[one]])
    shard = ranked_search.Shard(n_docs, starts, impact, bits)
    weight = np.array([3, 1, 0, 7, 2])
    best = ranked_search.Best(6, [])
    ranked_search.search_shard(shard, np.arange(n_docs), np.stack([starts[:-1], starts[1:]], axis=1), weight, best, list(range(n_docs)))
    score = weight @ tf
    want = sorted((-int(s), d, d) for d, s in enumerate(score) if s > 0)[:6]
    assert best.rows == want
