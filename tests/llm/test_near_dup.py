import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from quern.llm import near_dup as nd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """component of each row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_shingle = {}
    for i, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    near = {p for group in by_shingle.values() for p in combinations(group, 2)}
    near |= {(i, j) for i, j in combinations(range(len(rows)), 2) if rows[i][0] is not None and rows[i][0] == rows[j][0]}
    for i, j in near:
        both = len(sets[i] & sets[j])
        same = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
        if same or both and 100 * both >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def run(spark, rows, schema="doc_id long, text string"):
    got = nd.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None and r.component_id is not None)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr)


def test_edges_chains_and_copies(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    rows = [(50, None), (51, ""), (52, " \n"), (53, "A b"), (54, "a B"), (55, "a b c d e"), (56, "A b c d e")]
    chain = list(base)
    for i in range(12):  # each step is near the last one, not near the first
        rows.append((100 - i, " ".join(chain)))
        chain[8 * i : 8 * i + 2] = [f"n{i}", f"m{i}"]
    rows += [(200 + i, " ".join(base[:60] + [f"u{i}x{j}" for j in range(60)])) for i in range(10)]  # a shared passage, not near
    rows += [(300 + i, "same text here for all of them " * 4) for i in range(20)] + [(None, "same text here for all of them " * 4), (None, "alone with no id at all here"), (100, rows[7][1])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "x y z")]) == [(1, 0, 1), (2, 1, 2)]


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nd.op5_near_dup(spark, "/root/testdata/sf0.01").collect()), key=repr)
    assert got == brute(rows)


def test_stage_keeps_one_of_each(spark):
    rows = [(3, "one two three four five six", "x"), (1, "one two three four five six", "y"), (1, "one two three four five six", "y"), (2, None, "z"), (None, "q r s t u v", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = nd.near_dup_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=repr) == [1, 2, None]


def test_sketches():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.75, 0.9):
        errors = []
        for _ in range(30):
            pool = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            cut = int(1000 * share)
            a = np.concatenate([pool[:cut], pool[cut : cut + (1000 - cut) // 2]])
            b = np.concatenate([pool[:cut], pool[cut + (1000 - cut) // 2 :]])
            errors.append(nd.estimate(nd.registers(a)[None], nd.registers(b)[None], np.array([len(a)]), np.array([len(b)]))[0] - share)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    assert (nd.merge(nd.registers(a), nd.registers(b)) == nd.registers(np.union1d(a, b))).all()
    sets = list(nd.shingle_sets(pa.array(["a b c d e f", None, "a b"], pa.string())))
    assert [len(s) for s in sets] == [2, 0, 1]


def test_sql_agrees():
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(((d, n, c) for d, n, c, _ in con.execute(nd.ORACLE).fetchall()), key=repr)
    assert got == brute([(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()])
