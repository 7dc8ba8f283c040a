"""Kept indexes, runs, sketches and gold sets on small made cases."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.operators import curate, evaluate, gold, index, runs, sketches, vectors
from quern.plans import catalogue


def exact(x, ids, q, k):
    out = []
    for v in q:
        s = x @ v
        out.append([(ids[i], float(s[i])) for i in np.lexsort((ids, -np.round(s, 9)))[:k]])
    return out


@pytest.mark.parametrize("kind", ["clusters", "even"])
def test_vector_index(spark, tmp_path, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16))
    if kind == "clusters":
        x = rng.normal(size=(30, 16))[rng.integers(0, 30, 3000)] * 4 + x * 0.2
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(9000, None), (9001, []), (9002, [float("nan")] * 16), (9003, [None] + [1.0] * 15), (9004, [1.0])]
    path = vectors.write_vectors(spark.createDataFrame(rows, "id long, v array<double>"), str(tmp_path / "v"), "id", "v")
    asked = spark.createDataFrame(rows[:3000:60] + [(9000, None), (9004, [1.0])], "q long, v array<double>")
    hits, reading = vectors.search_vectors(spark, path, asked, query_col="q", vec_col="v", id_col="id", k=7)
    got = {}
    for r in hits.orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.id, r.score))
    want = exact(x, np.arange(3000), x[::60], 7)
    assert sorted(got) == list(range(0, 3000, 60))
    for q, near in zip(range(0, 3000, 60), want, strict=True):
        assert [i for i, _ in got[q]] == [i for i, _ in near] and [s for _, s in got[q]] == pytest.approx([s for _, s in near])
    share = [r.blocks_read / r.blocks for r in reading.collect()]
    assert len(share) == 50 and (max(share) <= 0.5 if kind == "clusters" else max(share) <= 1)
    empty = vectors.write_vectors(spark.createDataFrame([], "id long, v array<double>"), str(tmp_path / "none"), "id", "v")
    assert vectors.search_vectors(spark, empty, asked, query_col="q", vec_col="v", id_col="id", k=7)[0].count() == 0


def test_lexical_index_in_small_blocks(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    words = np.array([f"w{i}" for i in range(60)])
    docs = [(f"d{i:03d}", rng.choice(words, rng.integers(0, 12)).tolist()) for i in range(300)] + [("d900", None), ("d901", ["w1"] * 4), ("d902", ["w1"] * 4)]
    asked = [(i, rng.choice(words, 5).tolist()) for i in range(20)] + [(50, ["nowhere"]), (51, []), (52, ["w1", "w1", "w2"])]
    df = spark.createDataFrame(docs, "id string, t array<string>").repartition(7)
    q = spark.createDataFrame(asked, "q int, t array<string>")
    path = index.write_lexical(df, F.col("t"), str(tmp_path / "l"), "id")
    monkeypatch.setattr(index, "SLICE_TERMS", 30)
    got = {}
    for r in index.search_lexical(spark, path, q, F.col("t"), id_col="id", query_col="q", k=6).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.id, round(r.bm25, 8)))
    held = {d: t for d, t in docs if t}
    n, mean = len(docs), sum(map(len, held.values())) / len(docs)
    df_of = {w: sum(w in t for t in held.values()) for w in {w for t in held.values() for w in t}}
    raw = {w: np.log(n - c + 0.5) - np.log(c + 0.5) for w, c in df_of.items()}
    idf = {w: 0.25 * np.mean(list(raw.values())) if v < 0 else v for w, v in raw.items()}
    for i, terms in asked:
        scored = []
        for d, t in held.items():
            s = sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in terms if w in t)
            if any(w in t for w in terms):
                scored.append((d, round(s, 8)))
        scored = sorted(sorted(scored, reverse=True), key=lambda r: -r[1])[:6]
        assert got.get(i, []) == scored, i
    shares = index.search_share(spark, path, q, F.col("t"), id_col="id", query_col="q", k=3).where("q = 52").orderBy("rank").collect()
    best = sorted((-round(len({"w1", "w2"} & set(t)) / len(set(t)), 9), d) for d, t in held.items() if {"w1", "w2"} & set(t))[:3]
    assert [(-round(r.score, 9), r.id) for r in shares] == best


def _counting(made, sizes):
    """A factory of batch functions whose batches are counted."""

    def factory(*a):
        run = made(*a)

        def counted(batches):
            def seen():
                for b in batches:
                    sizes.add({b.num_rows})
                    yield b

            yield from run(seen())

        return counted

    return factory


def test_blocks_come_in_few_rows_at_once(spark, tmp_path, monkeypatch):
    sizes = spark.sparkContext.accumulator(set(), type("Sizes", (AccumulatorParam,), {"zero": lambda self, v: set(), "addInPlace": lambda self, a, b: a | b})())
    docs = spark.createDataFrame([(i, ["w", f"w{i % 9}"]) for i in range(40)], "id long, t array<string>").repartition(20)
    path = index.write_lexical(docs, F.col("t"), str(tmp_path / "many"), "id")
    spark.read.parquet(f"{path}/blocks").repartition(1).write.parquet(f"{path}/one")  # a block for each partition, in one file
    (tmp_path / "many" / "blocks").rename(tmp_path / "many" / "old")
    (tmp_path / "many" / "one").rename(tmp_path / "many" / "blocks")
    monkeypatch.setattr(index, "_search_blocks", _counting(index._search_blocks, sizes))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = index.search_lexical(spark, path, spark.createDataFrame([(1, ["w3"])], "q int, t array<string>"), F.col("t"), id_col="id", query_col="q", k=3).orderBy("rank").collect()
    assert [r.id for r in found] == [39, 30, 21]
    assert 0 < max(sizes.value) <= 2
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_words_of_lower_cased_texts_are_found_in_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SPLIT_BYTES", 40)
    monkeypatch.setattr(index, "BLOCK_TOKENS", 7)
    texts = ["Le café, l'ÉTÉ et la mer", "", None, "a b c", "mer/mer\u00a0x9 \u212aelvin \u0130stanbul", "the the" * 30, "...", "Été d'or " * 9, "\u65e5\u672c mer\u65e5été", "mer"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    words, asked = t.french_tokens(F.col("text")), spark.createDataFrame([(1, "mer été"), (2, "kelvin or x9 the"), (3, "istanbul i stanbul")], "q int, text string")
    found, sizes = [], spark.sparkContext.accumulator(set(), type("Sizes", (AccumulatorParam,), {"zero": lambda self, v: set(), "addInPlace": lambda self, a, b: a | b})())
    monkeypatch.setattr(index, "_by_impact", _counting(index._by_impact, sizes))
    for name, column in (("words", words), ("texts", F.lower("text"))):
        path = index.write_lexical(docs, column, str(tmp_path / name), "id")
        blocks, terms = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/terms")
        assert [f.name for f in blocks.schema if f.dataType.typeName() == "array"] == ["ids"] and blocks.count() > 2
        search = [f(spark, path, asked, words, id_col="id", query_col="q", k=6) for f in (index.search_lexical, index.search_share)]
        found.append([sorted(map(tuple, df.collect())) for df in (terms, *search, spark.read.parquet(f"{path}/statistics"))])
    assert found[0] == found[1] and len(found[0][1]) > 6
    assert sizes.value == {1}


def test_a_run_goes_on_where_it_was_cut(spark, tmp_path):
    items = spark.createDataFrame([(i, i * i) for i in range(40)], "item long, v long")
    root, made = str(tmp_path / "runs"), []

    def answer(system, left):
        if system == "b" and len(made) == 7:
            raise RuntimeError("cut")
        made.append(system)
        return left.select("item", (F.col("v") + len(system)).alias("answer"))

    path = f"{root}/first"
    with pytest.raises(RuntimeError, match="cut"):
        runs.Run(spark, path).advance("results", ["a", "b"], items, "item", answer)
    assert made == ["a"] * 4 + ["b"] * 3 and runs.Run.latest(spark, root).endswith("/first")
    run = runs.Run(spark, path)
    assert run.done("results", "a") and not run.done("results", "b") and 0 < run.rows("results", "b").count() < 40
    assert [r.system for r in run.manifest().collect()] == ["a"]
    made.append("again")
    run.advance("results", ["a", "b"], items, "item", answer)
    assert made == ["a"] * 4 + ["b"] * 3 + ["again", "b"]  # one piece was left
    run.advance("scores", ["a", "b"], items, "item", lambda system, left: run.rows("results", system).join(left.select("item"), "item").select("item", (F.col("answer") % 5).alias("score")))
    whole = runs.Run(spark, f"{root}/second")
    whole.advance("results", ["a", "b"], items, "item", lambda s, left: left.select("item", (F.col("v") + len(s)).alias("answer")))
    rows = lambda r: sorted(tuple(x) for x in r.rows("results").select("system", "item", "answer").collect())
    assert rows(run) == rows(whole) and len(rows(run)) == 80
    assert sorted((r.stage, r.system, r.n_rows) for r in run.manifest().collect()) == [("results", "a", 40), ("results", "b", 40), ("scores", "a", 40), ("scores", "b", 40)]
    whole.complete()
    assert runs.Run.latest(spark, root).endswith("/first")
    run.complete()
    assert runs.Run.latest(spark, root) is None and runs.Run.latest(spark, f"{root}/nothing") is None


def test_sketches(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.lognormal(0, 3, 2000), -rng.lognormal(0, 1, 500), np.zeros(50)])
    df = spark.createDataFrame([(int(i % 3), float(x)) for i, x in enumerate(v)] + [(0, None), (0, float("nan"))], "g int, v double")
    parts = sketches.quantile_sketch(df.withColumn("p", F.rand(1) < 0.5), ["p", "g"], "v")
    got = sketches.sketch_quantiles(sketches.merge_sketches(parts, ["g"]), ["g"], [0, 1, 25, 50, 99, 100]).collect()
    assert len(got) == 18
    for r in got:
        mine = np.sort(v[np.arange(len(v)) % 3 == r.g])
        true = mine[min(int(len(mine) * r.pct / 100), len(mine) - 1)]
        assert abs(r.value - true) <= 0.01 * abs(true) + 1e-9
    items = np.concatenate([np.repeat(np.arange(5), 400), rng.integers(100, 100_000, 6000)])
    df = spark.createDataFrame([(int(i),) for i in rng.permutation(items)] + [(None,)], "i long").repartition(4)
    heavy = {r.i: r.n for r in sketches.heavy_items(df, "i", 0.03, 80).collect()}
    assert heavy == {i: 400 for i in range(5)}
    bounds = sketches.merge_frequent(sketches.frequent_sketch(df, "i", 80), "i").collect()
    assert all(r.least <= 400 <= r.most for r in bounds if r.i < 5) and max(r.most - r.least for r in bounds) <= 8000 / 80
    with pytest.raises(ValueError, match="counters"):
        sketches.heavy_items(df, "i", 0.001, 100)


def test_gold_set(spark):
    long = "quels sont les documents nécessaires pour obtenir une carte nationale au maroc cette année svp merci"
    raw = [(1, long, "SIMPLE", "french"), (2, long + " bonjour", "SIMPLE", "french"), (3, "  ", "SIMPLE", "french"), (4, "une question neuve", None, "Darija"), (5, "une question NEUVE !", "LEGAL", None), (6, "une autre demande", "MULTIHOP", "french"), (7, "encore une autre chose", "odd", "french")]
    raw = spark.createDataFrame([(i, q, c, lang, "a", None, None) for i, q, c, lang in raw], "i int, question string, category string, language string, gold_answer string, is_multihop boolean, should_abstain boolean")
    old = spark.createDataFrame([("S7", "une autre demande ?"), ("M2", "une AUTRE demande"), ("x", "zzz"), ("D05", "yyy")], "id string, question string")
    got = sorted((r.i, r.category, r.item_key) for r in gold.build_set(raw, old, ["i"]).collect())
    assert got == [(1, "SIMPLE", "S8"), (4, "DARIJA", "D6"), (7, "ODD", "O1")]
    assert len(gold.build_set(raw, old.limit(0), ["i"]).collect()) == 4


def test_numbers_within_a_hot_prefix(spark):
    df = spark.createDataFrame([(int(i), "SIMPLE" if i % 10 else "LEGAL") for i in np.random.default_rng(4).permutation(500)], "i int, category string")
    got = sorted((r.i, r.item_key) for r in curate.next_ids(df, "category", ["i"], {"S": 3}).collect())
    count, want = {"S": 3, "L": 0}, []
    for i in range(500):
        p = "S" if i % 10 else "L"
        count[p] += 1
        want.append((i, f"{p}{count[p]}"))
    assert got == want


def test_token_matching(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [3.0, 3.0])], "place int, vector array<float>")
    rows = [("a", [0, 0, 1], [2]), ("b", [0], [0]), ("c", [], [1]), ("d", [7], [1])]
    got = {r.k: (r.precision, r.recall) for r in evaluate.token_matching(spark.createDataFrame(rows, "k string, said array<int>, meant array<int>"), table, ["k"]).collect()}
    half = 0.5**0.5
    assert got["a"] == pytest.approx((half, half)) and got["b"] == pytest.approx((1, 1)) and got["c"] == got["d"] == (0, 0)


def test_overlap_pairs_by_rare_tokens(spark, monkeypatch):
    rng = np.random.default_rng(4)
    sets = [{f"c{j}" for j in range(10)} | {f"own{i}-{j}" for j in range(10)} for i in range(60)]
    apart = spark.createDataFrame([(i, sorted(t), len(t)) for i, t in enumerate(sets)], "id long, tokens array<string>, n int")
    kept, keep = [], curate.Scratch.keep
    monkeypatch.setattr(curate.Scratch, "keep", lambda self, df: kept.append(keep(self, df)) or kept[-1])
    assert curate.overlap_pairs(apart, "id").count() == 0
    assert kept[0].groupBy("token").count().where("count > 1").count() == 0  # none is looked up under what all hold
    base = [rng.choice(80, n, replace=False).tolist() for n in rng.integers(1, 40, 25)]
    for size in (1, 2, 3, 5):
        base += [rng.choice(6, size, replace=False).tolist() for _ in range(4)]
    near = [b[: len(b) - int(cut)] + rng.choice(80, int(more)).tolist() for b in base for cut, more in rng.integers(0, 4, (4, 2))]
    sets = sorted({frozenset(f"w{x}" for x in t) for t in base + near if t}, key=sorted)
    want = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * max(len(sets[a]), len(sets[b]))}
    df = spark.createDataFrame([(i, sorted(t), len(t)) for i, t in enumerate(sets)], "id long, tokens array<string>, n int").repartition(3)
    got = [(r.a, r.b) for r in curate.overlap_pairs(df, "id").collect()]
    assert len(want) > 20 and sorted(got) == sorted(want)


@pytest.mark.parametrize("name", ["hybrid_retrieve", "context_metrics"])
def test_only_hits_are_joined_to_texts(spark, monkeypatch, name):
    monkeypatch.setattr(index, "BLOCK_TOKENS", 5000)
    before, found = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (index.HITS_SENT, 0):
            monkeypatch.setattr(index, "HITS_SENT", most)
            df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
            moved = "hashpartitioning(doc_id" in df._jdf.queryExecution().executedPlan().toString()
            assert moved == (most == 0)  # texts are shuffled for many hits only
            found.append(sorted(map(tuple, df.collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found[0] == found[1] and len(found[0]) > 5


def test_a_writer_keeps_no_values_of_blocks_for_statistics(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words{i} here") for i in range(50)], "id long, text string")
    path = index.write_lexical(docs, F.lower("text"), str(tmp_path / "lexical"), "id")
    for kind in ("raw", "blocks"):
        groups = [m.row_group(i) for f in (tmp_path / "lexical" / kind).glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
        columns = [g.column(j) for g in groups for j in range(g.num_columns)]
        assert columns and not any(c.is_stats_set for c in columns), path
