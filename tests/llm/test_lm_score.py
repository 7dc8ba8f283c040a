import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from quern.llm import lm_score as lm
from quern.llm.bpe import coder, tokenizer_definition

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute_base(rows):
    words = [WORD.findall((t or "").translate(LOWER)) for _, t in rows]
    held = [d is None or zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    c = Counter(x for w, h in zip(words, held, strict=True) if not h for x in [*w, None])
    n, v = sum(c.values()), len(c)
    return [(d, h, len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None])) for (d, _), w, h in zip(rows, words, held, strict=True)]


def model_for_test():
    rng = np.random.default_rng(3)
    counts, pairs = rng.integers(0, 50, lm.IDS).astype(float), rng.integers(0, 9, (lm.IDS, lm.CLASSES)).astype(float)
    ends = lm.word_ends(tokenizer_definition(None, "word_bpe_49k.json"))
    model = lm.fit_start(counts, lm.regroup(counts, ends, pairs), pairs)
    return model | {n: model[n] + rng.normal(0, 0.2, s).astype(np.float32) for n, s in lm.SHAPES.items()}


def stream(docs):
    sub = np.array([x for d in docs for x in d], "<u2")
    return lm.Stream([len(d) for d in docs], np.arange(len(sub), dtype="<u4").tobytes(), sub.tobytes(), np.ones(len(sub), "<u4").tobytes())


def test_each_id_is_scored_once_in_its_window():
    model, rng = model_for_test(), np.random.default_rng(1)
    docs = [rng.integers(0, 49000, n).tolist() for n in (0, 1, 30, 31, 32, 33, 55, 56, 57, 200)]
    s = stream(docs)
    logp = lm.score_stream(model, s, chunk=3)
    got, _ = lm.token_scores(logp, s, np.zeros(0), 0)
    mixed, spelled = lm.token_scores(logp, s, np.full(len(s.is_word), 7), 70)
    assert np.allclose(spelled, got)
    by_hand = [sum(np.log10(0.5 * np.exp(logp[i]) + 0.05) for i in range(a, b)) for a, b in zip(s.first, s.first[1:], strict=False)]
    assert np.allclose(mixed, by_hand)
    for d, value in zip(docs, got, strict=True):
        ids, target, total = [lm.START, *d], [*d, lm.END], 0.0
        for at in range(len(target)):
            begin = 0 if at < lm.WINDOW else -(-(at - lm.WINDOW + 1) // lm.STRIDE) * lm.STRIDE
            window = np.array([(ids[begin : at + 1] + [0] * lm.WINDOW)[: lm.WINDOW]])  # what comes after has no effect
            z = lm.forward(model, window)["z"][0, at - begin]
            total += z[model["classes"][target[at]]] - np.log(np.exp(z).sum()) + model["inner"][target[at]]
        assert abs(total / np.log(10) - value) < 1e-2 * (1 + abs(value)) * 0.01
    p = np.exp(model["inner"].astype(float))
    sums = np.bincount(model["classes"], p)
    assert np.allclose(sums[sums > 0], 1, atol=1e-3)  # so ids' probabilities sum to 1, but for what classes without ids get


def test_gradients_match_differences():
    model, rng = model_for_test(), np.random.default_rng(2)
    model = {n: v.astype(np.float64) if v.dtype.kind == "f" else v for n, v in model.items()}
    ids, target = rng.integers(0, 49000, (3, lm.WINDOW)), rng.integers(0, 49000, (3, lm.WINDOW))
    scored = rng.random((3, lm.WINDOW)) < 0.7
    g, _ = lm.gradients(model, ids, target, scored)
    for name in lm.SHAPES:
        at = tuple(rng.integers(0, s) for s in lm.SHAPES[name])
        losses = []
        for step in (1e-4, -1e-4):
            moved = model[name].copy()
            moved[at] += step
            losses.append(lm.gradients(model | {name: moved}, ids, target, scored)[1])
        assert abs((losses[0] - losses[1]) / 2e-4 - g[name][at]) < 1e-4, name


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    rows += [(None, "No id HERE"), (9001, None), (9002, ""), (9003, "the " * 30000), (3, rows[3][1]), (9004, "  \x85 ÀÉ é")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    got = sorted((tuple(r) for r in lm.score_documents(docs.repartition(3)).collect()), key=repr)
    want = sorted(brute_base(rows), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 * abs(w[5])
        assert -1e9 < g[6] <= 0
    held = [g for g in got if g[1] and g[0] is not None and g[0] < 9000]
    assert sum(g[6] for g in held) > 1.5 * sum(g[5] for g in held)  # on few texts, most words are spelled
    assert lm.score_documents(docs.limit(0)).count() == 0
    alone = lm.score_documents(docs.where("doc_id is null")).collect()
    assert len(alone) == 1 and alone[0].n_known == 0 and alone[0].train_tokens == 0


def test_subwords():
    definition = tokenizer_definition(None, "word_bpe_49k.json")
    words = ["hello", "the,", "d'été", "日本", "<|endoftext|>", "\x85", "x" * 300, "ÀÉ", "don't"]
    want = [coder(definition).encode_piece(w) for w in words]
    assert want[0] == [3306]
    ids = lm.SubwordIds(definition)
    ids.table = lm.PieceTable(3)  # has room for five words
    for part in (words, words[:4], words[3:]):
        hashes = np.array([zlib.crc32(w.encode()) for w in part], np.uint64)
        counts, flat = ids.of(hashes, lambda i, part=part: part[i].encode())
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [want[words.index(w)] for w in part]


def test_extreme_logits_stay_finite():
    model = model_for_test()
    ids = np.random.default_rng(4).integers(0, 49000, (2, lm.WINDOW))
    for scale in (1, 300):
        steep = model | {"U": model["U"] * np.float32(scale), "b": model["b"] - np.float32(200 * scale), "Wq": model["Wq"] * np.float32(scale)}
        z = lm.class_scores(steep, ids, lm.WINDOW).astype(float)
        want = z - z.max(axis=2, keepdims=True)
        want = np.exp(want) / np.exp(want).sum(axis=2, keepdims=True)
        x = z.astype(np.float32)
        p, sums, _ = lm.exp_rows(x)
        assert np.isfinite(sums).all() and np.allclose(p / sums[..., None], want, atol=1e-4)


def test_training_lowers_held_out_loss_and_order_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    definition = tokenizer_definition(None, "word_bpe_49k.json")
    blocks = lm.encode_blocks(docs)
    started, rounds = lm.fit_model(blocks, lm.word_ends(definition), rounds=0), lm.fit_model(blocks, lm.word_ends(definition))
    losses = [[], []]
    for batch in blocks.toArrow().to_batches():
        for i, s in lm._streams(batch):
            held = np.repeat(batch.column(2)[i].values.to_numpy(zero_copy_only=False).astype(bool), s.lengths)
            for k, model in enumerate((started, rounds)):
                losses[k].append(-lm.score_stream(model, s)[held])
    before, after = (np.concatenate(x).mean() for x in losses)
    assert after < before - 0.05
    words = [3306, 1200, 900, 17000, 4000, 300, 25000]
    there, back = (lm.token_scores(lm.score_stream(rounds, s), s, np.zeros(0), 0)[0] for s in (stream([words]), stream([words[::-1]])))
    assert abs(there[0] - back[0]) > 1e-3


def test_each_training_id_is_in_one_round(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    batches = lm.encode_blocks(docs).toArrow().to_batches()
    scored = [sum(int(m.sum()) for _, _, m in lm.training_windows(batches, r)) for r in range(lm.ROUNDS)]
    want = 0
    for batch in batches:
        for i, s in lm._streams(batch):
            want += int(s.lengths[~batch.column(2)[i].values.to_numpy(zero_copy_only=False).astype(bool)].sum())
    assert sum(scored) == want and min(scored) > want / lm.ROUNDS * 0.8


def test_blocks_stay_where_they_are(spark):
    docs = spark.createDataFrame([(i, f"word{i % 5} other {i}") for i in range(40)], "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = lm.score_documents(docs)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Bucketed: true") >= 1 and "lm_score_" not in " ".join(r.tableName for r in spark.sql("SHOW TABLES").collect())
        block_side = plan[plan.rindex("Bucketed: true") - 4000 :].split("FileScan")[0]
        assert scored.count() == 40 and "Exchange" not in block_side.splitlines()[-2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_small_attention_weights_are_zero():
    """Weights far below a row's largest are numbers near the least float, which made each step three times as slow."""
    model, rng = model_for_test(), np.random.default_rng(6)
    model = model | {"Wq": model["Wq"] * np.float32(40)}  # inner products of some hundreds, as over the given texts
    x = lm.inputs(model, rng.integers(0, 49000, (5, lm.WINDOW)))
    y = lm.times(x, lm.joined(model)[0])
    z = np.einsum("wid,wjd->wij", y.astype(float), x.astype(float))
    z[:, ~np.tri(lm.WINDOW, dtype=bool)] = -np.inf
    assert z.max() > 100
    want = np.exp(z - z.max(axis=2, keepdims=True))
    e, sums, seen = lm.attention(x, y)
    assert not ((e > 0) & (e < 1e-30)).any() and ((want > 0) & (want < 1e-38)).any()
    assert (e[~(want > 0).transpose(2, 0, 1)] == 0).all()
    want /= want.sum(axis=2, keepdims=True)
    assert np.allclose((e / sums).transpose(1, 2, 0), want, atol=1e-3)
    assert np.allclose(seen, want @ x, atol=1e-2 * np.abs(x).max())


def test_merges_in_arrays_are_the_library():
    definition, rng = tokenizer_definition(None, "word_bpe_49k.json"), np.random.default_rng(7)
    alphabet = [chr(c) for c in range(33, 127)] + [*"àéßÿÉÀÞ×÷ª日Σ\u0301\u0130\x85\xa0"] + ["a", "e", "th", "tion", "ing"] * 12
    words = ["".join(alphabet[i] for i in rng.integers(0, len(alphabet), rng.integers(1, 14))) for _ in range(3000)]
    words += [*alphabet, "\x85", "don't", "'s", "<|endoftext|>", "x" * 300, "aaaaaaa", "12ab34", "..!!"]
    raw = [w.encode() for w in words] + [b"a\xc3", b"\xa9b", b"\xff"]  # the last aren't UTF-8
    ids = lm.SubwordIds(definition)
    counts, flat = ids.encode(*lm._joined(raw))
    got = [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    for w, x in zip(raw, got, strict=True):
        assert x == ids.tokenizer.encode([w.decode("utf-8", "replace")], is_pretokenized=True, add_special_tokens=False).ids, w
    known = ids.merges.known(*(lambda d, n: (d, np.concatenate([[0], np.cumsum(n)])))(*lm._joined(raw)))
    assert known.sum() > 1000 and not known[-3:].any()


def test_counts_of_distinct_words_are_those_of_streams(spark):
    rows = [(1, "one two \x85 three"), (2, None), (3, "\x85"), (4, "two two"), (5, ""), (6, "\x85 one \x85 \x85 one"), (7, "three one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    held_seen = 0
    for part in (docs, docs.where("doc_id = 3"), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        for batch in lm.encode_blocks(part).toArrow().to_batches():
            for i, s in lm._streams(batch):
                held = np.array(batch.column(2)[i].as_py(), bool)
                held_seen += held.sum()
                train = np.repeat(~held, s.lengths)
                w = lm.TrainingWords(batch, i)
                got = Counter()
                for a, b, n in zip(*(x.tolist() for x in w.pairs()), strict=True):
                    got[a, b] += n
                assert +got == Counter(zip(s.before[train].tolist(), s.target[train].tolist(), strict=True))
    assert held_seen
