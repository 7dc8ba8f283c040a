import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from quern.llm.language_id import A, keep_determined, letter_table, op8_language_id, predict_language, profiles, trigram_vectors
from quern.llm.textbatch import texts_of


def brute_vector(text):
    table, letters = letter_table(), [0]
    for c in [*(text or ""), " "]:
        i = int(table[ord(c)])
        if i or letters[-1]:
            letters.append(i)
    total = np.zeros(512)
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        total += trigram_vectors(np.array([(a * A + b) * A + c]))[0]
    return total / max(np.linalg.norm(total), 1e-9)


def test_profiles_match_brute_force():
    texts = [None, "", "a", "Z", "水", "1a", "水火", "ab", "Élan vital", "!!", "a  b  c", "x" * 9, "日本語 тест 🙂 ok"] + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:5]
    got = np.concatenate([profiles(t)[0] for t in texts_of(pa.array(texts, pa.string()), 40)])
    assert np.allclose(got, [brute_vector(x) for x in texts], atol=1e-4)


def test_edges(spark):
    rows = [(i, x, "en" if i % 2 else None, "s") for i, x in enumerate([None, "", "123 !?", "the cat sat on the mat " * 40, "the", "q", "the cat sat"])]
    docs = spark.createDataFrame(rows + rows[:2] + [(None, "the cat", "en", "s")], "doc_id long, text string, lang string, score string")
    got = predict_language(docs).collect()
    assert len(got) == len(rows) + 3
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got)
    assert by_id[None].held_out
    for i in range(len(rows)):
        assert by_id[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert predict_language(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in predict_language(docs.where("lang is null")).collect()} == {"und"}
    assert keep_determined(docs).columns == docs.columns


def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    held = [r for r in op8_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    right = sum(r.lang_pred == lang[r.doc_id] for r in held)
    assert right > 0.98 * len(held)


def test_verdicts_against_a_plain_loop(spark):
    """Prototypes, cosines and ties of the whole query, text by text."""
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()[:60]
    rows = [(r["doc_id"], (r["text"] or "")[:400], r["lang"]) for r in table]
    rows += [(i, x, None) for i, x in enumerate(["a", "ß", "ab", "1a", "水火", "é", "le", "der", "", "12"], 10_000)]
    rows += [(i, "qqqq", lang) for i, lang in ((20_001, "zz"), (20_003, "aa"))]  # two languages with one profile
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i in (20_001, 20_003))
    sums = {}
    for i, text, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            v = sums.setdefault(lang, np.zeros(512))
            letters, codes = [0], letter_table()
            for c in [*text, " "]:
                if codes[ord(c)] or letters[-1]:
                    letters.append(int(codes[ord(c)]))
            for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
                v += trigram_vectors(np.array([(a * A + b) * A + c]))[0]
    langs = sorted(sums)
    prototypes = [sums[x] / max(np.linalg.norm(sums[x]), 1e-9) for x in langs]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for r in predict_language(df).collect():
        text = next(t for i, t, _ in rows if i == r.doc_id)
        if not any(letter_table()[ord(c)] for c in text):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        cosines = [float(brute_vector(text) @ p) for p in prototypes]
        assert abs(r.score - min(1, max(0, max(cosines)))) < 1e-4
        near = [x for x, c in zip(langs, cosines, strict=True) if c > max(cosines) - 1e-4]
        assert r.lang_pred in near and (text != "qqqq" or r.lang_pred == "aa")
