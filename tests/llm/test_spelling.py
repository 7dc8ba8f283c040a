import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    found = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in found.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 10 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(found[w]), form.get(w), words.get(form.get(w)), root))
    return sorted(out)


def made(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_groups(df, **kw).collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    letters = list("abcdéÿ")
    words = ["".join(rng.choice(letters, rng.integers(7, 10))) for _ in range(60)]
    words += [w[:i] + rng.choice(letters) + w[i + rng.integers(0, 2) :] for w in words for i in rng.integers(0, len(w), 6)]
    weight = [400 if i < 20 else 40 if i < 60 else 3 for i in range(len(words))]
    texts = [" ".join(rng.choice(words, 300, p=np.array(weight) / sum(weight))) for _ in range(40)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, None), (3, ""), (3, texts[3]), (7, "A" * 100_000 + " ×÷" * 5 + "x" * 70)]


@pytest.mark.parametrize("n_ranges", [None, 5])
def test_brute_force(spark, rows, n_ranges):
    want = brute(rows)
    assert sum(r[3] is not None for r in want) > 20 and sum(r[2] for r in want) > 200
    assert made(spark, rows, n_ranges=n_ranges) == want


def test_chain_of_forms(spark):
    rows = [(i, " ".join(["abcdefgh"] * 300 + ["abcdefgx"] * 30 + ["abcdefyx"] * 3)) for i in range(1)]
    got = {r[0]: r for r in made(spark, rows)}
    assert got["abcdefyx"][3] == "abcdefgx" and got["abcdefyx"][5] == "abcdefgh" and got["abcdefgh"][3] is None


def test_empty(spark):
    assert made(spark, []) == [] and made(spark, [(1, None), (2, "")]) == []


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in spelling.op12_spelling_groups(spark, "/root/testdata/sf0.001").collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_automaton_numbers_and_errors():
    rng = np.random.default_rng(6)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(1, 7))) for _ in range(400)})
    lexicon = spelling.Automaton(words)
    for i, w in enumerate(words):
        state, number = lexicon.walk(w, lexicon.root, 0)
        assert lexicon.final[state] and number == i
    assert len(lexicon.edges) < len(words)
    for w in words[::7]:
        assert {words[i] for i in lexicon.one_error(w, 0)} == {v for v in words if near(w, v)}
        both = [words[i] for i in spelling.near_in(lexicon, words, w, len(w) // 2, False)]
        back = sorted(v[::-1] for v in words)
        other = spelling.Automaton(back)
        both += [back[i][::-1] for i in spelling.near_in(other, back, w[::-1], len(w) - len(w) // 2, True)]
        assert sorted(both) == sorted(v for v in words if near(w, v))
    assert spelling.Automaton([]).one_error("abc", 1) == set()


def test_checksums():
    data = np.frombuffer(bytes(range(97, 123)) * 10, np.uint8)
    start, end = np.array([0, 5, 3, 7]), np.array([7, 5, 180, 70])
    prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in range(4)], np.uint32)
    want = [zlib.crc32(f"{i}:".encode() + data[a:b].tobytes()) for i, (a, b) in enumerate(zip(start, end, strict=True))]
    assert spelling.checksums(prefix, data, start, end).tolist() == want
