import itertools
import math
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quern.llm import decontaminate as dc
from quern.llm.textbatch import IS_ALNUM, LOWER, span_hashes, texts_of, words_of

WORD = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")
SF = "/root/testdata/sf0.01"


def tokens(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]


def brute_scores(texts, items, threshold):
    """Every (text, passage start, item) of at least the threshold, scored in full."""
    bags = [(i, Counter(tokens(t)), len(tokens(t))) for i, t in items]
    df = Counter(w for _, bag, _ in bags for w in bag)
    mean = sum(n for *_, n in bags) / len(bags)
    widths = [64 if n <= 64 else 256 if n <= 256 else 1024 for *_, n in bags]
    out = {}
    for (d, text), width in itertools.product(enumerate(texts), sorted(set(widths))):
        words = tokens(text)
        starts = range(0, max(1, len(words) - width) if len(words) > width else 1, width) if words else []
        for first in starts:
            passage = set(words[first : first + 2 * width])
            for i, bag, n in [b for b, w in zip(bags, widths, strict=True) if w == width]:
                impact = {w: math.log1p((len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) for w, tf in bag.items()}
                score = sum(v for w, v in impact.items() if w in passage) / sum(impact.values())
                if score >= threshold:
                    out[d, first, i] = score
    return out


@pytest.mark.parametrize("threshold", [0.25, 0.5])
def test_retrieval_is_exhaustive(spark, threshold):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    items += [(900, " ".join(x[1] for x in items[:4])), (901, " ".join(x[1] for x in items[7:17]))]  # of longer classes
    texts = [None, "", "a", items[-2][1], "x " * 100 + items[-1][1]] + pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:150] + [items[3][1] + " x " + items[5][1]]
    (indexes,) = dc.build_indexes(spark.createDataFrame(items, "item_id long, text string"))
    assert len(indexes) == 3
    got = {}
    for t, index in ((t, x) for t in texts_of(pa.array(texts, pa.string())) for x in indexes):
        w = words_of(t, IS_ALNUM)
        for i, first, _, item, score in dc.retrieve(t, w, span_hashes(LOWER[t.data], w.start, w.end), index, threshold):
            got[t.lo + i, first - int(w.first[i]), index.ids[item]] = score
    want = brute_scores(texts, items, threshold)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_verbatim_passages_are_found_and_clean_texts_left(spark):
    squeezed = lambda x: " ".join(tokens(x))
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    verbatim = {(d["doc_id"], i["item_id"]) for i in items for d in docs if squeezed(i["text"]) in squeezed(d["text"])}
    got = {(r.doc_id, r.item_id) for r in dc.op2_decontaminate(spark, SF).collect()}
    assert verbatim and verbatim <= got and len(got - verbatim) <= 0.2 * len(verbatim)


def test_edges_and_slices(spark):
    items = [(1, "What is the tall green tower made of? It is made of old iron plates."), (2, None), (3, "..."), (None, "Which river runs past the old mill there? The quiet Marne runs past it."), (1, "one two")]
    bench = spark.createDataFrame([(*i, 0.5) for i in items], "item_id long, text string, score double")
    data = [(1, "Intro words. WHAT is the tall green tower made of?\nIt is made of old iron plates. More words follow here."), (2, None), (3, ""), (None, "well " * 40000 + items[3][1]),
            (5, "the tall tower is green and old"), (1, "Intro words. WHAT is the tall green tower made of?\nIt is made of old iron plates. More words follow here.")]
    docs = spark.createDataFrame([(*d, "s") for d in data], "doc_id long, text string, item_id string")
    whole = sorted((r.doc_id or -1, r.item_id or -1, round(r.score, 6)) for r in dc.find_leaks(docs, bench).collect())
    assert [x[:2] for x in whole] == [(-1, -1), (1, 1), (1, 1)]
    sliced = sorted((r.doc_id or -1, r.item_id or -1, round(r.score, 6)) for r in dc.find_leaks(docs, bench, slice_items=1).collect())
    assert sliced == whole
    kept = dc.drop_leaked(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5]
    assert dc.find_leaks(docs.limit(0), bench).count() == 0 and dc.find_leaks(docs, bench.limit(0)).count() == 0
    assert dc.drop_leaked(docs, bench.limit(0)).count() == len(data)


def test_a_long_item_changes_no_other_verdict(spark):
    question, answer = "Which of the seven hills did the old shepherd climb before dawn?", "He climbed the steep hill by the broken mill."
    bench = [(1, f"{question} {answer}"), (2, "What else is there? Nothing but rain on the roof today.")]
    far = [(1, f"{question} " + "filler " * 1500 + answer)]
    docs = spark.createDataFrame(far, "doc_id long, text string")
    long_item = [(3, " ".join(f"w{i}" for i in range(3000)))]
    for items in (bench, bench + long_item):
        assert dc.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    copied = spark.createDataFrame([(7, "x " * 777 + long_item[0][1] + " y" * 50)], "doc_id long, text string")
    assert [r.item_id for r in dc.find_leaks(copied, spark.createDataFrame(bench + long_item, "item_id long, text string")).collect()] == [3]
