import math
import random
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import pyarrow.parquet as pq

from quern.llm import quality as q
from quern.llm.quality import keep_quality, measure, op9_quality_rules, quality_rules
from quern.llm.textbatch import texts_of, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [None, "", "\n", "\n\nab\n", "a b", "x\nx\n x\nx", "one two three four five " * 9, "é ñ ü # $$ |", " \t\n", "a b c d e f a b c d e",
        "\nlead\nlead", "w " * 30000, "tail\n", "tail\ntail"]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n)


def test_measures_match_brute_force():
    texts = EDGE + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() + EDGE
    for limit in (64, 1 << 14, 1 << 22):
        got = []
        for t in texts_of(pa.array(texts, pa.string()), limit):
            got += zip(*(x.tolist() for x in measure(t, words_of(t)).values()), strict=True)
        assert got == [brute(x) for x in texts]


def test_edges(spark):
    docs = spark.createDataFrame([(i, x, "q") for i, x in enumerate(EDGE)] + [(None, "a", "b")], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_rules(docs, labels).collect()
    assert len(rows) == len(EDGE) + 1
    assert not [r for r in rows if r.kept and r.base_failed]
    assert keep_quality(docs, labels).count() == sum(r.kept for r in rows)
    assert quality_rules(docs.limit(0), labels.limit(0)).count() == 0
    assert {r.llr for r in quality_rules(docs, labels.limit(0)).collect()} == {0.0}


def test_keeps_clean_and_rejects_poor(spark):
    rows = {r.doc_id: r.kept for r in op9_quality_rules(spark, "/root/testdata/sf0.01").collect() if not r.base_failed}
    labels = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()
    clean = [rows[x["doc_id"]] for x in labels if x["quality"] == 1 and x["toxic"] == 0 and x["doc_id"] in rows]
    poor = [rows[x["doc_id"]] for x in labels if x["quality"] == 0 and x["doc_id"] in rows]
    assert sum(clean) > 0.99 * len(clean) and sum(poor) < 0.5 * len(poor)


def test_clean_documents_without_a_label_stay(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = labels.where("quality = 0 or toxic = 1 or doc_id % 2 = 0")
    hidden = [r.doc_id for r in labels.where("quality = 1 and toxic = 0 and doc_id % 2 = 1").collect()]
    rows = {r.doc_id: r.kept for r in quality_rules(docs, seen).collect() if not r.base_failed}
    hidden = [rows[d] for d in hidden if d in rows]
    assert sum(hidden) > 0.99 * len(hidden)


def test_rejects_toxic_but_not_clean_without_a_label(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    insult = re.compile(r"\b(trash|pathetic|idiot|disgusting|worthless|clown|loser|scum|stupid|moron)\b", re.I)
    everyone = labels.collect()
    for odd in (0, 1):
        kept = {r.doc_id: r.kept for r in quality_rules(docs, labels.where(f"doc_id % 2 != {odd}")).collect() if not r.base_failed}
        hidden = [x for x in everyone if x.doc_id in kept and x.doc_id % 2 == odd and x.quality == 1]
        clean = [kept[x.doc_id] for x in hidden if x.toxic == 0]
        toxic = [kept[x.doc_id] for x in hidden if x.toxic == 1 and len(insult.findall(texts[x.doc_id])) > 1]
        assert sum(clean) > 0.99 * len(clean) and toxic and sum(toxic) < 0.2 * len(toxic)
    seen = {r.doc_id: r.kept for r in quality_rules(docs, labels).collect() if not r.base_failed}
    toxic = [seen[x.doc_id] for x in everyone if x.doc_id in seen and x.toxic == 1 and x.quality == 1 and insult.search(texts[x.doc_id])]
    assert toxic and sum(toxic) < 0.1 * len(toxic)


def test_toxic_words_count_where_they_stand(spark):
    plain = "river stone cloud tree under over light field morning evening paper window garden table silver road"
    words = [f"{x}{i}" for i in range(40) for x in plain.split()]
    far = " ".join(["idiot", *words[:300], "idiot"])
    near = " ".join([*words[:300], "idiot", *words[300:330], "idiot"])
    rows = [(i, " ".join(words[i : i + 40])) for i in range(300)] + [(300 + i, " ".join([*words[i : i + 40], "idiot"])) for i in range(60)] + [(900, far), (901, near)]
    labels = [(i, 1, int(i >= 300)) for i in range(360)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality_rules(docs, labels, threshold=-9).collect()}
    assert kept[900] and not kept[901]
    assert {r.kept for r in quality_rules(docs, labels.where("toxic = 0"), threshold=-9).collect()} == {True}


def cells_of(gram, kind):
    """The bucket of one gram by itself: of the ratio's table, of toxic grams, of first letters."""
    t = next(texts_of(pa.array([gram])))
    w = words_of(t)
    if kind == "stem":
        return int(list(q.toxic_cells(t, w))[2][0][0])
    h = list(q.gram_hashes(t, w))[len(gram.split()) - 1][0]
    return int(q.buckets(h, q.BUCKET_BITS if kind == "ratio" else q.TOXIC_BITS)[0])


def grams_of(text):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(text or "")]
    return words, [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def plain_verdicts(rows, labels, threshold):
    """(llr, kept) of each row from dictionaries: the ratio of the two multinomials, and toxic grams close together."""
    cell = lru_cache(None)(cells_of)
    toxic_ids = {i for i, _, t in labels if t == 1}
    trusted_ids = {i for i, quality, t in labels if quality == 1 and t == 0}
    everything, trusted = Counter(), Counter()
    for i, text in rows:
        found = Counter(cell(g, "ratio") for part in grams_of(text) for g in part)
        everything += found
        trusted += found if i in trusted_ids else Counter()
    n_all, n_trusted = sum(everything.values()), sum(trusted.values())
    ratio = lambda g: math.log(trusted[cell(g, "ratio")] + q.PRIOR) - math.log(n_trusted * everything[cell(g, "ratio")] / n_all + q.PRIOR)

    def marks(text):
        words, pairs = grams_of(text)
        return [cell(w, "toxic") for w in words], [cell(p, "toxic") for p in pairs], [cell(w, "stem") if len(w) >= q.STEM else None for w in words]

    sides = {(text, i in toxic_ids) for i, text in rows if text is not None and (i in toxic_ids or i in trusted_ids)}
    held = {True: Counter(), False: Counter()}
    for text, is_toxic in sides:
        held[is_toxic].update({c for part in marks(text) for c in part if c is not None})
    n = Counter(is_toxic for _, is_toxic in sides)
    bad = set()
    for c, k in held[True].items():
        strength = math.log((held[False][c] + q.TOXIC_PRIOR) / (k * n[False] / n[True] + q.TOXIC_PRIOR))
        at_most, share = (q.STEM_RATIO, q.STEM_SHARE) if c >= 1 << q.TOXIC_BITS else (q.TOXIC_RATIO, q.TOXIC_SHARE)
        if k > 1 and strength <= at_most and k / n[True] >= share:
            bad.add(c)
    out = []
    for _, text in rows:
        words, pairs = grams_of(text)
        llr = sum(map(ratio, words + pairs)) / (len(words) + len(pairs) + q.PRIOR_GRAMS)
        w, p, s = marks(text)
        hit = [a in bad or b in bad for a, b in zip(w, s, strict=True)]
        hit = [h or (i < len(p) and p[i] in bad and not hit[i] and not hit[i + 1]) for i, h in enumerate(hit)]
        at = [i for i, h in enumerate(hit) if h]
        close = any(b - a < q.TOXIC_WORDS for a, b in zip(at, at[q.TOXIC_HITS - 1 :], strict=False))
        out.append((llr, not brute(text)[5] and llr >= threshold and not close))
    return out


def test_ratio_and_verdict_match_plain_dictionaries(spark):
    rng = random.Random(7)
    clean, junk, insults = [f"clean{i}" for i in range(60)], [f"junk{i}" for i in range(60)], ["idiot", "stupidly", "stupidest", "ab"]
    rows = []
    for i in range(240):
        words = rng.choices(clean if i % 3 else junk + clean[:20], k=rng.randint(5, 90))
        if i % 5 == 0:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(insults).title())
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, rows[1][1]), (5, rows[5][1]), (None, rows[7][1])]
    labels = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(0, 240) if i % 7]
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
    got = quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), threshold=-0.05).collect()
    want = Counter((i, round(llr, 9), kept) for (i, _), (llr, kept) in zip(rows, plain_verdicts(rows, labels, -0.05), strict=True))
    assert Counter((r.doc_id, round(r.llr, 9), r.kept) for r in got) == want
    assert 20 < sum(r.kept for r in got) < 200 and len({r.kept for r in got if r.doc_id is not None and r.doc_id % 5 == 0}) == 2
