import re

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from quern.llm import licenses as li

SF = "/root/testdata/sf0.01"
MIT = next(t for n, t in li.TEMPLATES if n == "MIT" and len(t) > 200)
CLASSES = li.by_length(li.TEMPLATES)
PROSE = " ".join(f"word{i}" for i in range(600))


def brute(doc_id, text, threshold=li.THRESHOLD):
    """Every window of every template's length; of overlapping ones the best."""
    words, found = re.findall("[a-z0-9]+", (text or "").lower()), []
    for m, group in CLASSES.items():
        for start in range(max(0, len(words) - m) + 1):
            own = words[start : start + m]
            mine = {f"{a} {b}" for a, b in zip(own, own[1:], strict=False)}
            if mine:
                dice, name, shared = min((-2 * len(mine & set(b)) / (len(mine) + len(b)), n, len(mine & set(b))) for n, b in group)
                if round(-dice, 6) >= threshold:
                    found.append((-shared, round(dice, 6), start, name, min(m, len(words))))
    beats = lambda o, w: o[2] < w[2] + w[4] and w[2] < o[2] + o[4] and o < w
    return [(doc_id, w[2], w[4], w[3], -w[1]) for w in found if not any(beats(o, w) for o in found)]


def scan(spark, rows):
    df = spark.createDataFrame([(i, t, "u", 1) for i, t in rows], "doc_id long, text string, license string, start int")
    return sorted((tuple(r) for r in li.scan_licenses(df).collect()), key=repr)


def test_edges(spark):
    texts = [None, "", "\n\n", "MIT", "released UNDER the MIT-license!", "Copyright 2020 A. B.\n\n" + MIT + "\n\nfoo bar\nbaz", MIT.replace("Software", "Program"), "x\nLicensed under CC BY-NC 4.0.\ny " * 3,
             "Licensed under the Apache License, Version 2.0.\n" * 3, "déjà vu\nReleased under the MIT License.", "license " * 40, "MIT license", MIT[: len(MIT) * 9 // 10], MIT + " " + MIT]
    rows = list(enumerate(texts)) + [(None, texts[4]), (4, texts[4])]
    got = scan(spark, rows)
    assert got == sorted((b for d, t in rows for b in brute(d, t)), key=repr)
    assert [g[3] for g in got if g[0] == 5] == ["MIT"] and len([g for g in got if g[0] == 13]) == 2
    assert scan(spark, [(1, "word " * 50_000)]) == [] and scan(spark, []) == []


def wrapped(text, width, prefix="", end="\n"):
    words, lines = text.split(), [""]
    for w in words:
        if len(lines[-1]) + len(w) > width:
            lines.append("")
        lines[-1] += " " * bool(lines[-1]) + w
    return end.join(prefix + line for line in lines)


def test_any_setting_in_a_longer_text(spark):
    """Line ends, comment marks, wrapping, no blank lines, one line: the notice is found inside 600 other words on each side."""
    halves = MIT.replace("The above copyright", "\n \nThe above copyright").replace("THE SOFTWARE IS PROVIDED", "\n\nTHE SOFTWARE IS PROVIDED")
    settings = [halves, halves.replace("\n", "\r\n"), wrapped(MIT, 70, "# "), wrapped(MIT, 70, " * "), wrapped(MIT, 70, "// ", "\r\n"), wrapped(MIT, 40), MIT.replace("\n", " ")]
    rows = [(i, f"{PROSE}{gap}{x}{gap}{PROSE}") for i, x in enumerate(settings) for gap in ("\n\n", "\r\n\r\n", " ")]
    got = scan(spark, rows)
    n = len(re.findall("[a-z0-9]+", MIT.lower()))
    assert got == sorted(((i, 600, n, "MIT", 1.0) for i, _ in rows), key=repr)


@pytest.mark.parametrize("stretch", [None, 64, 500])
def test_changed_copies_and_stretches(spark, monkeypatch, stretch):
    """Copies with words changed, lost and added around the threshold, many in a text, across cuts of it."""
    if stretch:
        monkeypatch.setattr(li, "STRETCH", stretch)
    rng, rows = np.random.default_rng(3), []
    for doc in range(12):
        parts = []
        for _ in range(4):
            parts += rng.choice([f"w{i}" for i in range(50)] + ["license", "software"], rng.integers(0, 120)).tolist()
            own = re.findall("[a-z0-9]+", li.TEMPLATES[rng.integers(len(li.TEMPLATES))][1].lower())
            for _ in range(int(len(own) * rng.choice([0, 0.04, 0.08, 0.12]))):
                at = int(rng.integers(len(own)))
                own[at : at + int(rng.integers(0, 2))] = ["other"] * int(rng.integers(0, 2))
            parts += own
        rows.append((doc, " ".join(parts)))
    want = sorted((b for d, t in rows for b in brute(d, t)), key=repr)
    assert len({w[4] for w in want}) > 8 and scan(spark, rows) == want


def test_whole_table(spark):
    got = sorted(tuple(r) for r in li.op1_license_scan(spark, SF).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(con.execute(li.ORACLE).fetchall()) == got and len(got) > 10
    small = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    assert sorted(tuple(r) for r in li.op1_license_scan(spark, "/root/testdata/sf0.001").collect()) == sorted(b for d in small for b in brute(d["doc_id"], d["text"]))


def test_only_jvm_operators(spark):
    plan = li.op1_license_scan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange|Cartesian|NestedLoop", plan)


def test_anchors_are_needed():
    anchors = li.anchor_words(li.TEMPLATES, li.THRESHOLD)
    for _, bigrams in li.template_bigrams(li.TEMPLATES):
        spared = [b for b in bigrams if not set(b.split()) & set(anchors)]
        assert len(spared) < li.THRESHOLD / (2 - li.THRESHOLD) * len(bigrams)
