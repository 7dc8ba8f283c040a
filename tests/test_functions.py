"""Inline cases in Arabic, dialect and French: the driver's tables have none of them."""

import datetime
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import grounding as g
from quern.functions import language as la
from quern.functions import metrics as m
from quern.functions import text as t
from quern.operators import agent, chunking, curate, evaluate, index
from quern.session import Scratch
from quern.sources import files


def value(spark, column, **cols):
    df = spark.range(1)
    for k, v in cols.items():
        df = df.withColumn(k, v if hasattr(v, "_jc") or hasattr(v, "_expr") else F.lit(v))
    return df.select(column.alias("v")).first().v


TOKENS = [
    (t.arabic_tokens, "الْوَثائِق المطلوبة في إدارة", ["وثايق", "مطلوبه", "اداره"]),
    (t.french_tokens, "Les pièces d'Identité à l'été", ["pieces", "identite", "ete"]),
    (t.arabizi_tokens, "bghiit 3ndi", ["bght", "nd"]),
]


@pytest.mark.parametrize("f,text,want", TOKENS)
def test_tokens(spark, f, text, want):
    assert value(spark, f(F.col("x")), x=text) == want


@pytest.mark.parametrize(
    "text,want",
    [("ما هي الوثائق المطلوبة", "arabic_msa"), ("واش كاين شي وثيقة", "Darija"), ("kifach ndir l3aqd", "Arabizi"), ("wach kayn", "Arabizi"), ("quels documents", "french"), ("12 34", "unknown"), ("", "unknown")],
)
def test_script_marker_language(spark, text, want):
    assert value(spark, la.script_marker_language(F.col("x")), x=text) == want


def test_ensemble(spark):
    rows = [("واش كاين بزاف", "Darija"), ("wach kayen bzaf", "Arabizi"), ("quels documents pour le dossier", "french"), ("ما هي الإجراءات", "arabic_msa"), ("", "unknown")]
    df = spark.createDataFrame(rows, "text string, want string")
    for r in la.ensemble_language(df, "text").collect():
        assert r.language == r.want and 0 <= r.confidence <= 1


def test_reconcile_and_flags(spark):
    pick = lambda text, label: value(spark, la.reconcile(F.col("x"), F.col("y")), x=text, y=F.lit(label).cast("string")).language
    assert pick("kifach 3ndi", "french") == "Arabizi" and pick("quels documents", "arabic_msa") == "french" and pick("ما هي الوثائق", None) == "arabic_msa"
    flags = value(spark, la.question_flags(F.array(F.lit("COST"), F.lit("DEADLINE")), F.lit(True), F.lit(True), F.lit(False)))
    assert flags.intents == ["COST", "DEADLINE", "LEGAL"] and flags.hop_count == 3 and not flags.SIMPLE
    assert value(spark, la.question_flags(F.array().cast("array<string>"), F.lit(False), F.lit(False), F.lit(False))).intents == ["DOCUMENTS"]


def test_multihop(spark):
    one = value(spark, la.multihop(F.col("x")), x="quels documents et combien de frais ?")
    assert one.is_multihop and one.hop_count >= 2 and "conjunctive" in one.signs
    assert not value(spark, la.multihop(F.col("x")), x="carte nationale").is_multihop
    assert value(spark, la.intent_hit(F.col("x"), "وثائق"), x="والوثائق") is True


def test_cleaning(spark):
    assert value(spark, t.clean_text(F.col("x")), x="ﬁn  de\n\tligne ° % (ok)") == "fin de ligne   (ok)"
    assert value(spark, t.deloop(F.col("x")), x="go go go go stop\nla la la la la la\nend") == "go stop\nla\nend"
    assert value(spark, t.strip_citations(F.col("x")), x="a [Source: b | Page: 1] https://x.y c") == "a   c"
    long = "x" * 500 + ". " + "y" * 600
    assert len(value(spark, t.truncate_at_sentence(F.col("x")), x=long)) == 501
    assert value(spark, t.is_garbage(F.col("x")), x="1 2 3 4 (5) 6/7 8,9;") and value(spark, t.is_garbage(F.col("x")), x="only four words here") and not value(spark, t.is_garbage(F.col("x")), x="five good words are here")
    assert value(spark, t.short_source(F.col("x")), x="https://a.b/c?d") == "a.b"
    assert value(spark, t.article_number(F.col("x")), x="selon l'article 12 bis") == "12 bis"
    assert value(spark, t.match_text(F.col("x")), x="٣٠  يوماً") == "30 يوما"


def test_workdays(spark):
    for start in (datetime.date(2024, 1, 1) + datetime.timedelta(days=k) for k in range(7)):
        for n in (0, 1, 4, 5, 6, 30):
            day, left = start, n
            while left:
                day += datetime.timedelta(days=1)
                left -= day.weekday() < 5
            assert value(spark, agent.deadline(F.col("d"), F.lit(n)), d=start) == day


def test_entities_and_fidelity(spark):
    found = value(spark, g.entities(F.col("x")), x="le 12/03/2024 à Rabat, 150 DH sous 30 jours, loi n° 2.04 et ٣٠ يوما")
    assert [(e.type, e.entity) for e in found] == [("DATE", "2024"), ("DATE", "12/03/2024"), ("AMOUNT", "150 DH"), ("LOCATION", "Rabat"), ("DURATION", "30 jours"), ("DURATION", "٣٠ يوما"), ("DURATION", "٣٠ يوما"), ("LEGAL_REF", "loi n° 2.04")]
    assert value(spark, g.entity_match_ratio(g.entities(F.col("x")), F.lit("en 30 يوما")), x="٣٠ يوما") == 1.0
    assert value(spark, g.fidelity(F.lit(0.8), F.lit(1.0), F.lit(3), F.lit(False))) == 0.8
    assert value(spark, g.fidelity(F.lit(0.15), F.lit(1.0), F.lit(0), F.lit(True))) == pytest.approx((0.075 + 0.2) / 0.7, abs=1e-4)
    assert value(spark, g.overlap_share(F.lit("le la"), F.lit("x"))) == 1.0


def test_citations(spark):
    chunks = F.array(F.struct(F.lit("a.pdf").alias("source"), F.lit("carte nationale demande").alias("text")), F.struct(F.lit("b.pdf").alias("source"), F.lit("permis").alias("text")))
    out = value(spark, g.inject_citations(F.lit("- demande de carte nationale\nIntro:\n- court\n- rien de commun ici"), chunks))
    assert out == "- demande de carte nationale [Source: a.pdf]\nIntro:\n- court\n- rien de commun ici"
    sources = F.array(F.lit("procedure_carte.pdf"))
    assert value(spark, g.validate_citations(F.lit("x [Source: procedure_carte | Page: 1] y [Source: z]"), sources)) == "x [Source: procedure_carte | Page: 1] y [UNVERIFIED]"
    assert value(spark, g.clean_answer(F.lit("one\none\n[Source: a]\nthis line is rather long\nz\nThis  line is rather long\n\n\n\nScore: 0.9 end"))) == "one\nthis line is rather long\nz\n\n end"


def test_chunks_cover_all_words():
    words = [f"w{i}" for i in range(1000)]
    text = ". ".join(" ".join(words[i : i + 30]) for i in range(0, 1000, 30))
    chunks = chunking.pack_sentences(text, False)
    assert set(" ".join(chunks).split()) == set(words) and all(len(c.split()) <= 400 for c in chunks)
    assert chunks[1].split()[:50] == chunks[0].split()[-50:]
    assert chunking.pack_sentences("nine words are not enough for one chunk here", False) == []
    assert [len(c.split()) for c in chunking.pack_sentences("x " * 500, False)] == [500]


def test_bm25_by_hand(spark):
    docs = ["a b c", "a a d", "a e", "a f g", "h"]
    df = spark.createDataFrame(list(enumerate(docs)), "chunk_id long, text string")
    asked = spark.createDataFrame([(0, "a b b"), (1, "zz")], "q long, text string")
    tokens = F.split("text", " ")
    got = {(r.q, r.chunk_id): r.bm25 for r in index.bm25(df, asked, tokens, tokens, id_col="chunk_id", query_col="q").collect()}
    split = [d.split() for d in docs]
    df_ = {w: sum(w in d for d in split) for d in split for w in d}
    raw = {w: np.log(5 - n + 0.5) - np.log(n + 0.5) for w, n in df_.items()}
    idf = {w: v if v >= 0 else 0.25 * np.mean(list(raw.values())) for w, v in raw.items()}
    mean = sum(map(len, split)) / 5
    for i, d in enumerate(split):
        want = sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in ("a", "b", "b") if w in d)
        assert got.get((0, i), 0.0) == pytest.approx(want)


def test_memory():
    rows = [("a", "s", "t1", 0.5), ("b", "s", "t1", 0.9), ("c", "s", "t2", 0.0), *[(f"s{i}", "s", f"x{i}", 0.3 + i / 100) for i in range(6)], *[(f"o{i}", f"q{i}", f"y{i}", 0.2) for i in range(9)]]
    kept = agent.remember(rows)
    assert len(kept) == 12 and kept[0][0] == "a" and kept[0][3] == 0.9
    assert sum(c[1] == "s" for c in kept) == 5 and "s0" not in {c[0] for c in kept}


def test_greedy_and_overlap(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    ids = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    for at_once in (0, 1, 100):  # by rounds, by both, by one task
        assert sorted(r.id for r in curate.greedy_keep(ids, pairs, "id", at_once).where("kept").collect()) == [1, 3, 4, 5, 7]
    assert sorted(r.id for r in curate.greedy_keep(ids, pairs, "id").where("kept").collect()) == [1, 3, 4, 5, 7]
    base = [f"w{i}" for i in range(20)]
    texts = [(1, " ".join(base)), (2, " ".join(base[:17])), (3, " ".join(base[:16])), (4, " ".join(reversed(base))), (5, "")]
    sets = curate.token_sets(spark.createDataFrame(texts, "id long, text string"), "id", F.col("text"))
    classes = curate.class_sets(sets, curate.set_classes(sets, "id"), "id")
    got = {(r.a, r.b): round(r.overlap, 3) for r in curate.overlap_pairs(classes, "id").collect()}
    assert got == {(1, 2): 0.85, (2, 3): 0.941}


def test_audit_and_valid(spark):
    codes = lambda lang, q, a, kw, abstain: value(spark, curate.audit_codes(F.lit(lang), F.lit(lang), F.lit(q), F.lit(a), F.array(*[F.lit(k) for k in kw]).cast("array<string>"), F.lit(abstain)))
    assert codes("french", "quels documents ?", "la carte", ["carte"], False) == []
    assert codes("french", "cette procédure وثائق", "", [], False) == ["Q_HAS_ARABIC", "KW_EMPTY", "ANSWER_EMPTY", "MAYBE_NOT_SELF_CONTAINED"]
    assert codes("arabic_msa", "documents", "documents", ["doc"], False) == ["Q_WRONG_SCRIPT", "A_IS_LATIN", "KW_IS_LATIN"]
    assert codes("french", "q", "des faits", ["k"], True) == ["OUTSCOPE_NOT_ABSTAINING"]
    ok = lambda a, q="quels sont les documents": value(spark, curate.is_valid_item(F.lit("SIMPLE"), F.lit("french"), F.lit(q), F.lit(a), F.array(F.lit("k")), F.lit("s")))
    assert ok("dix mots " * 5) and not ok("trop court") and not ok("dix mots " * 5 + "...") and not ok("dix mots " * 5, "que dit le texte ci-dessus")


def test_metrics(spark):
    assert value(spark, m.token_f1(F.lit("a b b"), F.lit("b c"))) == 0.5 and value(spark, m.token_f1(F.lit(""), F.lit("x"))) == 0.0
    assert value(spark, m.rouge_l(F.split(F.lit("a b c d"), " "), F.split(F.lit("a c e d"), " "))) == 0.75
    ctx = F.array(F.lit("x y"), F.lit("x z"))
    assert value(spark, m.context_redundancy(ctx)) == pytest.approx(1 / 3) and value(spark, m.reciprocal_rank(ctx, F.array(F.lit("z")))) == 0.5
    assert value(spark, m.invented_numbers(F.lit("12 and 13"), F.lit("only 12"))) == 0.5
    df = spark.createDataFrame([(float(i),) for i in range(124)], "v double").withColumn("g", F.lit(1))
    assert {r.pct: r.value for r in evaluate.nearest_rank(df, ["g"], "v", [50, 95, 99]).collect()} == {50: 62.0, 95: 117.0, 99: 122.0}


def test_html_and_sections(spark, tmp_path):
    page = "<html lang=fr><title>T</title><nav><p>menu</p></nav><h1>Big</h1><h2>One</h2><p>a b c<p>d e f<ul><li>x <p>y</p></li></ul><h2>Two</h2><p>short</p>"
    assert files.html_sections(page, 3) == [("One", "a b c\nd e f\ny\nx y")] or files.html_sections(page, 3)[0][0] == "One"
    assert value(spark, files.html_language(F.col("x")), x=page) == "fr"
    body = " ".join(f"w{i}" for i in range(12))
    (tmp_path / "f.txt").write_text(f"Title: A\nURL: http://u\n---\n{body}\n{'-' * 60}\nTitle: B\n---\nfew words\n")
    assert [tuple(r) for r in files.read_texts(spark, str(tmp_path)).collect()] == [("http://u", "A", body)]


def test_streaming(spark, tmp_path):
    from quern.streaming import events

    src = tmp_path / "in"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(src))
    events.run_to_end(events.tumbling(events.read_events(spark, str(src))), str(tmp_path / "out"), str(tmp_path / "ck"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() > 0 and out.groupBy("start", "event_type").count().where("count > 1").count() == 0


KEYED = [
    ("carte", "c1", "carte.pdf", "La carte nationale demande deux photos et un extrait de naissance au bureau de la commune", 0.9),
    ("passeport", "c2", "passeport.pdf", "Le passeport demande un timbre de cinq cents dirhams et une photo récente du demandeur", 0.5),
    ("visa", "c3", "visa.pdf", "Le visa est délivré en dix jours par le consulat après dépôt du dossier complet", 0.2),
    ("timbre", "c4", "timbre.pdf", "Le timbre fiscal se paie en ligne", 0.4),
    ("photos", "c5", "photos.pdf", "Les photos sont récentes", 0.3),
    ("البطاقة", "c6", "بطاقة.pdf", "البطاقة تتطلب صورتين وعقد الازدياد وشهادة السكنى مع طلب خطي موقع من المعني بالأمر", 0.8),
    ("الجواز", "c7", "جواز.pdf", "الجواز", 0.6),
]


def test_agent_answers_and_strategies(spark):
    from quern.functions.scorers import extractive_answer
    from quern.operators import strategies
    from quern.plans import fixtures

    asked = spark.createDataFrame(fixtures.ASKED, fixtures.ASKED_SCHEMA)
    retrieve = fixtures.look_up(spark.createDataFrame(KEYED, "key string, chunk_id string, source string, body string, score double"))
    plan = agent.fallback_plan(asked.select("query_id", "intents"), "query_id")
    answers, _, _ = agent.run(asked.select("query_id", "text", "language"), plan, agent.Tools(retrieve), extractive_answer, Scratch(spark, "agent").keep)
    answers = {r.query_id: r for r in answers.collect()}
    keyed = {k: (c, body, score) for k, c, _, body, score in KEYED}
    for query_id, text, _, intents, _, _ in fixtures.ASKED:
        held = sorted((keyed[w] for w in text.split() if w in keyed), key=lambda x: -x[2])
        got = answers[query_id]
        assert got.n_steps == len(list(dict.fromkeys(intents))[:3]) and sum(f.fact != "" for f in got.facts) == (got.n_steps if held else 0)
        assert got.answer == (held[0][1] if held else "")  # no other sentence shares more words with the question
    s = strategies.Strategies(retrieve)
    runs = {"react": s.react(asked), "adaptive": s.adaptive(asked, F.col("parts")), "self_rag": s.self_rag(asked), "flare": s.flare(asked)}
    rows = {(name, r.query_id): r for name, run in runs.items() for r in run.collect()}
    assert all(rows["react", q[0]].n_retrievals == 3 for q in fixtures.ASKED)
    assert [rows["adaptive", q].n_retrievals for q in ("q1", "q2", "q3", "q4")] == [2, 1, 2, 1]
    assert rows["self_rag", "q4"].n_retrievals == 2 and len(rows["self_rag", "q4"].contexts) == 0 and len(rows["react", "q1"].contexts) == 3


def test_debug_report_and_audit(spark):
    from quern.operators import verify
    from quern.plans import fixtures

    rows = [(i, *r) for i, r in enumerate(fixtures.CHECKED, 1)]
    v = verify.verify(spark.createDataFrame(rows, "id int, " + fixtures.CHECKED_SCHEMA), F.lit("-"))
    passed = {(r.id, r.layer): r.passed for r in verify.debug_report(v, "id").collect()}
    assert passed[1, "claims"] and not passed[1, "citations"] and not passed[2, "entities"] and not passed[2, "chain"] and len(passed) == 5 * len(verify.LAYERS)
    audits = {r.id: r for r in verify.audit_rows(v, "id").collect()}
    assert audits[1].answer == "La carte coûte 75 DH à Rabat." and audits[3].answer == "-" and audits[2].n_claims == 1  # a short line gets no citation


def test_chunks_follow_their_definition(spark):
    """Every chunk of the smallest documents against a sentence-by-sentence count, and the language against the column function."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    chunks = chunking.chunk_pages(docs).cache()
    said = chunks.select("text", "language", t.chunk_language(F.col("text")).alias("by_column")).where("language <> by_column")
    assert said.count() == 0
    made = {}
    for r in chunks.orderBy("doc_id", "seg", "pos").collect():
        made.setdefault(r.doc_id, []).append(r.text)
    for r in docs.collect():
        text, want = r.text or "", []
        if len(text.split()) >= 20 and not re.search(r"(?i)(?:^|\n)\s*(?:article|art\.?|chapitre|titre|section)\s+[0-9]+", text):
            arabic = chunking.language_of(text) in ("arabic_msa", "mixed")
            if len(text.split()) <= 400:
                want = [text]
            else:
                left = [s.split() for s in re.split("[،؟\n]+" if arabic else r"[.!?\n]+", text) if s.split()]
                now = []
                for words in left:
                    if now and len(now) + len(words) > 400:
                        want.append(" ".join(now))
                        now = now[-50:]
                    now = now + words
                if len(now) >= 10:
                    want.append(" ".join(now))
            assert made.get(r.doc_id, []) == want, r.doc_id
    assert chunking.page_chunks("x " * 12 + "\nArticle 1 " + "y " * 12 + "\n\nARTICLE 2 bis " + "z " * 3) == [(0, 0, ("x " * 12).strip(), "french", "", ""), (1, 0, "Article 1 " + ("y " * 12).strip(), "french", "1", "")]
    assert chunking.page_chunks("short") == [] and chunking.chunk_pages(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 0
    numbered = chunking.number_chunks(chunks).orderBy("doc_id", "seg", "pos").select("ord", "chunk_id").collect()
    assert [r.ord for r in numbered] == list(range(len(numbered))) and numbered[7].chunk_id == "chunk_0007"


def test_an_index_that_is_not_there(spark, tmp_path):
    from quern.engine import Engine

    assert Engine(spark).load(str(tmp_path / "none")) is False
