import json

from pyspark.sql import functions as F

from quern.engine import Engine
from quern.functions import records, scorers
from quern.operators import agent, verify
from quern.session import Scratch


def test_ask(spark, tmp_path):
    pages = [
        (1, "La carte nationale demande une photo récente et un extrait de naissance. Le dossier est déposé à la commune avec les frais de timbre requis pour le service demandé.", "http://a.b/c", 1),
        (2, "Le permis de conduire exige une visite médicale et un examen. Les candidats présentent leur dossier au centre avec deux photos et une copie de leur pièce identité.", "d.pdf", 2),
    ]
    e = Engine(spark)
    e.build_index(spark.createDataFrame(pages, "doc_id long, text string, source string, page int"), str(tmp_path / "kb"))
    assert e.status().agg(F.sum("chunks")).first()[0] == 2
    asked = spark.createDataFrame([(1, "quels documents pour la carte nationale"), (2, "meilleur restaurant de la ville"), (3, "zzz qqq")], "query_id long, text string")
    got = {r.query_id: r for r in e.ask(asked).collect()}
    assert got[1].route == "direct" and "carte nationale" in got[1].answer and got[1].grounded
    assert got[2].route in ("refuse", "abstain") and got[3].route == "abstain" and not got[3].grounded
    assert e.plan(e.understand(asked)).count() == 3


def test_records(spark):
    row = lambda c: spark.range(1).select(c.alias("v")).first().v
    docs = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(a).alias("section_sort"), F.lit(b).alias("sort"), F.lit(t).alias("title")) for s, a, b, t in [("B", 2, 1, "z"), ("A", 1, 2, "y"), ("A", 1, 1, "x")]])
    assert row(records.numbered_documents(docs)) == "A:\n1. x\n2. y\nB:\n1. z"
    assert row(records.labelled(("a", F.lit("1")), ("b", F.lit("")), ("c", F.lit(None).cast("string")))) == "a: 1"
    assert row(records.first_contexts(F.array(F.lit(" ")), F.array(F.lit("x"), F.lit("")))) == ["x"]
    assert [json.loads(x) for x in records.repair_json('<think>[</think>```json\n[{"a": 1,}, 3]\n```')] == [{"a": 1}]
    assert records.repair_json(None) == [] and row(records.repaired_items(F.lit("[{}]"))) == ["{}"]
    df = spark.createDataFrame([(1, []), (2, ["a", "b"])], "q int, c array<string>")
    assert sorted(tuple(r) for r in records.explode_contexts(df, "c", ["q"], 1).collect()) == [(1, ""), (2, "a")]
    runs = spark.createDataFrame([("a", 5, True), ("b", 2, False), ("c", 3, False)], "dir string, n int, completed boolean")
    assert records.best_run(runs).first().dir == "c"
    res = spark.createDataFrame([(s, i, "fr", "x") for s in "ab" for i in range(4)], "system string, item int, language string, answer string")
    sheet, key = records.blind_sheet(res, "system", "item", "language", 2)
    assert sheet.count() == 4 and key.select("item").distinct().count() == 2 and "system" not in sheet.columns
    rows = spark.createDataFrame([("s", 0.5, "fr"), ("s", float("nan"), "fr"), ("s", 0.1, "Arabizi")], "system string, answer_relevancy double, language string")
    assert records.mean_scores(rows, ["system"], ["answer_relevancy"], "language").first().answer_relevancy == 0.5
    pages = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (None, 2, "c"), (None, 3, "d")], "id int, pos int, v string")
    assert sorted(r.v for r in records.first_by_id(pages, "id", ["pos"]).collect()) == ["a", "c", "d"]
    tree = spark.createDataFrame([("C", [("S", [(7, "T")])])], "title string, subs array<struct<title: string, thematics: array<struct<id: int, title: string>>>>")
    assert tuple(records.category_tree(tree).first()) == (7, "C > S > T")


def test_scorers(spark):
    row = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert row(scorers.judge_verdict(F.lit("partially supported"))).grounded is False and row(scorers.judge_verdict(F.lit("SUPPORTED"))).confidence == 0.9
    assert abs(row(scorers.entailment(F.array(F.lit(0.0), F.lit(0.0)))) - 0.5) < 1e-9
    assert row(scorers.parse_score(F.lit("score: 0.75"))) == 0.75 and row(scorers.parse_score(F.lit("none"))) is None
    assert row(scorers.read_cascade(F.lit("d"), F.lit(0.5), F.lit("v" * 100), F.lit("o"))).tier == "vision"
    assert row(scorers.read_cascade(F.lit("d"), F.lit(0.5), F.lit("v"), F.lit(" "))) is None


def test_tools(spark):
    """Every tool changes its rows; unknown tools retrieve; a lookup falls back; a question without hits has none."""
    chunks = [("c1", "Article 12 le délai est de 10 jours", "a.pdf", "12", "loi n° 15-97"), ("c2", "Article 2 frais 50 DH", "b.pdf", "2", ""), ("c3", "âge minimum 18 ans", "c.pdf", None, "Loi n° 15-97 bis"), ("c4", "rien", "d.pdf", "112", "dahir 1")]
    chunks = spark.createDataFrame(chunks, "chunk_id string, text string, source string, article_number string, law_name string")
    asked_for = []

    def retrieve(asked):
        asked_for.extend(r.text for r in asked.collect())
        rows = chunks.select("chunk_id", "source", "text").crossJoin(asked.where("text <> 'nothing'").select("query_id"))
        rank = F.expr("cast(substring(chunk_id, 2, 1) as int)")
        return rows.select("query_id", "chunk_id", "source", "text", (1 - rank / 10).alias("score"), (0.5 - rank / 100).alias("rrf"), rank.alias("rank"))

    rows = [("kb", "x", "retrieve_kb", "", ""), ("odd", "x", "no_such", "", ""), ("due", "x", "calculate_deadline", "", ""), ("elig", "x", "check_eligibility", "", ""), ("cost", "x", "search_by_amount", "", ""),
            ("art", "x", "lookup_article", "12", ""), ("law", "x", "lookup_article", "", "LOI N° 15"), ("both", "x", "lookup_article", "2", "dahir"), ("none", "x", "lookup_article", "77", "code"), ("empty", "nothing", "retrieve_kb", "", "")]
    asked = spark.createDataFrame(rows, "query_id string, text string, tool string, article string, law string")
    tools = agent.Tools(retrieve, chunks, as_of=F.to_date(F.lit("2024-03-01")))
    got = {}
    for r in tools.run(asked, lambda df: df.cache()).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    ids = {q: [r.chunk_id for r in v] for q, v in got.items()}
    assert ids["kb"] == ids["odd"] == ["c1", "c2", "c3", "c4"] and got["odd"][0].tool == "retrieve_kb" and "empty" not in ids
    assert got["due"][0].text.startswith("[Délai calculé / المدة المحسوبة: 10 jours ouvrables → 15/03/2024] Article 12") and got["due"][1].text == "Article 2 frais 50 DH"
    assert ids["elig"][0] == "c3" and got["elig"][0].rrf == 0.47 * 1.3 and ids["cost"][0] == "c2" and abs(got["cost"][0].rrf - 0.48 * 1.4) < 1e-12
    assert ids["art"] == ["c1", "c4"] and ids["law"] == ["c1", "c3"] and ids["both"] == ["c1", "c2", "c4"] and got["art"][0].rrf == 0.9
    assert ids["none"] == ["c1", "c2", "c3", "c4"] and "code المادة 77" in asked_for
    plan = agent.lookup_article(chunks, agent.article_keys(chunks, "chunk_id"), asked.where("tool = 'lookup_article'"), id_col="chunk_id", query_col="query_id")
    assert "NestedLoop" not in plan._jdf.queryExecution().toString() and "Cartesian" not in plan._jdf.queryExecution().toString()


def test_plans(spark):
    flags = spark.createDataFrame([(1, ["COST", "COST", "LEGAL"]), (2, []), (3, None)], "query_id int, intents array<string>")
    assert sorted(tuple(r) for r in agent.fallback_plan(flags, "query_id").collect()) == [(1, 0, "COST", "search_by_amount"), (1, 1, "LEGAL", "retrieve_kb"), (2, 0, "DOCUMENTS", "retrieve_kb"), (3, 0, "DOCUMENTS", "retrieve_kb")]
    made = spark.createDataFrame([(1, 0, "PROCEDURE", "retrieve_kb"), (2, 0, "COST", "search_by_amount")], "query_id int, step int, intent string, tool string")
    flags = spark.createDataFrame([(1, ["COST", "PROCEDURE", "ODD", "DEADLINE"]), (2, ["COST"]), (3, ["LEGAL"])], "query_id int, intents array<string>")
    got = sorted(tuple(r) for r in agent.cover_intents(made, flags, "query_id").collect())
    assert got == [(1, 0, "PROCEDURE", "retrieve_kb"), (1, 1, "COST", "search_by_amount"), (1, 2, "DEADLINE", "calculate_deadline"), (2, 0, "COST", "search_by_amount"), (3, 0, "LEGAL", "retrieve_kb")]


def test_facts_reach_the_next_step_and_audits_are_kept(spark, tmp_path):
    pages = [(1, "Article 7. " + "La carte nationale demande une photo récente et un extrait de naissance. Le délai est de 5 jours et le dossier est déposé à la commune avec les frais.", "http://a.b/c", 1)]
    e = Engine(spark)
    e.build_index(spark.createDataFrame(pages, "doc_id long, text string, source string, page int"), str(tmp_path / "kb"))
    seen = []

    def generate(question, context):
        seen.append(context)
        return F.concat(F.lit("dit: "), F.substring(context, 1, 60))

    asked = spark.createDataFrame([(1, "carte nationale Article 7", "french")], "query_id long, text string, language string")
    plan = spark.createDataFrame([(1, 0, "DOCUMENTS", "lookup_article"), (1, 1, "DEADLINE", "calculate_deadline")], "query_id long, step int, intent string, tool string")
    tools = agent.Tools(e._scored, e.chunks, spark.read.parquet(f"{tmp_path}/kb/articles"))
    keep = Scratch(spark, "test").keep
    answers, trace, _ = agent.run(asked, plan, tools, generate, keep)
    facts = answers.first().facts
    assert facts[0].fact.startswith("dit: Article 7") and facts[1].fact.startswith("dit: Résumé des étapes précédentes:")
    assert {(r.step, r.tool) for r in trace.where("call = 'plan'").collect()} == {(0, "lookup_article"), (1, "calculate_deadline")}
    for _ in range(2):
        e.ask(spark.createDataFrame([(1, "carte nationale et délai de la carte")], "query_id long, text string"), str(tmp_path / "audits")).collect()
    audits = spark.read.parquet(str(tmp_path / "audits"))
    assert audits.count() == 2 and audits.select("audit_key").distinct().count() == 1
    report = verify.debug_report(e.verified, "query_id")
    assert {r.layer for r in report.collect()} == set(verify.LAYERS)
