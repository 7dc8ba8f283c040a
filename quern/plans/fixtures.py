"""Small inline tables with text in the languages that the shared tables lack: rows for Spark, ``VALUES`` for SQL."""

from __future__ import annotations

GOLD_SCHEMA = "item_id string, category string, language string, source string, gold_answer string, gold_keywords array<string>, is_multihop boolean"
GOLD = [
    ("S1", "SIMPLE", "french", "p1", "La carte nationale coûte 75 DH et demande deux photos", ["75 DH", "photos"], False),
    ("S2", "SIMPLE", "arabic_msa", "p1", "تكلفة البطاقة 75 درهم مع صورتين", ["75 درهم", "صورتين"], False),
    ("D1", "DARIJA", "Darija", "p1", "البطاقة كتكلف 75 درهم", ["75"], False),
    ("A1", "ARABIZI", "Arabizi", "p2", "الجواز كيتطلب 3 ايام", ["3"], False),
    ("M1", "MULTIHOP", "french", "p2", "Il faut le passeport puis le visa avec le formulaire", ["passeport", "visa", "formulaire"], True),
    ("M2", "MULTIHOP", "arabic_msa", "p3", "عقد الازدياد ثم شهادة السكنى", [], False),
    ("L1", "LEGAL", "french", "p3", "Selon le décret n° 2.04.564 le délai est de 30 jours", ["2.04.564", "30 jours"], False),
    ("O1", "OUTSCOPE", "french", "", "Information non disponible", [], False),
    ("O2", "OUTSCOPE", "arabic_msa", "", "غير متوفر", [], False),
    ("S3", "SIMPLE", "french", "p3", "Le dossier est gratuit", ["gratuit"], False),
]
RESULT_SCHEMA = (
    "system string, item_id string, answer string, contexts array<string>, latency_sec double, is_outscope boolean, agent_steps int, n_tool_calls int,"
    " cfi double, claim_ratio double, entity_ratio double, is_grounded boolean"
)
_CARD = ["La carte nationale coûte 75 DH", "Deux photos et la carte", "Bureau ouvert de 9 à 12"]
RESULTS = [
    ("agentic", "S1", "La carte coûte 75 DH avec deux photos [Source: carte.pdf]", _CARD, 1.5, False, 1, 1, 0.9, 1.0, 1.0, True),
    ("agentic", "S2", "تكلفة البطاقة 75 درهم مع صورتين", ["تكلفة البطاقة 75 درهم", "مع صورتين شمسيتين"], 1.25, False, 1, 1, 0.8, 0.9, 1.0, True),
    ("agentic", "D1", "البطاقة كتكلف 75 درهم بزاف", ["البطاقة 75"], 2.0, False, 0, 1, None, None, None, None),
    ("agentic", "A1", "passport kaytleb 3 iyam", [], 0.75, False, 0, 0, 0.4, 0.5, 0.0, False),
    ("agentic", "M1", "Le passeport, puis le visa. 12 photos", ["Le passeport d'abord", "Le visa ensuite 4 photos"], 3.5, False, 3, 0, 0.7, 0.8, 0.5, False),
    ("agentic", "M2", "عقد الازدياد", ["عقد الازدياد", "شهادة السكنى", "عقد الازدياد"], 4.0, False, 0, 2, 0.6, 0.7, None, True),
    ("agentic", "L1", "Le décret n° 2.04.564 fixe 30 jours [Source: bo.pdf] https://bo.ma/1", ["décret n° 2.04.564", "délai de 30 jours"], 2.5, False, 1, 1, 1.0, 1.0, 1.0, True),
    ("agentic", "O1", "Cette question est hors de mon domaine", [], 0.5, True, 0, 0, None, None, None, False),
    ("agentic", "O2", "المعلومات غير متوفر في الوثائق", ["نص"], 0.5, False, 0, 0, None, None, None, False),
    ("agentic", "S3", "", ["Le dossier est gratuit"], 0.25, False, 1, 1, None, None, None, False),
    ("naive", "S1", "Elle coûte 100 DH", _CARD[:1], 0.5, False, None, None, None, None, None, None),
    ("naive", "S2", "لا أعرف", [], 0.5, False, None, None, None, None, None, None),
    ("naive", "D1", "La carte coûte 75", ["carte 75"], 0.5, False, None, None, None, None, None, None),
    ("naive", "A1", "الجواز كيتطلب 3 ايام فقط", ["الجواز 3 ايام"], 0.5, False, None, None, None, None, None, None),
    ("naive", "M1", "Le formulaire", ["Le formulaire", "Le formulaire rose"], 0.625, False, None, None, None, None, None, None),
    ("naive", "O1", "ERROR: timeout", [], 9.0, False, None, None, None, None, None, None),
    ("naive", "O2", "الجواب هو 5", [], 0.5, False, None, None, None, None, None, None),
    ("naive", "L1", "Le délai est de 45 jours", ["délai de 30 jours"], 0.5, False, None, None, None, None, None, None),
]
TEXT_SCHEMA = "id int, text string"
TEXTS = [
    (1, "Le DÉCRET N° 2.04.564 donne 2 ANNÉES depuis 2019"),
    (2, "Colis de 100 DHL et 150,50 DH le 03/11/2021 à Rabat"),
    (3, "المادة 12 مكرر من قانون رقم 15.97 خلال 30 يوما و ٢٠٢١"),
    (4, "الباب 3 بمدينة الدار البيضاء مدة ٣٠ يوما"),
    (5, "ART. 7 bis de la loi n° 2004 pour 20 dirhams, Article 9"),
    (6, ""),
    (7, None),
    (8, "القسم 4 ظهير شريف 1.58.250 وثمن 200 درهم للمتر"),
]
PAIR_SCHEMA = "id int, claim string, chunks array<string>"
PAIRS = [
    (1, "carte nationale perdue hier", ["la carte nationale", "perdue depuis hier matin"]),
    (2, "واش غادي كاين passeport", ["le passeport est prêt", "autre chose"]),
    (3, "le la de", ["x"]),
    (4, "rien de commun ici", []),
    (5, "délai trente jours", None),
    (6, "عقد الازدياد مطلوب", ["عقد الازدياد", "عقد مطلوب"]),
]
RAW_SCHEMA = "question string, category string, language string, gold_answer string, is_multihop boolean, should_abstain boolean"
RAW = [
    ("Combien coûte la carte ?", "simple", "french", "75 DH", None, None),
    ("شحال كتكلف لاكارط؟", "SIMPLE", "Darija", "75 درهم", False, False),
    ("ch7al katkelef lacarte?", None, "Arabizi", "75 drahem", None, None),
    ("ch7al lpassport?", "OUTSCOPE", "Arabizi", "غير متوفر", None, None),
    ("Passeport puis visa ?", "MULTIHOP", "french", "Oui", False, None),
    ("ما هي المدة؟", None, None, None, True, None),
    ("   ", "SIMPLE", "french", "x", False, False),
    (None, "SIMPLE", "french", "x", False, False),
    ("Quel temps fait-il ?", "OUTSCOPE", "french", "", None, None),
    ("Et si ?", "EDGE", "Darija", "نعم", False, True),
]


JUDGED_SCHEMA = "system string, rating int, supported int, facts int, reply string"
JUDGED = [("a", 5, 3, 4, "score: 0.75"), ("a", 3, 0, 0, "1"), ("a", None, 2, 2, "none"), ("b", 1, 1, 3, ".5 of 1"), ("b", 4, None, None, None)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _literal(value, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, list):
        return "CAST([" + ", ".join(_literal(x, "VARCHAR") for x in value) + "] AS VARCHAR[])"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"CAST({value} AS {kind})"


def values(rows, schema: str) -> str:
    """The same table as a SQL subquery."""
    fields = [x.strip().split(" ") for x in schema.split(",")]
    kinds = [{"string": "VARCHAR", "array<string>": "VARCHAR[]", "int": "INTEGER"}.get(k, k.upper()) for _, k in fields]
    names = ", ".join(n for n, _ in fields)
    body = ", ".join("(" + ", ".join(_literal(v, k) for v, k in zip(r, kinds, strict=True)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS fixture({names}))"

ASKED_SCHEMA = "query_id string, text string, language string, intents array<string>, parts string, made_up string"
ASKED = [
    ("q1", "carte et passeport", "french", ["DOCUMENTS", "COST"], "1. la carte nationale\n2. le passeport bleu", "la carte demande deux photos"),
    ("q2", "visa", "french", ["DEADLINE"], None, "un visa et un timbre"),
    ("q3", "البطاقة ثم الجواز", "arabic_msa", ["DOCUMENTS", "DOCUMENTS", "LEGAL", "COST", "DEADLINE"], "1. ما هي البطاقة\n2. كيف الجواز اليوم", None),
    ("q4", "rien du tout", "french", ["UNKNOWN"], "", "rien"),
]


def look_up(keyed, k: int = 10):
    """Retrieval over (key, chunk_id, source, body, score): at most ``k`` chunks whose key is a word of the query, best first."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    def retrieve(asked):
        words = asked.select("query_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("key"))
        found = words.join(keyed, "key").select("query_id", "chunk_id", "source", F.col("body").alias("text"), "score", F.col("score").alias("rerank"))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= k)
        return found.withColumn("rrf", F.col("score") / 2)

    return retrieve


CHECKED_SCHEMA = "answer string, chunks array<struct<source: string, text: string>>, intermediate array<string>, is_multihop boolean"
CHECKED = [
    ("La carte coûte 75 DH à Rabat. ", [("carte.pdf", "la carte nationale coûte 75 DH partout"), ("rabat.pdf", "le bureau de Rabat est ouvert")], None, False),
    ("La carte coûte 99 DH. ", [("carte.pdf", "la carte nationale coûte 75 DH partout")], ["le timbre est rouge vif."], True),
    ("Une réponse sans aucune preuve. ", [], None, False),
    ("البطاقة تكلف 75 درهم. ", [("بطاقة.pdf", "البطاقة تكلف 75 درهم في الرباط")], ["البطاقة تكلف 75 درهم"], True),
    (None, None, None, False),
]
