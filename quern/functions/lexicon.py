"""Word lists, patterns and settings that results depend on, kept together as plain text.

Callers pass others where a corpus needs them; these are the defaults.
"""

# Tokenizers.
DIACRITICS = "ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۤۧۨ-ۭ"
ARABIC_FOLD = ("أإآٱىةؤئ", "اااايهوي")
FRENCH_FOLD = ("éèêëàâäîïôöùûüç", "eeeeaaaiioouuuc")
FRENCH_STOPWORDS = (
    "le la les de du des un une et en est au aux ce qui que pour par sur dans avec il elle ils elles je nous vous se son sa ses"
    " mon ma mes"
).split()
ARABIC_STOPWORDS = "في من إلى على أن أو لا هذا هذه التي الذي الذين كان كانت وقد قد لقد".split()

# Chunking and retrieval settings.
CHUNK_WORDS, CHUNK_OVERLAP, MIN_PAGE_WORDS, MIN_CHUNK_WORDS = 400, 50, 20, 10
RETRIEVE_K, FINAL_K, RRF_K, W_DENSE, W_BM25 = 10, 5, 60, 0.6, 0.4
DENSE_FLOOR, OOS_RRF, OOS_RERANK = 0.20, 0.002, 0.12
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
ARABIC_ARTICLE = r"(?:^|\n)\s*(?:المادة|الفصل|الباب|القسم)\s+[0-9٠-٩]+"
FRENCH_ARTICLE = r"(?i)(?:^|\n)\s*(?:article|art\.?|chapitre|titre|section)\s+[0-9]+"
# numbers of articles and names of laws; both are matched with Unicode classes, the French ones in any case
ARABIC_NUMBER = r"(?:المادة|الفصل|الباب|القسم)\s+(\d+(?:\s*مكرر)?)"
FRENCH_NUMBER = r"(?:Article|ART)\.?\s*(\d+(?:\s*bis)?)"
ARABIC_LAW = r"(?:قانون|ظهير|مرسوم)\s+(?:رقم|شريف)?\s*[\d.\-]+"
FRENCH_LAW = r"(?:loi|décret|arrêté)\s+n[°.]?\s*[\d\-]+"

# Language and question markers.
DARIJA_MARKERS = (
    "واش اشنو شنو ماشي بزاف كيفاش فين شحال علاش دابا غادي كاين كاينة بغيت بغا باغي مزيان كنقول كنشوف كندير كنبغي راه راك راها"
    " بصح ماعنديش خاصني خاصك خصني ماكاينش ديال ديالي اللي وقيلا فاش واخا بحال"
).split()
ARABIZI_MARKERS = (
    "achno chno chnou ashno wach wash fin ch7al chhal kifach kifash 3lach 3lah bghit bghiti khass khassni khassek dyal dyali bzaf"
    " bezzaf daba kayn kayen kayna wa9ila ndir nkhles bach ola wla had l9it kanbghi mzyan machi walakin b7al blkhsos 3ndi 9adia nta"
    " nti smiti kifya wakha"
).split()
ENSEMBLE_DARIJA = (
    "واش ماشي بزاف كيف فين شحال علاش درابا دابا غادي كاين كاينة بغيت بغا مزيان كنت كنقول كنشوف كندير كنبغي راه راك راها ياللاه"
    " زوين بصح ماعنديش خاصني خاصك ماكاينش"
).split()
ENSEMBLE_ARABIZI = (
    "chkoun kifach kifash ndir khass bghit bghiti wach 3lach 3lah bzaf bezzaf daba draba ghadi kayen kayna mzyan zwine machi wallah"
    " yallah bsa7 mchi sir"
).split()
MSA_PHRASES = ["ما هي", "ما هو", "كيف يمكن", "كيف أحصل", "متى يمكن", "الوثائق المطلوبة", "الإجراءات", "للحصول على", "مدة الإنجاز", "الرسوم"]
FRENCH_PHRASES = [
    "comment", "quels", "quelle", "quelles", "documents", "procédure", "dossier", "formulaire", "carte nationale", "permis", "acte",
    "certificat", "délai", "frais", "pièces justificatives",
]
OOS_ARABIC = ["كرة القدم", "مباراة كرة", "نتيجة مباراة", "ترتيب الفرق", "فيلم سينمائي", "مسلسل تلفزيوني", "أغنية", "موسيقى", "وصفة طبخ"]
OOS_FRENCH = [
    "match de football", "résultat sportif", "classement équipe", "film cinéma", "série télévisée", "recette cuisine", "chanteur",
    "chanson", "restaurant", "meilleur restaurant", "hôtel", "hébergement", "tourisme", "voyage", "vacances", "météo", "température",
    "prix immobilier", "loyer",
]
LEGAL_ARABIC = [
    "حكم بالسجن", "السجن", "الاعتقال", "المحكمة الجنائية", "النيابة العامة", "جريمة جنائية", "جنحة", "إدانة جنائية", "عقوبة جنائية",
    "غرامة جنائية",
]
LEGAL_FRENCH = [
    "peine d'emprisonnement", "prison", "tribunal correctionnel", "procureur", "infraction pénale", "condamnation pénale",
    "casier judiciaire", "amende pénale",
]
ARABIC_QUESTION_WORDS = "ما ماذا من كيف متى إمتى أين فين لماذا كم شحال هل واش أي".split()
FRENCH_QUESTION_WORDS = "comment quels quelle quelles quel quand où pourquoi combien qui que".split()
#: The kind of sign, then its patterns over the text and over the lower-cased text.
MULTIHOP_SIGNS = {
    "conjunctive": (
        [r"و\s*(كم|ما|كيف|أين|متى|هل|من|لماذا|أي)", r"وكذلك\s", r"وأيضا\s", r"فضلا\s+عن\s+ذلك", r"ثم\s+(ما|كيف|أين|كم|هل)"],
        [r"et\s+(comment|quels?|quelle|quand|où|combien|qui|pourquoi)", r"ainsi\s+que", r"de\s+plus", r"également"],
    ),
    "comparison": (
        [r"الفرق\s+بين", r"مقارنة\s+بين", r"(^|[^\p{L}])أم([^\p{L}]|$)", r"الأفضل\s+بين"],
        [r"différence\s+entre", r"comparaison\s+entre", r"ou\s+bien\b", r"plutôt\s+que", r"versus\b"],
    ),
    "enumeration": (
        [r"(الوثائق|الشروط|الخطوات).{0,30}(الرسوم|المدة|المكان|الإجراءات)"],
        [r"(documents|conditions|étapes).{0,40}(frais|délai|lieu|procédure)"],
    ),
    "multi_entity": (
        [r"(البطاقة|الجواز|الرخصة|الشهادة).{2,40}(و|أو).{2,40}(البطاقة|الجواز|الرخصة|الشهادة)"],
        [r"(carte|passeport|permis|certificat).{2,50}(et|ou).{2,50}(carte|passeport|permis|certificat)"],
    ),
}
HOP_SIGNS = (
    [r"و\s*(كم|ما|كيف|أين|متى|هل|من|لماذا)", r"وما\s+هي", r"وما\s+هو"],
    [r"et\s+(comment|quels?|quelle|quand|où|combien|qui)", r"ainsi\s+que"],
)
#: What an intent puts before a query, for Arabic and for other chunks.
INTENT_PHRASES = {
    "DOCUMENTS": ("الوثائق المطلوبة", "documents requis"),
    "COST": ("التكلفة والرسوم", "frais et coût"),
    "DEADLINE": ("مدة الإنجاز", "délai de traitement"),
    "PROCEDURE": ("خطوات الإجراءات", "étapes procédure"),
    "ELIGIBILITY": ("شروط الأهلية", "conditions éligibilité"),
    "LEGAL": ("العقوبات", "sanctions pénalités"),
}
INTENT_TOOLS = {
    "DOCUMENTS": "retrieve_kb", "COST": "search_by_amount", "DEADLINE": "calculate_deadline", "PROCEDURE": "retrieve_kb",
    "ELIGIBILITY": "check_eligibility", "LEGAL": "retrieve_kb", "COMPARISON": "retrieve_kb",
}
TOOLS = ("retrieve_kb", "lookup_article", "calculate_deadline", "check_eligibility", "search_by_amount")
ARTICLE_WORD = "المادة"
DEADLINE_NOTE = "[Délai calculé / المدة المحسوبة: ", " jours ouvrables → "
PRIOR_STEPS = "ملخص الخطوات السابقة:", "Résumé des étapes précédentes:"
ELIGIBILITY_WORDS = ["سن", "سنة", "مواطن", "أجنبي", "قاصر", "âge", "ans", "citoyen", "étranger", "mineur"]

# Grounding.
_LATIN_UNITS = "(?:jours?|semaines?|mois|ans?|années?|heures?|days?|weeks?|months?|years?|hours?)"
_ARABIC_UNITS = "(?:يوم(?:ًا|اً|ا)?|أيام|أسبوع(?:ًا|اً)?|أسابيع|شهر(?:ًا|اً|ا)?|أشهر|سنة|سنوات|سنوية|عام(?:ًا|اً)?|أعوام|ساعة|ساعات)"
#: (type, pattern), in the order in which entities are listed.
ENTITY_PATTERNS = [
    ("DATE", r"\b20\d{2}\b"),
    ("DATE", r"\b\d{1,2}[/-]\d{1,2}[/-]20\d{2}\b"),
    ("DATE", r"[٠-٩]{4}"),
    ("DATE", r"[٠-٩]{1,2}/[٠-٩]{1,2}/[٠-٩]{4}"),
    ("AMOUNT", r"\b\d+(?:[,\.]\d+)?\s*(?:MAD|DH|درهم|dirhams?)\b"),
    ("AMOUNT", r"\b(?:درهم|dirhams?)\s*\d+(?:[,\.]\d+)?\b"),
    ("DURATION", rf"\b\d+\s*{_LATIN_UNITS}\b"),
    ("DURATION", rf"\d+\s*{_ARABIC_UNITS}"),
    ("DURATION", rf"[٠-٩]+\s*{_ARABIC_UNITS}"),
    ("LEGAL_REF", r"(?:مرسوم|قانون|قرار|ظهير|منشور|دورية)\s*(?:ملكي\s*)?(?:شريف\s*)?(?:رقم\s*)?[\d٠-٩][\d٠-٩./\-]*"),
    ("LEGAL_REF", r"(?:décret|loi|arrêté|dahir|circulaire)\s*(?:royal\s*)?n\s*[°ºo]?\s*\d[\d./\-]*"),
]
CITIES = [
    "Rabat", "Casablanca", "Fès", "Fes", "Marrakech", "Tanger", "Agadir", "Meknès", "Oujda", "Kenitra", "Tétouan", "الرباط", "الدار البيضاء",
    "فاس", "مراكش", "طنجة", "أكادير", "مكناس", "وجدة", "القنيطرة", "تطوان",
]
DIALECT_STOPWORDS = "واش غادي كاين كاينة بزاف شوية غير حتى راه راك راها داك ديك هاد ليكان ماكاينش ماشي هوما دابا".split()
CLAIM_STOPWORDS = "the a an is in on at to of و في من على أن إلى هذا هذه le la les de du des en un une".split() + DIALECT_STOPWORDS
CLAIM_GROUNDED, RATIO_GROUNDED, CFI_GROUNDED = 0.30, 0.80, 0.70
W_CLAIM, W_ENTITY, W_RELATION = 0.5, 0.3, 0.2

# Evaluation and curation.
ABSTAIN_MARKERS = [
    "غير متوفر", "غير متاح", "غير موجودة في", "غير موجود في", "ماكاينةش فالوثائق", "ماكاينةش ف لوثائق", "لم أجد", "لم نجد", "خارج نطاق",
    "خارج اختصاص", "خارج النطاق", "non disponible", "n'est pas disponible", "ne figure pas", "informations insuffisantes",
    "je ne peux pas", "hors de", "not available", "[error", "makaynach f",
]
AUDIT_ABSTAIN_MARKERS = [
    "غير متوفر", "غير متاح", "لا تتوفر", "لا يتوفر", "ماكاينش", "ماجدتش", "خارج نطاق", "لا يتناول", "لا يتضمن", "لا يقدم", "لا يشير",
    "لا يحتوي", "لا يوجد", "لا يذكر", "لا تذكر", "لم يرد", "ليس في", "لا علاقة", "non disponible", "informations insuffisantes",
    "pas disponible", "ne traite pas", "n'aborde pas", "ne contient pas", "ne mentionne pas", "ma kaynach", "machi", "n/a", "ma3andi",
    "makay/n",
]
DANGLING = {
    "arabic": [
        "هذه الرخصة", "هذا الإجراء", "هذه الخدمة", "هذا القرار", "هذه الوثيقة", "هذا الطلب", "هذه العملية", "المذكورة?", "المذكور",
        "هاد الإجراء", "هاد الرخصة", "هاد الخدمة",
    ],
    "latin": [
        r"\bcette licence\b", r"\bcette démarche\b", r"\bcette procédure\b", r"\bce service\b", r"\bcette décision\b", r"\bce document\b",
        r"\bsusmentionnée?\b", r"\bhad l['’]?ijra", r"\bhad rokhsa\b", r"\bhad l['’]?khedma\b",
    ],
}
EXPECTED_SCRIPT = {"arabic_msa": "arabic", "Darija": "arabic", "Arabizi": "latin", "french": "latin"}
TRANSLITERATION_MARKS = "āēīōūḥḍṭẓṣġʿʾ"
NON_ATOMIC = [
    "هذا الإجراء", "بهذا الإجراء", "لهذا الإجراء", "من هذا الإجراء", "المذكورة", "المذكور", "السابق ذكره", "المشار إليه", "المشار إليها",
    "القنوات المذكورة", "الطريقة المذكورة", "الخطوات المذكورة", "بدلاً من القنوات", "بدلاً من الطريقة", "بدلاً من ما ذكر",
    "المذكورة أعلاه", "أعلاه", "ما سبق", "susmentionné", "susmentionnée", "susmentionnés", "ci-dessus", "mentionné précédemment",
    "mentionnée précédemment", "au lieu des canaux", "au lieu de la méthode", "mentioned above", "aforementioned",
    "instead of the mentioned",
]
CATEGORY_PREFIX = {
    "SIMPLE": "S", "MULTIHOP": "M", "MULTIHOP_HARD": "M", "LEGAL": "L", "DARIJA": "D", "ARABIZI": "A", "OUTSCOPE": "O", "EDGE": "E",
}
DEDUP_OVERLAP = 0.85
FOLLOW_WORDS = "procedure service prestation demarche loi decret arrete circulaire texte قانون مرسوم قرار خدمة إجراء".split()
SKIP_SUFFIXES = ".pdf .doc .docx .xls .xlsx .jpg .jpeg .png .gif .svg .mp4 .mp3 .zip .rar".split()
CONTENT_SELECTORS = [
    "article", "main", ".entry-content", ".field--type-text-with-summary", ".journal-content-article", ".node__content", ".content-area",
    "section.content", "#content", ".post-content",
]
MEMORY_CHUNKS, MEMORY_PER_SOURCE, MEMORY_MIN_SCORE = 12, 5, 0.001
MAX_STEPS = 3
DOCUMENTS_HEADING = "الوثائق المطلوبة"
MORE_DETAILS, MORE_DETAILS_ARABIC = "détails supplémentaires", "تفاصيل إضافية"
