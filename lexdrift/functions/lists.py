"""Fixed values that results depend on. Longer lists (marker words, lemmas, spellings) are parameters: see read_words() and corpus.read_word_table()."""

from __future__ import annotations

from pathlib import Path

# The months and seasons that a date may begin with, as day-month. Seasons begin as meteorologists count.
DATE_WORDS = {
    "jan": "01-01",
    "january": "01-01",
    "feb": "01-02",
    "february": "01-02",
    "mar": "01-03",
    "march": "01-03",
    "apr": "01-04",
    "april": "01-04",
    "may": "01-05",
    "jun": "01-06",
    "june": "01-06",
    "jul": "01-07",
    "july": "01-07",
    "aug": "01-08",
    "august": "01-08",
    "sep": "01-09",
    "september": "01-09",
    "oct": "01-10",
    "october": "01-10",
    "nov": "01-11",
    "november": "01-11",
    "dec": "01-12",
    "december": "01-12",
    "spring": "01-03",
    "summer": "01-06",
    "fall": "01-09",
    "autumn": "01-09",
    "winter": "01-12",
}

# Section titles, case-folded and cleaned, by canonical section. Titles outside these lists belong to no section.
SECTION_TITLES = {
    "introduction": ["aim", "introduction", "introduction and background", "introduction and importance", "main", "objective", "objectives", "⧉ introduction"],
    "background": ["background", "literature review", "preliminaries", "related literature", "related work", "related works", "review", "theoretical background", "theory"],
    "methods": [
        "computational details", "data", "data and methodologies", "data and methods", "data collection", "data description", "data records",
        "experimental design, materials and methods", "experimental methods", "material and method", "material and methods", "materials",
        "materials and equipment", "materials and method", "materials and methods", "measures", "method", "method details", "methodology", "methods",
        "methods/design", "methods and design", "methods and materials", "participants and methods", "patients and methods", "procedure",
        "research design", "research design and methods", "research methodology", "research methods and design", "star★methods", "statistical analysis",
        "subjects and methods", "technical validation",
    ],
    "case report": [
        "case", "case history", "case description", "case discussion", "case presentation", "case presentations", "case report",
        "case report/case presentation", "case reports", "case series", "case study", "cases presentation", "clinical case", "clinical history",
        "illustrative case", "past medical history", "patient and observation", "presentation of case",
    ],
    "outcome": ["outcome", "outcomes", "outcome and follow-up"],
    "experiment": [
        "experiment", "experimental", "experimental details", "experimental procedure", "experimental procedures", "experimental section",
        "experimental setup", "experiments",
    ],
    "treatment": ["treatment", "treatment plan", "treatment progress"],
    "diagnosis": ["diagnoses", "diagnosis", "final diagnosis", "differential diagnosis"],
    "results": ["experimental results", "experimental results and analysis", "findings", "main results", "result", "results", "results and analysis", "⧉ results"],
    "discussion": ["discussion", "discussions", "general discussion", "utility and discussion", "⧉ discussions"],
    "conclusion": [
        "challenges and future directions", "clinical implications", "concluding remarks", "concluding remarks and future directions",
        "concluding remarks and future perspectives", "conclusion", "conclusion and future directions", "conclusion and future perspective",
        "conclusion and future perspectives", "conclusion and future work", "conclusion and outlook", "conclusion and perspective",
        "conclusion and perspectives", "conclusion and recommendations", "conclusions", "conclusions/outlook", "conclusions and future directions",
        "conclusions and future perspectives", "conclusions and future work", "conclusions and perspective", "conclusions and perspectives",
        "conclusions and prospects", "conclusions and outlook", "conclusions and recommendations", "final considerations", "future direction",
        "future directions", "future perspective", "future perspectives", "future research directions", "implications", "outlook", "perspectives",
        "summary and conclusion", "summary and conclusions", "summary and future perspectives", "summary and outlook", "summary and perspectives",
        "⧉ conclusions",
    ],
    "limitations": ["limitation", "limitation of the study", "limitations", "limitations of the study", "strengths and limitations", "study limitations"],
    "summary": ["summary", "key messages", "key summary points", "key points"],
}

# Article types that are kept.
ARTICLE_TYPES = ["research-article", "review-article", "case-report"]

# Countries whose authors count as native English speakers, by display name.
ENGLISH_SPEAKING = [
    "United States of America",
    "United Kingdom of Great Britain and Northern Ireland",
    "Canada",
    "Australia",
    "South Africa",
    "Ireland",
    "New Zealand",
]

# The twenty countries with the most papers, by display name.
COMMON_COUNTRIES = [
    "China", "United States of America", "United Kingdom of Great Britain and Northern Ireland", "Japan", "Germany", "Italy", "Canada", "Netherlands",
    "France", "Australia", "Korea, Republic of", "Spain", "Brazil", "India", "Sweden", "Switzerland", "Taiwan", "Iran, Islamic Republic of", "Türkiye",
    "Poland",
]

# Country names as papers write them, and the code that stands for each.
COUNTRY_ALIASES = {
    "United States": "USA",
    "Republic of Korea": "KOR",
    "South Korea": "KOR",
    "United Kingdom": "GBR",
    "UK": "GBR",
    "Iran": "IRN",
    "Turkey": "TUR",
    "Vietnam": "VNM",
    "Czech Republic": "CZE",
    "Russia": "RUS",
    "Bolivia": "BOL",
    "Tanzania": "TZA",
    "Venezuela": "VEN",
    "Brasil": "BRA",
}

# Official English country names that differ from those in use, by code.
OFFICIAL_COUNTRIES = {
    "BES": "Bonaire, Sint Eustatius and Saba",
    "BOL": "Bolivia, Plurinational State of",
    "BRN": "Brunei Darussalam",
    "COD": "Congo, Democratic Republic of the",
    "COG": "Congo",
    "CPV": "Cabo Verde",
    "CZE": "Czechia",
    "FLK": "Falkland Islands (Malvinas)",
    "FSM": "Micronesia, Federated States of",
    "GBR": "United Kingdom of Great Britain and Northern Ireland",
    "HKG": "Hong Kong",
    "HMD": "Heard Island and McDonald Islands",
    "IRN": "Iran, Islamic Republic of",
    "KOR": "Korea, Republic of",
    "LAO": "Lao People's Democratic Republic",
    "MAC": "Macao",
    "MAF": "Saint Martin (French part)",
    "MDA": "Moldova, Republic of",
    "MMR": "Myanmar",
    "PCN": "Pitcairn",
    "PRK": "Korea, Democratic People's Republic of",
    "PSE": "Palestine",
    "RUS": "Russian Federation",
    "SGS": "South Georgia and the South Sandwich Islands",
    "SHN": "Saint Helena, Ascension and Tristan da Cunha",
    "STP": "Sao Tome and Principe",
    "SWZ": "Eswatini",
    "SXM": "Sint Maarten (Dutch part)",
    "SYR": "Syrian Arab Republic",
    "TUR": "Türkiye",
    "TWN": "Taiwan",
    "TZA": "Tanzania, United Republic of",
    "UMI": "United States Minor Outlying Islands",
    "USA": "United States of America",
    "VAT": "Holy See",
    "VEN": "Venezuela, Bolivarian Republic of",
    "VGB": "Virgin Islands, British",
    "VIR": "Virgin Islands, U.S.",
    "VNM": "Viet Nam",
}

# Journals that are preprint servers.
PREPRINTS = ["bioRxiv", "medRxiv", "arXiv", "Research Square"]

# Discipline keywords; of equal positions the earlier one wins.
DISCIPLINES = [
    "cancer", "neuroscience", "cardiology", "ecology", "bioinformatics", "chemistry", "surgery", "environment", "material", "microbiology", "pediatric",
    "immunology", "psychology", "psychiatry", "genetics", "nutrition", "veterinary", "engineering", "education", "physics", "optics", "nursing",
    "neurology", "radiology", "ophthalmology", "gynecology", "rehabilitation", "pathology", "anesthesiology", "dermatology", "pharmacology",
    "physiology", "virology", "biochemistry", "computation", "infectious", "healthcare", "ethics", "dentistry",
]

# Words that never count as excess words.
IGNORED_WORDS = [
    "abstract", "abstractgraphical", "actabiomedica", "amsbsy", "amsfonts", "amsmath", "amssymb", "article", "background", "bstract", "clinicaltrial",
    "commentary", "conclusion", "discussion", "documentclass", "download", "editor", "elife", "github", "grant", "introduction", "mathrsfs", "method",
    "objective", "oddsidemargin", "pubmed", "result", "scholar", "setlength", "showproj", "signifi", "supplemental", "supplementary",
    "textsupplemental", "tinyurl", "upgreek", "usepackage", "wasysym", "wiley",
]

# The group of frequent marker words.
COMMON_MARKERS = ["exhibited", "crucial", "additionally", "within", "notably", "insights", "comprehensive", "across", "particularly", "enhancing"]

# Lemmas that stand before any dictionary's.
LEMMAS = {
    "chatbots": "chatbot",
    "circrnas": "circrna",
    "coronaviruses": "coronavirus",
    "showcased": "showcase",
    "showcases": "showcase",
    "showcasing": "showcase",
}

# Endings of inflected verbs and nouns, and what stands for each in the base form (the published rules of suffix detachment).
DETACHED = {
    "verb": [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")],
    "noun": [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")],
}
# a doubled consonant before an ending is a single one in the base form
DETACHED["verb"] += [(c + c + ending, c) for c in "bdgmnprt" for ending in ("ed", "ing")]

# Irregular forms that endings don't lead back from.
IRREGULAR = {
    "arisen": "arise", "arose": "arise", "became": "become", "been": "be", "began": "begin", "begun": "begin", "broke": "break", "broken": "break",
    "brought": "bring", "built": "build", "came": "come", "chose": "choose", "chosen": "choose", "dealt": "deal", "done": "do", "drawn": "draw", "drew": "draw",
    "driven": "drive", "drove": "drive", "fallen": "fall", "fell": "fall", "felt": "feel", "found": "find", "gave": "give", "given": "give", "gone": "go",
    "grew": "grow", "grown": "grow", "heard": "hear", "held": "hold", "kept": "keep", "knew": "know", "known": "know", "lost": "lose", "made": "make",
    "meant": "mean", "paid": "pay", "risen": "rise", "said": "say", "seen": "see", "sent": "send", "shown": "show", "sought": "seek", "spent": "spend",
    "stood": "stand", "taken": "take", "taught": "teach", "thought": "think", "took": "take", "undergone": "undergo", "understood": "understand",
    "underwent": "undergo", "went": "go", "were": "be", "written": "write", "wrote": "write",
    "children": "child", "criteria": "criterion", "feet": "foot", "hypotheses": "hypothesis", "indices": "index", "lives": "life", "matrices": "matrix",
    "mice": "mouse", "people": "person", "phenomena": "phenomenon", "teeth": "tooth", "vertices": "vertex",
}

# Families of British spellings, and the American ones. Stems are long enough not to take in words such as four or filling.
SPELLINGS = [
    (r"^([a-z]{2,})our(|s|ed|ing|al|able|ful|less|ite|ites|ist|ists|ally)$", r"\1or\2"),
    (r"^([a-z]{2,})is(e|es|ed|ing|er|ers|ation|ations|able)$", r"\1iz\2"),
    (r"^([a-z]{2,})ys(e|es|ed|ing|er|ers)$", r"\1yz\2"),
    (r"^([a-z]+[bt])re(|s|d)$", r"\1er\2"),
    (r"^([a-z]{2,})ogue(|s|d)$", r"\1og\2"),
    (r"^([a-z]*)(?:ae|oe)([a-z]{3,})$", r"\1e\2"),
    (r"^([a-z]*[aeiou][a-z]*[^aeiou][aeiou])ll(ed|ing|er|ers|ation)$", r"\1l\2"),
    (r"^([a-z]{2,})ence(|s)$", r"\1ense\2"),
]

# The cutoffs of the sweep.
CUTOFFS = [0.0002, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0]


def read_words(path: str) -> list[str]:
    """A list of words from a text file, one a line."""
    return [w.strip() for w in Path(path).read_text(encoding="utf-8").splitlines() if w.strip()]
