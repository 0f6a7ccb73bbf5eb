"""Fixed values.

Everything in this module is a value that has to equal the published behaviour for the
results to be right: word lists, lookup tables, patterns, weights, default sizes.
"""

# Chunking and embedding defaults.
CHUNK_SIZE = 1800
CHUNK_OVERLAP = 250
EMBEDDING_MODEL = "local-hashing-384"
EMBEDDING_DIMENSIONS = 384

# Text quality and OCR routing.
OCR_REQUIRED_BELOW_CHARS = 200
OCR_MIN_CHARS = 800
OCR_QUALITY_THRESHOLD = 0.35
OCR_DPI = 200
OCR_LANGUAGE_CODES = {"rus": "ru", "eng": "en", "ru": "ru", "en": "en"}

# Preview lengths.
EVIDENCE_CHARS = 900
PAYLOAD_PREVIEW_CHARS = 800
SNIPPET_WINDOW = 350
RELATION_EVIDENCE_CHARS = 2000

# Chemical element symbols that a formula may use.
ELEMENT_SYMBOLS = [
    "H", "Li", "Be", "B", "C", "N", "O", "F", "Na", "Mg", "Al", "Si", "P", "S", "Cl", "K",
    "Ca", "Sc", "Ti", "V", "Cr", "Mn", "Fe", "Co", "Ni", "Cu", "Zn", "Ga", "Ge", "As", "Se", "Br",
    "Rb", "Sr", "Y", "Zr", "Nb", "Mo", "Ru", "Rh", "Pd", "Ag", "Cd", "In", "Sn", "Sb", "Te", "I",
    "Cs", "Ba", "La", "Ce", "Pr", "Nd", "Sm", "Eu", "Gd", "Tb", "Dy", "Ho", "Er", "Tm", "Yb", "Lu",
    "Hf", "Ta", "W", "Re", "Os", "Ir", "Pt", "Au", "Hg", "Tl", "Pb", "Bi", "Th", "U",
]

# Term catalog: entity type -> terms, matched as whole words in lower case.
TERM_CATALOG = {
    "property": [
        "yield strength", "tensile strength", "ultimate tensile strength", "hardness", "fatigue", "corrosion",
        "oxidation resistance", "band gap", "formation energy", "energy above hull", "thermal conductivity",
        "electrical conductivity", "density", "ductility", "fracture toughness", "elastic modulus",
        "young's modulus", "wear resistance", "coercivity",
    ],
    "method": [
        "dft", "density functional theory", "xrd", "sem", "tem", "ebsd", "eds", "edx", "xps", "raman", "ftir",
        "dsc", "calphad", "molecular dynamics", "finite element", "phase-field", "neutron diffraction",
        "synchrotron",
    ],
    "process": [
        "slm", "lpbf", "selective laser melting", "laser powder bed fusion", "additive manufacturing",
        "heat treatment", "annealing", "quenching", "tempering", "sintering", "casting", "rolling", "extrusion",
        "welding", "flotation", "hydrometallurgy", "pyrometallurgy", "electrodeposition",
    ],
    "phase": [
        "austenite", "martensite", "ferrite", "cementite", "sigma phase", "laves phase", "bcc", "fcc", "hcp",
        "perovskite", "spinel",
    ],
    "defect": [
        "porosity", "crack", "vacancy", "dislocation", "grain boundary", "segregation", "inclusion",
        "precipitate", "pitting",
    ],
    "application": [
        "biomedical", "implant", "aerospace", "battery", "fuel cell", "hydrogen storage", "electrocatalysis",
        "photocatalysis", "thermoelectric", "photovoltaic", "membrane", "carbon capture", "nuclear",
        "high temperature",
    ],
    "material_class": [
        "stainless steel", "austenitic stainless steel", "titanium alloy", "aluminum alloy", "nickel superalloy",
        "high entropy alloy", "ceramic", "polymer", "composite", "oxide", "sulfide", "perovskite", "hydrogel",
        "biomaterial",
    ],
}

# Entity patterns.
ALLOY_PATTERN = (
    r"\b(316L|304L|17-4PH|Ti-?6Al-?4V|AlSi10Mg|CoCrMo|NiTi|Inconel\s*\d+|Hastelloy\s*[A-Z0-9-]+|"
    r"Fe-?Cr-?Ni|Al-?Cu-?Mg|Cu-?Ni)\b"
)
FORMULA_PATTERN = r"\b(?:[A-Z][a-z]?\d*){2,}(?:[+-])?\b"
MATH_OPERATOR_PATTERN = r"=|≈|≤|≥|->|→|<-|←|\\Delta|\\sum|\\int|\bexp\b|\blog\b|\bsin\b|\bcos\b"
MATH_LETTER_PATTERN = r"[A-Za-zΑ-Ωα-ω]"
QUERY_TOKEN_PATTERN = r"[a-zа-яё0-9][a-zа-яё0-9+\-_/]{1,}"
HEADING_PATTERN = r"^\s*(?:\d+(?:\.\d+)*\.?\s+)?([A-ZА-Я][A-Za-zА-Яа-я0-9 ,:/()\\-]{2,90})\s*$"
DOMAIN_PATTERNS = {
    "process": r"\b(флотац\w+|измельчен\w+|классификац\w+|доизмельчен\w+|гидроциклон\w+|грохочен\w+|обжиг\w+)\b",
    "equipment": r"\b(мельниц\w+|классификатор\w+|гидроциклон\w+|флотомашин\w+|дробилк\w+|насоск?\w+|сгустител\w+)\b",
    "mineral": r"\b(Pnt/Cp|Pnt|Cp|пентландит\w*|халькопирит\w*|пирротин\w*|миллерит\w*|валлериит\w*)\b",
    "size_class": r"(\+125|-125\s*\+?\s*71|-71\s*\+?\s*45|-45\s*\+?\s*20|-20\s*\+?\s*10|-10)\s*(?:мкм)?",
}

# Confidences.
ENTITY_CONFIDENCE = {"alloy": 0.85, "material": 0.7, "element": 0.75, "term": 0.68}
RECORD_CONFIDENCE = {"materials_project_summary": 0.92, "oqmd_formationenergy": 0.88}
COOCCURRENCE_CONFIDENCE = 0.62
CLASS_RULE_CONFIDENCE = 0.8
CITES_CONFIDENCE = 0.9
PROVIDER_RELATION_CONFIDENCE = 0.65

# Entity type -> relation predicate.
PREDICATE_BY_TYPE = {
    "property": "has_property",
    "method": "studied_by_method",
    "process": "produced_by_process",
    "material_class": "belongs_to_class",
    "phase": "has_phase",
    "defect": "has_defect",
    "application": "mentions_application",
}
PROVIDER_PREDICATES = list(PREDICATE_BY_TYPE.values()) + ["similar_to"]

# Material name (compact, lower case) -> classes. "equals" rows match whole names, "contains" rows match parts.
CLASS_RULES = [
    ("equals", "316l", "stainless steel"),
    ("equals", "316l", "austenitic stainless steel"),
    ("equals", "304l", "stainless steel"),
    ("equals", "304l", "austenitic stainless steel"),
    ("contains", "ti-6al-4v", "titanium alloy"),
    ("contains", "ti6al4v", "titanium alloy"),
    ("contains", "alsi10mg", "aluminum alloy"),
    ("contains", "inconel", "nickel superalloy"),
]

# Retrieval.
VECTOR_WEIGHT = 0.65
KEYWORD_WEIGHT = 0.35
OVERFETCH = 8
TFIDF_MAX_FEATURES = 20000
PLANTS = ["КГМК", "НОФ Вкр", "НОФ мед", "ТОФ"]
ELEMENT_QUERY_TOKENS = {
    "element28": ["элемент 28", "э28", "element28", "ni", "никел"],
    "element29": ["элемент 29", "э29", "element29", "cu", "мед"],
}
SOURCE_TYPE_TOKENS = ["pdf", "docx", "xlsx", "txt", "openalex", "materials_project", "oqmd"]
SIZE_CLASS_QUERY_PATTERN = r"(?:\+|-)\s*\d+(?:\s*\+\s*\d+)?"
FILTER_RETRY_WARNING = "metadata_filter_empty_result: retried without metadata filters"

# Files.
SOURCE_TYPE_BY_EXTENSION = {
    "pdf": "pdf", "docx": "docx", "txt": "txt", "md": "txt", "xlsx": "xlsx",
    "png": "image", "jpg": "image", "jpeg": "image",
}
CONVERTER_TYPE_BY_EXTENSION = {
    "png": "image", "jpg": "image", "jpeg": "image", "pdf": "text", "docx": "text", "md": "text", "txt": "text",
    "xlsx": "tabular", "xls": "tabular", "csv": "tabular",
}
CONVERTER_EXCLUDED = ["log", "tmp"]
CONVERTER_MAX_MB = 200.0
TEXT_ENCODINGS = ("utf-8-sig", "utf-8", "cp1251", "latin-1")

# Tailings workbook labels.
SIZE_CLASSES = ["+125", "+71", "-125+71", "-71+45", "-45+20", "-20+10", "-10"]
SUMMARY_LABELS = ["Отвальные хвосты", "Хвосты породные", "Хвосты пирротиновые", "Хвосты отвальные"]
DEFAULT_STREAM = "отвальные хвосты"
EXTRACTABLE_PREFIX = "Итого извлекаемый металл"
NOT_EXTRACTABLE_PREFIX = "Итого не извлекаемый металл"
KEY_METRIC_WORDS = [
    "ni", "никель", "cu", "медь", "потер", "содерж", "co", "кобальт", "fe", "железо", "s", "сера", "au", "золото",
    "ag", "серебро", "pt", "pd", "класс", "крупность", "извлечен", "хвост",
]

# Hypothesis scoring.
SCORE_WEIGHTS = {
    "kpi_impact": 0.22, "feasibility": 0.15, "evidence_strength": 0.15, "causal_consistency": 0.15,
    "novelty": 0.08, "business_value": 0.10, "implementability": 0.10, "risk": 0.15,
}
EXISTING_EQUIPMENT_WORDS = ["настрой", "режим", "насад", "плотност", "вода", "контроль"]
HIGH_CAPEX_WORDS = ["замена", "добавление", "нов", "строитель"]
NO_CAPEX_WORDS = ["замена", "новый", "добавление", "строительство"]
REVIEW_CAPEX_WORDS = ["замена", "добавление"]
PROFILE_QUALITY_WEIGHTS = {
    "avg_final_score": 0.30, "evidence_coverage": 0.18, "causal_coverage": 0.16, "generator_diversity": 0.12,
    "corpus_use": 0.10, "hypothesis_breadth": 0.10, "warning_rate": -0.06,
}

# Architecture variants: scoring weights, improvement actions, starting metrics.
VARIANT_WEIGHTS = {
    "interpretability": 0.22, "evidence_grounding": 0.22, "domain_fit": 0.22, "modernity_2026": 0.14,
    "local_runnability": 0.12, "implementation_risk": -0.08,
}
IMPROVEMENT_ACTIONS = [
    ("source_provenance", {"evidence_grounding": 0.050, "interpretability": 0.018, "implementation_risk": -0.010}),
    ("numeric_priority", {"domain_fit": 0.052, "evidence_grounding": 0.030, "interpretability": 0.014}),
    ("kg_causal_edges", {"interpretability": 0.045, "domain_fit": 0.030, "modernity_2026": 0.014}),
    ("agentic_critique", {"modernity_2026": 0.055, "evidence_grounding": 0.018, "implementation_risk": 0.006}),
    ("local_fallbacks", {"local_runnability": 0.060, "implementation_risk": -0.018}),
    ("expert_feedback_loop", {"domain_fit": 0.028, "evidence_grounding": 0.022, "modernity_2026": 0.024}),
    ("ocr_structuring", {"evidence_grounding": 0.042, "local_runnability": 0.018, "implementation_risk": -0.006}),
    ("risk_constraints", {"interpretability": 0.020, "domain_fit": 0.040, "implementation_risk": -0.012}),
]
VARIANT_METRICS = [
    ("v01", 0.15, 0.10, 0.25, 0.45, 0.90, 0.80), ("v02", 0.35, 0.55, 0.45, 0.45, 0.85, 0.45),
    ("v03", 0.35, 0.50, 0.40, 0.55, 0.70, 0.45), ("v04", 0.50, 0.70, 0.55, 0.65, 0.75, 0.40),
    ("v05", 0.70, 0.78, 0.75, 0.65, 0.85, 0.30), ("v06", 0.82, 0.78, 0.78, 0.75, 0.80, 0.35),
    ("v07", 0.90, 0.85, 0.85, 0.78, 0.82, 0.28), ("v08", 0.50, 0.45, 0.50, 0.82, 0.55, 0.65),
    ("v09", 0.70, 0.78, 0.70, 0.90, 0.55, 0.55), ("v10", 0.84, 0.82, 0.78, 0.92, 0.55, 0.52),
    ("v11", 0.88, 0.65, 0.80, 0.55, 0.95, 0.25), ("v12", 0.35, 0.35, 0.45, 0.70, 0.65, 0.65),
    ("v13", 0.80, 0.70, 0.90, 0.95, 0.20, 0.85), ("v14", 0.65, 0.55, 0.72, 0.85, 0.35, 0.75),
    ("v15", 0.94, 0.90, 0.92, 0.95, 0.78, 0.32), ("v16", 0.90, 0.90, 0.86, 0.88, 0.82, 0.34),
    ("v17", 0.92, 0.93, 0.90, 0.90, 0.78, 0.36), ("v18", 0.96, 0.95, 0.94, 0.96, 0.74, 0.34),
]

# Web evidence.
WEB_BASE_RELEVANCE = {"glm": 0.6, "openalex": 0.55}
WEB_RANK_STEP = 0.04
WEB_MIN_RELEVANCE = 0.2

# Provider field lists and pages.
OPENALEX_PAGE_MAX = 200

# Literature query profiles.
QUERY_PROFILES = {
    "core": [
        "materials science", "materials chemistry", "solid state chemistry", "condensed matter materials",
        "crystallography materials", "phase stability materials", "defect chemistry materials",
        "nanomaterials chemistry", "ceramics materials chemistry", "semiconductor materials", "magnetic materials",
    ],
    "adjacent": [
        "chemical physics materials", "physical chemistry materials", "inorganic chemistry materials",
        "surface chemistry materials", "interface chemistry materials", "surface science materials",
        "adsorption energy materials", "catalysis materials", "thermodynamics materials", "kinetics materials",
        "diffusion materials", "materials spectroscopy", "solid state physics materials",
        "statistical mechanics materials",
    ],
    "mining": [
        "high entropy alloys", "metallurgy alloys", "extractive metallurgy", "process metallurgy",
        "hydrometallurgy materials", "pyrometallurgy materials", "powder metallurgy materials",
        "mineral processing chemistry", "flotation mineral surface chemistry", "sulfide minerals flotation",
        "tailings reprocessing flotation", "rare earth separation materials", "critical minerals processing",
        "corrosion materials", "coatings materials", "tribology materials", "wear resistant alloys",
    ],
    "energy": [
        "electrochemistry materials", "battery materials", "fuel cell materials", "supercapacitor materials",
        "hydrogen storage materials", "electrocatalysis materials", "photocatalysis materials",
        "thermoelectric materials", "photovoltaic materials", "membrane materials", "carbon capture materials",
        "solid electrolyte materials",
    ],
    "bio_soft": [
        "biomaterials", "biointerface materials", "tissue engineering materials", "hydrogel materials",
        "polymers materials chemistry", "polymer physics materials", "composite materials", "colloids materials",
        "rheology materials", "soft matter materials",
    ],
    "computational": [
        "computational materials science", "density functional theory materials", "materials informatics",
        "machine learning materials science", "molecular dynamics materials", "CALPHAD materials",
        "phase field modeling materials", "finite element materials", "high throughput DFT materials",
    ],
}
QUERY_PROFILE_ALIASES = {"bio-soft": "bio_soft", "bio": "bio_soft"}
