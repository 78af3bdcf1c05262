"""Word lists, lookup tables and labels that results depend on.

Every one of them is only a default; the functions that use them take a replacement as an argument.
"""

# --- fixed values -------------------------------------------------------------------------------

DEFAULT_AREA = "Other/Unclassified"

# Ordered: the first rule with a key inside the text wins. Trailing spaces are part of the keys.
AREA_RULES = [
    ("Oncology", ["cancer", "carcinoma", "lymphoma", "leukemia", "tumor", "melanoma", "neoplasm"]),
    ("Cardiovascular", ["cardio", "heart", "hypertension", "myocard", "atrial", "stroke", "vascular"]),
    ("Neurology", ["neuro", "alzheimer", "parkinson", "epilep", "multiple sclerosis", "ms ", "migraine"]),
    ("Psychiatry", ["depress", "schizo", "bipolar", "anxiety", "adhd", "autism", "ptsd"]),
    ("Endocrine/Metabolic", ["diabet", "metabolic", "thyroid", "obesity", "hyperlip", "dyslipid"]),
    ("Infectious Disease", ["covid", "influenza", "hiv", "hepatitis", "malaria", "tubercu", "infection"]),
    ("Respiratory", ["asthma", "copd", "bronch", "respiratory", "pulmon"]),
    ("Gastroenterology", ["crohn", "ulcerative colitis", "ibs", "liver", "hepat", "gi "]),
    ("Rheumatology/Immunology", ["rheumat", "lupus", "psoriasis", "autoimmun", "arthritis"]),
    ("Dermatology", ["dermat", "eczema", "atopic", "acne", "skin"]),
    ("Obstetrics/Gynecology", ["pregnan", "obstet", "gyneco", "endometri", "fertility", "ivf"]),
    ("Ophthalmology", ["retina", "glaucoma", "ophthal", "macular", "uveitis"]),
    ("Hematology", ["hemato", "anemia", "hemoph", "sickle", "thrombo", "coagul"]),
    ("Genetic/Rare", ["rare", "orphan", "duchenne", "huntington", "lysosomal", "sma ", "tay-sachs"]),
]

HIGH_RISK_AREAS = ["Cardiovascular", "Infectious Disease", "Oncology"]

SAFETY_KEYS = [
    "safety",
    "ae",
    "adverse event",
    "adverse events",
    "toxicity",
    "death",
    "mortality",
    "side effect",
    "risk",
    "harm",
    "serious adverse",
]

FUTILITY_KEYS = [
    "futility",
    "lack of efficacy",
    "no efficacy",
    "ineffective",
    "conditional power",
    "no benefit",
    "insufficient efficacy",
    "interim analysis futility",
]

PHASE_LABELS = {
    "EARLY_PHASE1": "Early Phase 1",
    "PHASE1": "Phase 1",
    "PHASE2": "Phase 2",
    "PHASE3": "Phase 3",
    "PHASE4": "Phase 4",
    "NA": "N/A",
}

SPONSOR_BUCKETS = {
    "INDUSTRY": "Industry",
    "NIH": "NIH",
    "ACADEMIC": "Academic",
    "NETWORK": "Academic",
}
DEFAULT_BUCKET = "Other"

COMPLETED_STATUSES = ["COMPLETED"]
TERMINATED_STATUSES = ["TERMINATED", "WITHDRAWN", "SUSPENDED"]
ELIGIBLE_STATUSES = COMPLETED_STATUSES + TERMINATED_STATUSES

START_FROM = "2010-01-01"
START_TO = "2025-12-31"

WITH_LABEL = "With DMC"
WITHOUT_LABEL = "No DMC"
PHASE_NA = "N/A"

COHORT_ALL = "All Phase III/IV • Interventional • Industry"
COHORT_SUFFIX = " • Phase III/IV • Interventional • Industry"

TOP_AREAS = 12

# Texts that a pandas CSV reader takes for a missing value.
NA_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Characters that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
