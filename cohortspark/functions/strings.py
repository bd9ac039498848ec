"""String expressions (Column -> Column); all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters dropped before free-text results are compared.
DROPPED_CHARACTERS = ".*:-()"

# Cleaned result texts and the class each one belongs to.
POSITIVE_RESULTS = [
    "positive", "detected", "presumptive pos", "detected see scanned report", "detcted", "presumptive positive",
]
NEGATIVE_RESULTS = [
    "none detected", "undetected", "not dectected", "negative", "not detected", "not deteced",
    "not detected see scanned result", "not detectd", "not detected see scanned report", "negatiev",
    "not detected see media", "non detected", "not dtected", "not detected see scanned results", "not detecte",
]
REFERRED_RESULTS = [
    "see scanned report", "comment", "see scanned result", "abnormal see scanned report", "see report",
    "see scanned results", "see comments", "see scanned report covid19", "see comment", "please see scanned report",
    "see note", "separate report to follow", "see attached report",
    "refer to separate reference lab report for results",
]

# Substrings that place a respiratory-device text at a support level, highest level first.
SUPPORT_TERMS = {
    6: ["bag valve mask", "et tube", "ett", "manual bag ventilation", "mechanical ventilation",
        "o2/bag valve ventilation", "o2/ventilator", "transport vent", "ventilator"],
    5: ["aerosol mask", "aerosol trach", "bipap", "bi-pap", "bubble cpap", "continuous aerosol", "cpap", "hfnc",
        "high flow nasal cannula", "high flow nc", "high-flow nasal cannula", "high frequency ventilation",
        "laryngeal mask airway", "mask-aerosol", "mask-nrb", "nasal prongs", "ncpap", "non-invasive ventilation",
        "non-invasive ventilation (i.e. bi-level)", "non-invasive ventilation (niv)", "nonrebreather mask",
        "non-rebreather mask", "nrb mask", "tracheostomy collar", "vapotherm", "venti-mask", "venturi mask"],
    4: ["cannula", "face tent", "mask-simple", "nasal cannula", "nasal mask", "nc", "o2 via face mask",
        "o2 via nasal cannula", "o2/cannula", "o2/simple mask", "open oxygen mask", "oxygen hood", "oxygen tent",
        "oxymask", "partial rebreather mask", "simple face mask", "simple mask", "trach mask"],
    3: ["none - ra", "none (room air)", "room air", "room air (none)"],
}

# Payer class -> rank-prefixed coverage group (lowest rank wins per person).
COVERAGE_GROUPS = {
    "AETNA": "3_Commercial", "BASIC HEALTH PLAN": "3_Commercial", "CIGNA": "3_Commercial",
    "CIGNA FIRST CHOICE": "3_Commercial", "Capitation": "3_Commercial", "Commercial": "3_Commercial",
    "FIRST CHOICE": "3_Commercial", "GREAT WEST": "3_Commercial", "HEALTHY OPTIONS": "3_Commercial",
    "LABOR AND INDUSTRIES": "3_Commercial", "MEDICAID OTHER": "1_Medicaid", "MEDICARE HMO": "2_Medicare",
    "MEDICARE HMO MEDICAL GROUP": "2_Medicare", "Managed Care": "3_Commercial", "Medicaid": "1_Medicaid",
    "Medicaid HMO": "1_Medicaid", "Medicare": "2_Medicare", "Medicare HMO": "2_Medicare",
    "OTHER GOVERNMENT": "5_Other-Government", "OTHER MANAGED CARE": "3_Commercial", "Other": "6_Other",
    "PACIFICARE": "3_Commercial", "PACMED": "3_Commercial", "PREMERA": "3_Commercial", "REGENCE": "3_Commercial",
    "Self-pay": "4_Uninsured-Self-Pay", "UNIFORM MEDICAL": "5_Other-Government", "UNITED": "3_Commercial",
    "Worker's Comp": "6_Other", "Uninsured": "7_Uninsured",
}

# The four spellings of the obstetric summary, most specific first.
NOTATION_PATTERNS = [r"G\d{1}P\d{4}", r"G\d{1}\s+P\d{1}\s+T\d{1}\s+P\d{1}\s+A\d{1}", r"G\d{1}P\d{1}", r"G\d{1}\s{1}P\d{1}"]

_BLANKS = " \t\n\r\x0b\x0c"


def lookup(col: Column, table: dict, default: Column | None = None) -> Column:
    """Map a column through a small literal dictionary."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(entries, col)
    return found if default is None else F.coalesce(found, default)


def clean_text(col: Column) -> Column:
    """Drop punctuation, trim, lower-case, squeeze runs of spaces; null becomes ''."""
    kept = F.translate(F.coalesce(col, F.lit("")), DROPPED_CHARACTERS, "")
    return F.regexp_replace(F.lower(F.btrim(kept, F.lit(_BLANKS))), " +", " ")


def pad_front(col: Column, width: int = 3) -> Column:
    """Zero-pad on the left and keep the last ``width`` characters (long inputs lose their front)."""
    return F.right(F.concat(F.lit("0" * width), col.cast("string")), F.lit(width))


def split_code(col: Column) -> Column:
    """'VOCAB#code' -> struct(vocabulary, code)."""
    parts = F.split(col, "#")
    return F.struct(F.get(parts, F.lit(0)).alias("vocabulary"), F.get(parts, F.lit(1)).alias("code"))


def lab_code(code: Column, default_code: Column) -> Column:
    """The recorded code or its default, without one leading 'X'."""
    return F.regexp_replace(F.coalesce(code, default_code), "^X", "")


def first_of_pipe(col: Column) -> Column:
    return F.get(F.split(col, r"\|"), F.lit(0))


def obstetric_notation(note: Column) -> Column:
    """First match of the highest-priority spelling, else null (also for null notes)."""
    return F.coalesce(*[F.nullif(F.regexp_extract(note, p, 0), F.lit("")) for p in NOTATION_PATTERNS])


def notation_gravidity(notation: Column) -> Column:
    return F.nullif(F.regexp_extract(notation, r"G(\d)", 1), F.lit(""))


def notation_parity(notation: Column) -> Column:
    return F.nullif(F.regexp_extract(notation, r"P(\d)", 1), F.lit(""))


def notation_preterm(notation: Column) -> Column:
    """Second digit of a four-digit parity, else the second P when there are exactly two."""
    four = F.nullif(F.regexp_extract(notation, r"P\d(\d)\d\d", 1), F.lit(""))
    singles = F.regexp_extract_all(notation, F.lit(r"P(\d)"), F.lit(1))
    return F.coalesce(four, F.when(F.size(singles) == 2, F.get(singles, F.lit(1))))


def result_class(col: Column) -> Column:
    text = clean_text(col)
    return (
        F.when(text.isin(POSITIVE_RESULTS), "positive")
        .when(text.isin(NEGATIVE_RESULTS), "negative")
        .when(text.isin(REFERRED_RESULTS), "see report or comment")
        .otherwise("unknown")
    )


def support_level(col: Column) -> Column:
    """Respiratory support level 6..3 by substring, highest level first; null when nothing matches.

    Substrings match anywhere, so 'nc' also matches inside longer words.
    """
    text = F.lower(col)
    out = None
    for level, terms in SUPPORT_TERMS.items():
        hit = text.rlike("|".join(rf"\Q{t}\E" for t in terms))
        out = F.when(hit, F.lit(level)) if out is None else out.when(hit, F.lit(level))
    return out


def payer_class(payer: Column, financial_class: Column) -> Column:
    """Coverage class from the payer's name, or from the financial class when there is no payer."""
    text = F.lower(payer)

    def says(*words: str) -> Column:
        cond = text.contains(words[0])
        for w in words[1:]:
            cond = cond | text.contains(w)
        return cond

    from_class = F.when(financial_class.isin("OTHER GOVERNMENT", "UNIFORM MEDICAL"), "Other").otherwise(financial_class)
    return (
        F.when(payer.isNull(), from_class)
        .when(says("medicare"), "Medicare")
        .when(says("medicaid", "medi-cal"), "Medicaid")
        .when(says("uninsured", "preexisting condition"), "Self-pay")
        .when(says("workers compensation", "victims"), "Other")
        .when(says("patient responsibility"), "Self-pay")
        .otherwise("Commercial")
    )


def coverage_group(payer_class_col: Column) -> Column:
    """Rank-prefixed coverage group; unmapped classes are null."""
    return lookup(payer_class_col, COVERAGE_GROUPS)


def format_label(col: Column) -> Column:
    """'small_for_age' -> 'Small For Age'."""
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))
