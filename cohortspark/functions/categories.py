"""Category rules (Column -> Column): cut-offs and labels are parameters with the study's values as defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortspark.functions.strings import lookup

# Cut-offs (upper day of the first and second trimester) in the three rule sets.
TRIMESTER_CUTS = {"infection": (91, 189), "exposure": (90, 181), "breakdown": (84, 182)}
TRIMESTERS = ["1st trimester", "2nd trimester", "3rd trimester"]

# Gestational-day lower bounds, longest first.
PRETERM_BOUNDS = [(259, "term"), (238, "late_preterm"), (224, "moderate_preterm"), (196, "very_preterm")]
PRETERM_LABELS = ["term", "late_preterm", "moderate_preterm", "very_preterm", "extremely_preterm"]

# Upper bounds (exclusive) and labels of the ordinal bands.
AGE_CUTS = [(25, "18-25"), (30, "25-30"), (35, "30-35"), (40, "35-40"), (45, "40-45")]
BMI_CUTS = [(25, "Normal"), (30, "Overweight"), (35, "Obese"), (40, "Severely Obese")]
QUINTILE_CUTS = [(0.2, "1st Quintile"), (0.4, "2nd Quintile"), (0.6, "3rd Quintile"), (0.8, "4th Quintile")]
RUCA_CUTS = [(4, "Metropolitan"), (7, "Micropolitan"), (10, "SmallTown"), (99, "Rural")]
RUCA_CODES = {"Rural": 0, "SmallTown": 1, "Micropolitan": 2, "Metropolitan": 3}

# Delivery methods by group.
VAGINAL_METHODS = [
    "Vaginal, Spontaneous", "Vaginal, Vacuum (Extractor)", "Vaginal, Forceps", "Vaginal < 20 weeks",
    "Vaginal, Breech", "VBAC, Spontaneous", "Vaginal Birth after Cesarean Section", "Spontaneous Abortion",
]
SURGICAL_METHODS = [
    "C-Section, Low Transverse", "C-Section, Low Vertical", "C-Section, Classical", "C-Section, Unspecified",
]

# Race answers that carry no information, and the reporting domain.
RACE_REFUSALS = ["Patient Refused", "Unable to Determine", "Declined", "Unknown"]
RACES = [
    "White or Caucasian", "Asian", "Multiracial", "Other", "Black or African American",
    "Native Hawaiian or Other Pacific Islander", "American Indian or Alaska Native", "Unknown",
]

# Ancestry answers that count as not Hispanic.
NOT_HISPANIC = ["Not Hispanic or Latino", "American", "Samoan", "Yupik Eskimo", "Filipino", "Hmong", "Sudanese"]

# First day of each circulating-variant period.
VARIANT_STARTS = [
    ("2022-07-02", "Omicron BA.5"), ("2022-05-28", "Omicron BA.2.12.1"), ("2022-03-26", "Omicron BA.2"),
    ("2021-12-25", "Omicron"), ("2021-07-03", "Delta"), ("2021-04-24", "Alpha"),
]
VARIANTS = ["Wild-type", "Alpha", "Delta", "Omicron", "Omicron BA.2", "Omicron BA.2.12.1", "Omicron BA.5"]

# Closed date ranges of the three eras; dates in the gaps belong to none.
ERAS = [("pre-delta", None, "2021-05-29"), ("delta", "2021-07-17", "2021-12-11"), ("omicron", "2022-01-01", None)]

# Ordinal of an oxygen device and of a patient class.
OXYGEN_DEVICE_LEVELS = {
    "non-invasive ventilation (i.e. bi-level)": 3, "T-piece": 3, "heated": 2, "high-flow nasal cannula": 2,
    "manual bag ventilation": 2, "nonrebreather mask": 2, "partial rebreather mask": 2, "face tent": 2,
    "aerosol mask": 1, "nasal cannula": 1, "nasal cannula with humidification": 1,
    "nasal cannula with reservoir (i.e. oximizer)": 1, "simple face mask": 1, "open oxygen mask": 1, "blow by": 1,
    "other (see comments)": 1, "room air": 0, "Room air (None)": 0,
}
PATIENT_CLASS_LEVELS = {
    "Emergency": 2, "Extended Hospital Outpatient": 1, "Free Standing Outpatient": 1,
    "Hospital Ambulatory Surgery": 1, "Infusion Series": 1, "Inpatient": 3, "Inpatient Rehab Facility": 3,
    "MU Urgent Care": 2, "NM Series": 1, "Observation": 1, "Other Series": 1, "Outpatient": 1, "Outreach": 1,
    "Radiation/Oncology Series": 1, "Rural Health": 1, "Specimen": 1, "Therapies Series": 1,
}


def banded(col: Column, cuts: Sequence[tuple], above=None, missing=None) -> Column:
    """Label of the first cut the value lies under; ``above`` past the last one, ``missing`` for null."""
    out = F.when(col.isNull(), F.lit(missing))
    for bound, label in cuts:
        out = out.when(col < bound, F.lit(label))
    return out.otherwise(F.lit(above))


def trimester(days: Column, cuts: tuple[int, int] = TRIMESTER_CUTS["infection"]) -> Column:
    first, second = cuts
    return F.when(days <= first, TRIMESTERS[0]).when(days <= second, TRIMESTERS[1]).when(days > second, TRIMESTERS[2])


def preterm(days: Column) -> Column:
    out = F.when(days.isNull(), F.lit(None).cast("string"))
    for bound, label in PRETERM_BOUNDS:
        out = out.when(days >= bound, label)
    return out.otherwise("extremely_preterm")


def ruca(code: Column) -> Column:
    return F.when(code == 99, "NotCoded").otherwise(banded(code, RUCA_CUTS))


def ruca_ordinal(label: Column) -> Column:
    return lookup(label, RUCA_CODES, F.lit(-1))


def age_band(age: Column) -> Column:
    return banded(age, AGE_CUTS, above="Missing", missing="Missing")


def age_ordinal(age: Column) -> Column:
    return banded(age, [(b, i) for i, (b, _) in enumerate(AGE_CUTS)], above=-1, missing=-1)


def bmi_band(bmi: Column) -> Column:
    """Whole-number BMI bands. Values under 15 fall into Normal and 40 and over into Missing, as the study has it."""
    usable = F.when(~F.isnan(bmi), F.floor(bmi))
    return F.when((usable >= 15) & (usable < 18.5), "Underweight").otherwise(
        banded(usable, BMI_CUTS, above="Missing", missing="Missing")
    )


def bmi_ordinal(bmi: Column) -> Column:
    order = {"Underweight": 0, "Normal": 1, "Overweight": 2, "Obese": 3, "Severely Obese": 4}
    return lookup(bmi_band(bmi), order, F.lit(-1))


def quintile(value: Column) -> Column:
    """Quintile of an index in [0, 1]; anything else, negatives included, is Missing only."""
    v = value.try_cast("double")
    inside = F.when(~F.isnan(v) & (v >= 0) & (v <= 1), v)
    return banded(inside, QUINTILE_CUTS, above="5th Quintile", missing="Missing")


def parity_band(parity: Column) -> Column:
    n = parity.try_cast("int")
    return F.when(n.isNull() | (n <= 1), "Nulliparity").when(n < 5, "Low Multiparity").otherwise("Grand Multipara")


def gravidity_band(gravidity: Column) -> Column:
    n = gravidity.try_cast("int")
    return F.when(n.isNull() | (n <= 1), "Primagravida").when(n < 6, "Low Multigravidia").otherwise("Grand Multigravidia")


def parity_ordinal(parity: Column) -> Column:
    return lookup(parity_band(parity), {"Nulliparity": 0, "Low Multiparity": 1, "Grand Multipara": 2})


def gravidity_ordinal(gravidity: Column) -> Column:
    return lookup(gravidity_band(gravidity), {"Primagravida": 0, "Low Multigravidia": 1, "Grand Multigravidia": 2})


def preterm_history(history: Column, gest_days: Column) -> Column:
    """1 when an earlier birth was preterm; a single one that is the current preterm birth does not count."""
    n = history.try_cast("int")
    none = n.isNull() | (n == 0) | ((n == 1) & (gest_days < 259))
    return F.when(F.coalesce(none, F.lit(False)), 0).otherwise(1)


def fetal_sex(sex: Column) -> Column:
    return F.when(sex.isin("Male", "Female"), sex).otherwise("Unknown")


def delivery_method(method: Column) -> Column:
    return F.when(method.isin(VAGINAL_METHODS), 0).when(method.isin(SURGICAL_METHODS), 1).otherwise(-1)


def delivery_method_group(method: Column) -> Column:
    return F.when(method.contains("Vaginal"), "Vaginal").when(method.contains("C-Section"), "C-Section")


def living_status(text: Column) -> Column:
    """A birth counts as living unless it is recorded as a fetal demise."""
    return F.when(text == "Fetal Demise", text).otherwise("Living")


def cord_vessels(text: Column) -> Column:
    return F.when(text == "2 Vessels", 0).when(text == "3 Vessels", 1).otherwise(-1)


def vaccine_type(name: Column) -> Column:
    return F.when(name.contains("MODERNA"), 0).otherwise(1)


def status_at_conception(first: Column, full: Column, conception: Column) -> Column:
    """2 fully, 1 partly, 0 not vaccinated when the episode begins."""
    return F.when(full < conception, 2).when(first < conception, 1).otherwise(0)


def race(answers: Column) -> Column:
    """One label from all of a person's answers.

    'White' is recoded, refusals are dropped, 'Other' yields to a real answer, two or more left is
    Multiracial, nothing left is Unknown.
    """
    recoded = F.transform(answers, lambda a: F.when(a == "White", "White or Caucasian").otherwise(a))
    kept = F.array_distinct(F.filter(recoded, lambda a: a.isNotNull() & ~a.isin(RACE_REFUSALS)))
    specific = F.when(F.size(kept) > 1, F.array_remove(kept, "Other")).otherwise(kept)
    return (
        F.when(answers.isNull() | (F.size(kept) == 0), "Unknown")
        .when(F.size(specific) == 1, F.get(specific, F.lit(0)))
        .otherwise("Multiracial")
    )


def race_simple(answers: Column) -> Column:
    """Shorter rule: any two answers are Multiracial."""
    only = F.get(answers, F.lit(0))
    return (
        F.when(answers.isNull() | (F.size(answers) == 0), "Unknown")
        .when(F.size(answers) > 1, "Multiracial")
        .when(only == "White", "White or Caucasian")
        .when(only.isin(RACE_REFUSALS), "Unknown")
        .otherwise(only)
    )


def ethnicity(text: Column, literal: bool = False) -> Column:
    """Hispanic / not / unknown. ``literal`` maps every other non-null answer to not Hispanic."""
    base = F.when(text.isNull(), "Unknown").when(text == "Hispanic or Latino", "Hispanic or Latino")
    if literal:
        return base.otherwise("Not Hispanic or Latino")
    return base.when(text.isin(NOT_HISPANIC), "Not Hispanic or Latino").otherwise("Unknown")


def indicator(col: Column, value) -> Column:
    return F.when(col == value, 1).otherwise(0)


def variant(day: Column) -> Column:
    out = F.when(day.isNull(), F.lit(None).cast("string"))
    for start, name in VARIANT_STARTS:
        out = out.when(day >= F.to_date(F.lit(start)), name)
    return out.otherwise("Wild-type")


def period(day: Column, periods: Sequence[tuple[str, str | None, str | None]] = ERAS) -> Column:
    """Name of the closed period a day lies in; null in the gaps."""
    out = None
    for name, low, high in periods:
        cond = F.lit(True)
        if low:
            cond = cond & (day >= F.to_date(F.lit(low)))
        if high:
            cond = cond & (day <= F.to_date(F.lit(high)))
        cond = cond & day.isNotNull()
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def severity(died: Column, device: Column, patient_class: Column) -> Column:
    d, c = F.coalesce(device, F.lit(0)), F.coalesce(patient_class, F.lit(0))
    return F.when(died | (d >= 2), "Severe").when((c >= 3) | (d == 1), "Moderate").otherwise("Mild")


def adjusted_score(nominal: Column, crrt: Column, ecmo: Column, pressor: Column, disposition: Column) -> Column:
    """8 when expired; a nominal 6 with organ support becomes 7; otherwise the nominal score."""
    def present(c: Column) -> Column:
        return F.coalesce(c != "", F.lit(False))

    expired = F.coalesce(F.lower(disposition).contains("expired"), F.lit(False))
    supported = present(crrt) | present(ecmo) | F.coalesce(pressor > 0, F.lit(False))
    return F.when(expired, 8).when((nominal == 6) & supported, 7).otherwise(nominal)


SIZES_FOR_AGE = ["SGA", "normal"]


def size_for_age(percentile: Column) -> Column:
    """Small for gestational age up to the tenth percentile of growth; null without a percentile."""
    return F.when(percentile <= 10, "SGA").when(percentile.isNotNull(), "normal")


def any_given(total: Column) -> Column:
    """Whether a drug was given at all; no record means it was not."""
    return F.when(F.coalesce(total, F.lit(0)) > 0, "Yes").otherwise("No")
