"""Every cut-off: the value at, under and over it, and null."""

import datetime as dt

from pyspark.sql import functions as F

from cohortspark.functions import arrays, categories as cat, dates, numbers, strings


def values(spark, rows, schema, **cols):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in cols.items()]).collect()]


def one(spark, rows, schema, col):
    return [r[0] for r in values(spark, rows, schema, x=col)]


def test_trimester(spark):
    days = [(0,), (84,), (85,), (90,), (91,), (92,), (181,), (182,), (183,), (189,), (190,), (None,)]
    f, s, t = cat.TRIMESTERS
    assert one(spark, days, "d int", cat.trimester(F.col("d"))) == [f] * 5 + [s] * 5 + [t, None]
    assert one(spark, days, "d int", cat.trimester(F.col("d"), cat.TRIMESTER_CUTS["exposure"])) == [f] * 4 + [s] * 3 + [t] * 4 + [None]
    assert one(spark, days, "d int", cat.trimester(F.col("d"), cat.TRIMESTER_CUTS["breakdown"])) == [f] * 2 + [s] * 6 + [t] * 3 + [None]


def test_preterm_and_ruca(spark):
    assert one(spark, [(d,) for d in (259, 258, 238, 237, 224, 223, 196, 195, None)], "d int", cat.preterm(F.col("d"))) == [
        "term", "late_preterm", "late_preterm", "moderate_preterm", "moderate_preterm", "very_preterm", "very_preterm", "extremely_preterm", None]
    assert one(spark, [(x,) for x in (1.0, 3.9, 4.0, 6.9, 7.0, 9.9, 10.0, 98.0, 99.0, 100.0, None)], "d double", cat.ruca(F.col("d"))) == [
        "Metropolitan"] * 2 + ["Micropolitan"] * 2 + ["SmallTown"] * 2 + ["Rural"] * 2 + ["NotCoded", None, None]


def test_bands(spark):
    assert one(spark, [(x,) for x in (24.9, 25.0, 30.0, 35.0, 40.0, 44.9, 45.0, None)], "a double", cat.age_ordinal(F.col("a"))) == [0, 1, 2, 3, 4, 4, -1, -1]
    bmi = [14.9, 15.0, 17.9, 18.4, 18.6, 19.0, 24.9, 25.0, 30.0, 35.0, 39.9, 40.0, None, float("nan")]
    assert one(spark, [(x,) for x in bmi], "b double", cat.bmi_band(F.col("b"))) == [
        "Normal", "Underweight", "Underweight", "Underweight", "Underweight", "Normal", "Normal", "Overweight", "Obese", "Severely Obese", "Severely Obese",
        "Missing", "Missing", "Missing"]
    assert one(spark, [(x,) for x in ("-0.1", "0", "0.2", "0.4", "0.6", "0.8", "1", "1.1", "x", "nan", None)], "q string", cat.quintile(F.col("q"))) == [
        "Missing", "1st Quintile", "2nd Quintile", "3rd Quintile", "4th Quintile", "5th Quintile", "5th Quintile", "Missing", "Missing", "Missing", "Missing"]
    assert one(spark, [(x,) for x in ("0", "1", "2", "4", "5", None)], "p string", cat.parity_ordinal(F.col("p"))) == [0, 0, 1, 1, 2, 0]
    assert one(spark, [(x,) for x in ("0", "1", "2", "5", "6", None)], "p string", cat.gravidity_ordinal(F.col("p"))) == [0, 0, 1, 1, 2, 0]
    assert one(spark, [("0", 200), ("1", 258), ("1", 259), ("2", 200), (None, 200)], "h string, g int", cat.preterm_history(F.col("h"), F.col("g"))) == [0, 0, 1, 1, 0]


def test_texts_to_codes(spark):
    assert one(spark, [("Vaginal, Breech",), ("C-Section, Classical",), ("Other",), (None,)], "m string", cat.delivery_method(F.col("m"))) == [0, 1, -1, -1]
    assert one(spark, [("2 Vessels",), ("3 Vessels",), ("Unknown",), (None,)], "m string", cat.cord_vessels(F.col("m"))) == [0, 1, -1, -1]
    answers = [(["White"],), (["White", "White or Caucasian"],), (["Asian", "Other"],), (["Asian", "White"],), (["Declined", "Unknown"],), (["Other"],),
               (["Other", "Declined"],), ([],), (None,)]
    assert one(spark, answers, "r array<string>", cat.race(F.col("r"))) == [
        "White or Caucasian", "White or Caucasian", "Asian", "Multiracial", "Unknown", "Other", "Other", "Unknown", "Unknown"]
    assert one(spark, answers, "r array<string>", cat.race_simple(F.col("r"))) == [
        "White or Caucasian", "Multiracial", "Multiracial", "Multiracial", "Multiracial", "Other", "Multiracial", "Unknown", "Unknown"]
    eth = [("Hispanic or Latino",), ("Samoan",), ("Patient Refused",), (None,)]
    assert values(spark, eth, "e string", a=cat.ethnicity(F.col("e")), b=cat.ethnicity(F.col("e"), True)) == [
        ("Hispanic or Latino",) * 2, ("Not Hispanic or Latino",) * 2, ("Unknown", "Not Hispanic or Latino"), ("Unknown", "Unknown")]


def test_periods(spark):
    d = [(dt.date(2021, 4, 23),), (dt.date(2021, 4, 24),), (dt.date(2021, 7, 3),), (dt.date(2021, 12, 25),), (dt.date(2022, 3, 26),), (dt.date(2022, 5, 28),),
         (dt.date(2022, 7, 2),), (None,)]
    assert one(spark, d, "d date", cat.variant(F.col("d"))) == [*cat.VARIANTS, None]
    e = [(dt.date(2021, 5, 29),), (dt.date(2021, 5, 30),), (dt.date(2021, 7, 17),), (dt.date(2021, 12, 11),), (dt.date(2021, 12, 12),), (dt.date(2022, 1, 1),), (None,)]
    assert one(spark, e, "d date", cat.period(F.col("d"))) == ["pre-delta", None, "delta", "delta", None, "omicron", None]


def test_scores(spark):
    rows = [(6, "", "", 0, "Expired"), (6, "on", None, None, None), (6, None, "on", None, "Home"), (6, None, None, 1, None), (6, "", "", 0, None), (5, "on", "on", 3, None),
            (None, None, None, None, None)]
    col = cat.adjusted_score(*[F.col(c) for c in "ncepd"])
    assert one(spark, rows, "n int, c string, e string, p int, d string", col) == [8, 7, 7, 7, 6, 5, None]
    sev = [(True, 0, 0), (False, 2, 0), (False, 1, 0), (False, 0, 3), (False, 0, 2), (False, None, None)]
    assert one(spark, sev, "d boolean, v int, c int", cat.severity(F.col("d"), F.col("v"), F.col("c"))) == ["Severe", "Severe", "Moderate", "Moderate", "Mild", "Mild"]


def test_strings(spark):
    assert one(spark, [(" (Not)  Detected.* ",), (None,), ("a\tb   c",)], "s string", strings.clean_text(F.col("s"))) == ["not detected", "", "a\tb c"]
    assert one(spark, [("7",), ("1234",), ("12",)], "s string", strings.pad_front(F.col("s"))) == ["007", "234", "012"]
    notes = [("x G2P1001 y G9P9",), ("G3 P2 T1 P0 A1",), ("G4P2",), ("G5 P1",), ("none",), (None,)]
    g = strings.obstetric_notation(F.col("s"))
    assert values(spark, notes, "s string", n=g, g=strings.notation_gravidity(g), p=strings.notation_parity(g), t=strings.notation_preterm(g)) == [
        ("G2P1001", "2", "1", "0"), ("G3 P2 T1 P0 A1", "3", "2", "0"), ("G4P2", "4", "2", None), ("G5 P1", "5", "1", None), (None,) * 4, (None,) * 4]
    assert one(spark, [("Detected",), ("NOT detected",), ("see-note",), ("12",), (None,)], "s string", strings.result_class(F.col("s"))) == [
        "positive", "negative", "unknown", "unknown", "unknown"]
    assert one(spark, [("On ETT",), ("HFNC",), ("Nasal Cannula 2L",), ("fence",), ("Room air",), ("nothing",), (None,)], "s string", strings.support_level(F.col("s"))) == [
        6, 5, 4, 4, 3, None, None]
    pay = [("Medicare X", "a"), ("Medi-Cal", "a"), ("PREEXISTING CONDITION plan", "a"), ("crime victims", "a"), ("Patient Responsibility", "a"), ("Acme", "a"),
           (None, "OTHER GOVERNMENT"), (None, "PREMERA")]
    assert one(spark, pay, "p string, c string", strings.payer_class(F.col("p"), F.col("c"))) == [
        "Medicare", "Medicaid", "Self-pay", "Other", "Self-pay", "Commercial", "Other", "PREMERA"]


def test_dates_numbers_arrays(spark):
    d = dt.date
    rows = [(d(2020, 3, 10), d(2020, 3, 1)), (d(2020, 2, 1), d(2020, 3, 1)), (None, d(2020, 3, 1))]
    assert one(spark, rows, "e date, r date", dates.defined_index(F.col("e"), F.col("r"), [7, 0])) == [2, 0, None]
    assert one(spark, [(None, d(2020, 1, 5), d(2019, 1, 1), 0), (None, None, d(2019, 1, 1), 0), (None, None, None, 5)], "a date, b date, l date, g int",
               dates.delivery_or_estimate(F.col("a"), F.col("b"), F.col("l"), F.col("g"))) == [d(2020, 1, 5), d(2019, 10, 8), None]
    assert one(spark, [("11.94",), ("11.96",), ("99.94",), ("99.96",), ("x",), (None,)], "b string", numbers.clean_bmi(F.col("b"))) == [None, 12.0, 99.9, None, None, None]
    doses = [([d(2021, 1, 1)], d(2021, 6, 30)), ([d(2021, 1, 1)], d(2021, 7, 1)), ([d(2021, 1, 1)], d(2021, 1, 1)), (None, d(2021, 1, 2))]
    assert one(spark, doses, "a array<date>, d date", arrays.any_covers(F.col("a"), F.col("d"))) == [True, False, False, False]
    assert one(spark, [([1, 1, 2],), ([1],), (None,)], "a array<int>", arrays.nth_distinct(F.col("a"), 2)) == [2, None, None]
