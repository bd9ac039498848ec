"""Per-person and per-episode features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.categories import OXYGEN_DEVICE_LEVELS, PATIENT_CLASS_LEVELS, adjusted_score
from cohortspark.functions.strings import coverage_group, lookup, obstetric_notation, payer_class
from cohortspark.operators.joins import spine_join
from cohortspark.operators.timeline import daily, window_reduce
from cohortspark.session import broadcast_if_small

PERSON = ["pat_id", "instance"]

# Administration actions that mean the drug was given.
GIVEN_ACTIONS = [
    "Anesthesia Volume Adjustment", "Bolus from Bag", "Continued Bag", "Dispense to Home", "Given", "Given by Other",
    "New Bag", "New Syringe/Cartridge", "Patch Applied", "Push", "Rate Verify", "Rate Change",
    "Rate/Dose Change-Dual Sign", "Rate/Dose Verify-Dual Sign", "Restarted",
]


def condition_status(episodes: DataFrame, diagnoses: DataFrame, labels: Mapping[str, Column],
                     keys: Sequence[str] = PERSON, day: str = "dx_date", within: int = 280) -> DataFrame:
    """0/1 per condition: some entry with entry <= delivery <= entry + ``within`` days.

    ``labels`` maps an output name to a predicate on diagnosis rows; all conditions share one calendar pass.
    """
    per_day = daily(diagnoses, keys, day, {f"_f_{n}": F.max(F.when(c, 1).otherwise(0)) for n, c in labels.items()})
    flags = {n: F.max(f"_f_{n}") for n in labels}
    out = window_reduce(episodes, per_day, keys, "delivery", day, -within, 0, flags)
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in labels})


def social_history(people: DataFrame, history: DataFrame, flags: Mapping[str, str],
                   keys: Sequence[str] = PERSON) -> DataFrame:
    """0/1 per person: at least one 'Yes' in the column."""
    per_person = history.groupBy(*keys).agg(*[F.max((F.col(c) == "Yes").cast("int")).alias(n) for n, c in flags.items()])
    joined = people.join(per_person, list(keys), "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in flags})


def notes_notation(episodes: DataFrame, notes: DataFrame, keys: Sequence[str] = PERSON, day: str = "contact_date",
                   after: int = 3, back: int = 280) -> DataFrame:
    """Largest obstetric notation found in notes dated in (delivery + after - back, delivery + after].

    Each note is read once; per person and day only the largest notation is kept.
    """
    found = notes.withColumn("_g", obstetric_notation(F.col("text"))).where("_g is not null")
    per_day = daily(found, keys, day, {"_g": F.max("_g")})
    return window_reduce(episodes, per_day, keys, "delivery", day, after - back + 1, after, {"notation": F.max("_g")})


def daily_severity(devices: DataFrame, medications: DataFrame, admissions: DataFrame, discharges: DataFrame,
                   diagnoses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Five per-day tables on one (person, day) spine, with the adjusted severity score.

    Sources may be partly filled; nothing is lost when a day occurs in only one of them.
    """
    df = spine_join([devices, medications, admissions, discharges, diagnoses], keys)
    score = adjusted_score(F.col("nominal_score"), F.col("crrt"), F.col("ecmo"), F.col("vasopressor_sum"),
                           F.col("discharge_disposition"))
    return df.withColumn("score", score)


def max_levels(df: DataFrame, keys: Sequence[str], devices: str, pressor: str) -> DataFrame:
    """Highest oxygen-device ordinal per person over ';' lists of devices (unknown devices count as none).

    High-flow oxygen with a vasopressor on the same row counts as ventilated.
    """
    levels = F.transform(F.split(F.col(devices), ";"), lambda x: lookup(x, OXYGEN_DEVICE_LEVELS, F.lit(0)))
    highest = F.coalesce(F.array_max(levels), F.lit(0))
    raised = F.when((highest == 2) & (F.coalesce(F.col(pressor), F.lit(0)) > 0), 3).otherwise(highest)
    return df.groupBy(*keys).agg(F.max(raised).alias("max_device"))


def class_level(col: Column) -> Column:
    return lookup(col, PATIENT_CLASS_LEVELS, F.lit(0))


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str], last: bool = True) -> DataFrame:
    """The row with the greatest (or smallest) order tuple per key, as an aggregate with a map-side part."""
    row = F.struct(*keep)
    rank = F.struct(*order)
    best = F.max_by(row, rank) if last else F.min_by(row, rank)
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def encounter_summary(cohort: DataFrame, encounters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest device and class, number of encounters and worst score per person; people without any get defaults."""
    per = encounters.groupBy(*keys).agg(
        F.max("device_level").alias("max_device"), F.max("class_level").alias("max_class"),
        F.count(F.lit(1)).alias("n_encounters"), F.max(F.coalesce(F.col("score"), F.lit(3))).alias("score"))
    return cohort.join(per, list(keys), "left").na.fill({"max_device": 0, "max_class": 0, "n_encounters": 0, "score": 2})


def worst_encounter(cohort: DataFrame, encounters: DataFrame, keys: Sequence[str], keep: Sequence[str], score: str = "score",
                    duration: str = "duration") -> DataFrame:
    """Each person's worst encounter row: highest score (3 where missing), then longest duration, then the kept columns in turn.

    People without encounters have score 2 and nulls. One aggregate, so a person with many encounters is combined before the shuffle.
    """
    rank = F.struct(F.coalesce(F.col(score), F.lit(3)).alias(score), F.col(duration).alias(duration), *keep)
    worst = encounters.groupBy(*keys).agg(F.max(rank).alias("_worst")).select(*keys, "_worst.*")
    return cohort.join(worst, list(keys), "left").na.fill({score: 2})


def medication_counts(index: DataFrame, orders: DataFrame, keys: Sequence[str] = PERSON, at: str = "index_date",
                      day: str = "start_date", before: int = 14, after: int = 56) -> DataFrame:
    """Distinct drugs per person with start in [index - before, index + after): inpatient, outpatient, all.

    ``index`` has one row per person. Rows are reduced to (person, drug) before they are counted.
    """
    near = (F.col(day) >= F.date_sub(F.col(at), before)) & (F.col(day) < F.date_add(F.col(at), after))
    rows = orders.join(index.select(*keys, at), list(keys)).where(near)
    drugs = rows.groupBy(*keys, "short_name").agg(
        F.max((F.col("order_mode") == "Inpatient").cast("int")).alias("_i"),
        F.max((F.col("order_mode") == "Outpatient").cast("int")).alias("_o"))
    counts = drugs.where("short_name is not null").groupBy(*keys).agg(
        F.sum("_i").alias("n_inpatient"), F.sum("_o").alias("n_outpatient"), F.count(F.lit(1)).alias("n_total"))
    return index.join(counts, list(keys), "left").na.fill(0, ["n_inpatient", "n_outpatient", "n_total"])


def total_and_unique(df: DataFrame, keys: Sequence[str], item: str, name: str) -> DataFrame:
    """Rows and distinct items per key, counted in two steps."""
    per_item = df.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_n"))
    return per_item.groupBy(*keys).agg(
        F.sum("_n").alias(f"n_total_{name}"), F.count(item).alias(f"n_unique_{name}"))


def insurance(chain: DataFrame, keys: Sequence[str] = PERSON) -> DataFrame:
    """Best coverage group per person: lowest rank of the mapped payer classes, unmapped ones last."""
    group = coverage_group(payer_class(F.col("payor"), F.col("financial_class")))
    best = chain.groupBy(*keys).agg(F.min(group).alias("_g"))
    return best.select(*keys, F.get(F.split("_g", "_"), F.lit(1)).alias("insurance"))


def obstetric_counts(people: DataFrame, episodes: DataFrame, keys: Sequence[str] = PERSON,
                     min_days: int = 168) -> DataFrame:
    """Parity (episodes of at least ``min_days``) and gravidity (all) per person; 0 without any."""
    distinct = episodes.groupBy(*keys, "episode_id").agg(F.max("gest_days").alias("_d"))
    per = distinct.groupBy(*keys).agg(
        F.sum((F.col("_d") >= min_days).cast("bigint")).alias("parity"), F.count("episode_id").alias("gravidity"))
    return people.join(per, list(keys), "left").na.fill(0, ["parity", "gravidity"])


def death_flag(index: DataFrame, deaths: DataFrame, keys: Sequence[str] = PERSON, at: str = "index_date",
               months: int = 3) -> DataFrame:
    """Adds the death date when index <= death < index + months; people without one keep a null."""
    joined = index.join(deaths.select(*keys, "death_date"), list(keys), "left")
    near = (F.col("death_date") >= F.col(at)) & (F.col("death_date") < F.add_months(F.col(at), months))
    return joined.withColumn("death_date", F.when(near, F.col("death_date"))).withColumn(
        "died", F.col("death_date").isNotNull().cast("int"))


def growth_percentile(df: DataFrame, chart: DataFrame, weight: Column, gest_days: Column, sex: Column,
                      keys: Sequence[str]) -> DataFrame:
    """Percentile of a birth weight on a reference chart (sex, week, percentile, grams).

    Expected weights are interpolated between the two weeks around the age (and extrapolated along the first or
    last pair outside the chart), then the percentile is interpolated between the two curves around the weight.
    A weight under the lowest curve takes its percentile, over the highest that one's. Charts have a row per
    week and are made one row per (sex, week) before the join.
    """
    curves = F.array_sort(F.collect_list(F.struct("percentile", "grams")))
    per_week = chart.groupBy("sex", "week").agg(curves.alias("c"))
    w = Window.partitionBy("sex").orderBy("week")
    last = F.max("week").over(Window.partitionBy("sex"))
    pairs = (
        per_week.withColumn("c_next", F.lead("c").over(w)).withColumn("first_week", F.min("week").over(Window.partitionBy("sex")))
        .withColumn("last_start", last - 1).where("c_next is not null"))
    known = pairs.groupBy("sex").agg(F.min("first_week").alias("lo"), F.max("last_start").alias("hi"))
    sex_key = F.when(F.lower(sex).isin("male", "female"), F.lower(sex)).otherwise("unknown")
    base = df.select(*keys, sex_key.alias("sex"), weight.cast("double").alias("grams_seen"), (gest_days / 7.0).alias("age"))
    base = base.where("grams_seen is not null and age is not null")
    base = base.join(broadcast_if_small(known), "sex")
    start = F.least(F.greatest(F.floor("age").cast("int"), F.col("lo")), F.col("hi"))
    placed = base.withColumn("week", start).join(broadcast_if_small(pairs.select("sex", "week", "c", "c_next")), ["sex", "week"])
    step = F.col("age") - F.col("week")
    expected = F.zip_with("c", "c_next", lambda a, b: F.struct(
        a["percentile"].alias("p"), (a["grams"] + step * (b["grams"] - a["grams"])).alias("g")))
    placed = placed.withColumn("e", expected).withColumn("above", F.filter("e", lambda x: F.col("grams_seen") < x["g"]))
    up = F.get("above", F.lit(0))
    index = F.size("e") - F.size("above")
    down = F.get("e", index - 1)
    between = down["p"] + (up["p"] - down["p"]) * (F.col("grams_seen") - down["g"]) / (up["g"] - down["g"])
    value = (F.when(F.size("above") == 0, F.element_at("e", -1)["p"]).when(index == 0, F.get("e", F.lit(0))["p"])
             .otherwise(between))
    return placed.select(*keys, value.alias("growth_percentile"))


def log_trend(chart: DataFrame, by: Sequence[str] = ("sex", "percentile")) -> DataFrame:
    """Least-squares grams = slope * ln(week) + intercept per curve."""
    x = F.ln("week")
    return chart.groupBy(*by).agg(F.regr_slope("grams", x).alias("slope"), F.regr_intercept("grams", x).alias("intercept"))
