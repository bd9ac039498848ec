"""Cohort definitions: exposure history, infection windows, eligibility.

An episode row has pat_id, instance, episode_id, conception, delivery, gest_days. Exposure history is one row
per person; a person's doses are first reduced to one per calendar day, so the ordered list of a person is
bounded by calendar days whatever the number of records. Infections are looked up on the calendar
(``timeline``) instead of pairing every test with every episode.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.arrays import any_covers, coverage_of_results
from cohortspark.functions.categories import TRIMESTER_CUTS, preterm, trimester
from cohortspark.functions.dates import gestation_days, pregnancy_start
from cohortspark.operators.joins import fan_out
from cohortspark.operators.timeline import daily, last_event, next_event

PERSON = ["pat_id", "instance"]
FULL_AFTER_DAYS = 14
BOOSTER_GAP_DAYS = 168


def person_test_status(tests: DataFrame, keys: Sequence[str] = PERSON, day: str = "test_date",
                result: str = "result") -> DataFrame:
    """Counts of tests, first and last date and overall category per person (no list is gathered)."""
    n = lambda v: F.sum((F.col(result) == v).cast("bigint"))
    out = tests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tests"), n("positive").alias("n_positive"), n("negative").alias("n_negative"),
        F.min(day).alias("first_test"), F.max(day).alias("last_test"),
        F.min(F.when(F.col(result) == "positive", F.col(day))).alias("first_positive"))
    return out.withColumn("results_category", coverage_of_results(F.col("n_positive"), F.col("n_negative")))


def maternity(episodes: DataFrame) -> DataFrame:
    """Adds gestation from the due date, the preterm class and the last period to episode rows."""
    days = gestation_days(F.col("delivery"), F.col("due"))
    return (
        episodes.withColumn("gestational_days", days)
        .withColumn("preterm_category", preterm(F.col("gestational_days")))
        .withColumn("lmp", pregnancy_start(F.col("delivery"), F.col("gestational_days")))
    )


# Episode types of the mother's and the child's blocks.
MOTHER_TYPE = "PREGNANCY"
CHILD_TYPES = ["DELIVERY", "DELIVERY SUMMARY", "STORK CONVERSION HBD"]


def mothers_and_children(blocks: DataFrame, vessels: DataFrame, child_columns: Sequence[str], parent: str = "mother_episode_id",
                         keys: Sequence[str] = ("episode_id", "instance")) -> DataFrame:
    """Mothers' episodes with their children's blocks and cord vessels; mothers whose child is not born stay.

    ``child_columns`` are read from the child's block and dropped from the mother's. ``vessels`` has child_episode_id, instance.
    """
    key, instance = keys
    kids = blocks.where(F.col("type").isin(CHILD_TYPES)).select(
        F.col(key).alias("child_episode_id"), instance, F.col("type").alias("child_type"), F.col(parent).alias(key), *child_columns)
    kids = kids.join(vessels, ["child_episode_id", instance], "left")
    mothers = blocks.where(F.col("type") == MOTHER_TYPE).drop("type", parent, *child_columns)
    return maternity(fan_out(mothers, kids, list(keys)))


def eligible(age: Column, gest_days: Column, fetuses: Column, delivery: Column, since: str) -> Column:
    """Single fetus, 18 <= age < 45, at least 140 days, delivered on or after the study start."""
    return (fetuses == 1) & (age >= 18) & (age < 45) & (gest_days >= 140) & (delivery >= F.to_date(F.lit(since)))


def exposure_history(doses: DataFrame, keys: Sequence[str] = PERSON) -> DataFrame:
    """One row per person: ordered distinct dose days with products, and the first, second, third and last of them.

    Date and product are kept together, so the product of the n-th dose is the product given on that day.
    """
    per_day = daily(doses, keys, "dose_date", {"product": F.min("product")})
    listed = per_day.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dose_date", "product"))).alias("doses"))
    out = listed.withColumn("n_doses", F.size("doses"))
    for i, name in enumerate(["first", "second", "third"]):
        item = F.get("doses", F.lit(i))
        out = out.withColumn(f"{name}_date", item["dose_date"]).withColumn(f"{name}_product", item["product"])
    last = F.element_at("doses", -1)
    return out.withColumn("last_date", last["dose_date"]).withColumn("last_product", last["product"])


def exposure_state(episodes: DataFrame, history: DataFrame, keys: Sequence[str] = PERSON, index: str = "delivery",
                   single: str = "JANSSEN", series: Sequence[str] = ("MODERNA", "PFIZER")) -> DataFrame:
    """Each episode with its exposure at the index date.

    full_date is the first dose + 14 days for the single-dose product (one product throughout, or no second dose
    before the index), else the second distinct dose day + 14 days when both doses are of one two-dose product.
    state: never / later / boosted / full / partial, where boosted means full with a third dose day before the index
    and partial is everything else.
    """
    df = episodes.join(history, list(keys), "left")
    at = F.col(index)

    def is_product(col: str, name: str) -> Column:
        return F.coalesce(F.col(col).contains(name), F.lit(False))

    alone = F.col("second_date").isNull() | (F.col("second_date") > at) | (F.col("first_product") == F.col("last_product"))
    by_one = is_product("first_product", single) & alone & (F.date_add("first_date", FULL_AFTER_DAYS) < at)
    same = reduce(lambda a, b: a | b, [is_product("first_product", p) & is_product("second_product", p) for p in series])
    by_two = same & (F.date_add("second_date", FULL_AFTER_DAYS) < at)
    df = df.withColumn("full_date", F.when(by_one, F.date_add("first_date", FULL_AFTER_DAYS)).when(
        by_two, F.date_add("second_date", FULL_AFTER_DAYS)))
    df = df.withColumn("full_product", F.when(by_one, F.col("first_product")).when(by_two, F.col("second_product")))
    boosted = by_two & (F.col("third_date") < at)
    df = df.withColumn("booster_date", F.when(boosted, F.col("third_date")))
    df = df.withColumn("booster_product", F.when(boosted, F.col("third_product")))
    return df.withColumn("state", (
        F.when(F.col("first_date").isNull(), "never").when(F.col("first_date") > at, "later")
        .when(F.col("booster_date").isNotNull(), "boosted").when(F.col("full_date").isNotNull(), "full")
        .otherwise("partial")))


def infection_in_episode(episodes: DataFrame, positives: DataFrame, keys: Sequence[str] = PERSON,
                         cuts=TRIMESTER_CUTS["exposure"]) -> DataFrame:
    """Adds the first positive test from conception to delivery, days from conception and trimester, and whether
    a positive precedes conception."""
    per_day = daily(positives, keys, "test_date", {"_n": F.count(F.lit(1))}).drop("_n")
    found = next_event(episodes, per_day, keys, "conception", "test_date", inclusive=True, prefix="infection_", first_before="prior_date")
    hit = F.when(F.col("infection_test_date") <= F.col("delivery"), F.col("infection_test_date"))
    out = found.withColumn("infection_date", hit).drop("infection_test_date")
    out = out.withColumn("prior_infection", F.col("prior_date").isNotNull().cast("int"))
    days = F.datediff("infection_date", "conception")
    return out.withColumn("days_from_conception", days).withColumn("infection_trimester", trimester(days, cuts))


def postnatal_infection(episodes: DataFrame, positives: DataFrame, keys: Sequence[str] = PERSON,
                        within: int = 42) -> DataFrame:
    """Episodes with a first positive 1..within days after delivery."""
    per_day = daily(positives, keys, "test_date", {"_n": F.count(F.lit(1))}).drop("_n")
    found = next_event(episodes, per_day, keys, "delivery", "test_date", inclusive=False, prefix="post_")
    days = F.datediff("post_test_date", "delivery")
    return found.withColumn("days_after_delivery", days).where(days <= within)


def breakthrough(states: DataFrame) -> DataFrame:
    """Infected episodes whose full exposure came before the test, with no earlier infection.

    ``states`` is ``exposure_state`` with the infection date as the index, over rows of ``infection_in_episode``.
    """
    return states.where((F.col("full_date") < F.col("infection_date")) & (F.col("prior_infection") == 0))


def breakthrough_rates(infected: DataFrame, everyone: DataFrame) -> DataFrame:
    """Breakthrough infections and fully exposed episodes per product class, with their ratio.

    ``infected`` is ``breakthrough``'s result, ``everyone`` is ``exposure_state``; a product's class is its first word.
    """
    word = F.regexp_extract("full_product", r"^\S+", 0).alias("product_class")
    marked = infected.select(word, F.lit(1).alias("hit")).unionByName(everyone.where("full_date is not null").select(word, F.lit(0).alias("hit")))
    n = marked.groupBy("product_class").agg(F.count(F.when(F.col("hit") == 1, 1)).alias("n_breakthrough"), F.count(F.when(F.col("hit") == 0, 1)).alias("n_full"))
    return n.withColumn("rate", F.try_divide("n_breakthrough", "n_full"))


def unexposed(state: Column) -> Column:
    """Never dosed, or first dose after the index."""
    return state.isin("never", "later")


def dose_timing(states: DataFrame) -> DataFrame:
    """Where the doses lie relative to the episode (seven patterns; others are null)."""
    c, d = F.col("conception"), F.col("delivery")
    first, full, last = F.col("first_date"), F.col("full_date"), F.col("last_date")
    boosted, two = F.col("state") == "boosted", F.col("state") == "full"
    pattern = (
        F.when(boosted & (c < first) & (d > last), "3 during")
        .when(boosted & (c > first) & (c < full) & (d > last), "1 before, 2 during")
        .when(boosted & (c > first) & (c > full) & (d > last) & (c < last), "2 before, 1 during")
        .when(boosted & (c > last), "3 before")
        .when(two & (c > last), "2 before")
        .when(two & (c > first) & (c < last) & (d > last), "1 before, 1 during")
        .when(two & (c < first) & (d > full), "2 during"))
    return states.withColumn("pattern", pattern)


TIMING_PATTERNS = ["3 during", "1 before, 2 during", "2 before, 1 during", "3 before", "2 before",
                   "1 before, 1 during", "2 during"]


def maintained(states: DataFrame, months: int = 6) -> DataFrame:
    """Episodes with some dose less than ``months`` before delivery."""
    dates = F.transform("doses", lambda x: x["dose_date"])
    return states.where(any_covers(dates, F.col("delivery"), months))


def one_dose(states: DataFrame) -> DataFrame:
    """Exactly one distinct dose day before delivery."""
    return states.where((F.col("first_date") < F.col("delivery")) &
                        (F.col("second_date").isNull() | (F.col("second_date") > F.col("delivery"))))


def immunity_lag(episodes: DataFrame, positives: DataFrame, keys: Sequence[str] = PERSON) -> DataFrame:
    """Days from the last positive before conception to conception."""
    per_day = daily(positives, keys, "test_date", {"_n": F.count(F.lit(1))}).drop("_n")
    found = last_event(episodes, per_day, keys, "conception", "test_date", inclusive=False, prefix="prior_")
    return found.where("prior_test_date is not null").withColumn("lag_days", F.datediff("conception", "prior_test_date"))
