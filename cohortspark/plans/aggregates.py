"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions import categories as cat
from cohortspark.functions import numbers
from cohortspark.functions.dates import days_from
from cohortspark.functions.strings import COVERAGE_GROUPS, coverage_group, lookup
from cohortspark.operators import aggregate as agg
from cohortspark.operators import cohorts, features
from cohortspark.operators.cohorts import PERSON
from cohortspark.operators.ranks import exact_quantiles
from cohortspark.plans.registry import query
from cohortspark.sources.views import sql

_GENERIC = """round(avg(value), 6) AS value_avg, round(stddev_samp(value), 6) AS value_stddev, round(sum(value), 6) AS value_sum, count(value) AS value_count,
  min(value) AS value_min, max(value) AS value_max, round(median(value), 6) AS value_median,
  first(measure ORDER BY recorded_time, measure) AS measure_first, last(measure ORDER BY recorded_time, measure) AS measure_last"""


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("agg_generic", sql(f"""SELECT pat_id, instance, {_GENERIC}, string_agg(DISTINCT measure, ',' ORDER BY measure) AS measure_collect_set,
  round(avg(CASE WHEN value > 20 THEN 1 ELSE 0 END), 6) AS big_avg, sum(CASE WHEN value > 20 THEN 1 ELSE 0 END)::BIGINT AS big_sum
  FROM measure GROUP BY 1, 2""", "measure"))
def agg_generic(v):
    spec = {"value": ["avg", "stddev", "sum", "count", "min", "max", "median"], "measure": ["first", "last", "collect_set"], "big": ["avg", "sum"]}
    df = agg.aggregate(v.measure.withColumn("big", F.col("value") > 20), PERSON, spec, "recorded_time")
    df = _rounded(df, "value_avg", "value_stddev", "value_sum", "value_median", "big_avg")
    return df.withColumn("measure_collect_set", F.array_join("measure_collect_set", ","))


@query("agg_ordered_lists", sql("""SELECT pat_id, instance, row_number() OVER (PARTITION BY pat_id, instance ORDER BY recorded_time, event_id) AS position, event_id AS value FROM measure""", "measure"))
def agg_ordered_lists(v):
    """collect_list in time order for groups of any size: one row per element with its position."""
    return agg.ordered_elements(v.measure, PERSON, "event_id", "recorded_time")


@query("agg_lists_per_day", sql("""SELECT pat_id, instance, CAST(recorded_time AS DATE) AS day, string_agg(DISTINCT measure, ';' ORDER BY measure) AS measure_concat_ws FROM measure GROUP BY ALL""", "measure"))
def agg_lists_per_day(v):
    """concat_ws over the distinct measures of a day: at most one element per measure."""
    once = v.measure.select(*PERSON, F.to_date("recorded_time").alias("day"), "measure").distinct()
    return agg.aggregate(once, [*PERSON, "day"], {"measure": "concat_ws"}, "measure")


@query("agg_median", "SELECT o_custkey, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1")
def agg_median(v):
    return exact_quantiles(v.t("orders"), ["o_custkey"], "o_totalprice", {"median": 0.5}).withColumn("median", F.round("median", 4))


@query("agg_per_person", sql("SELECT pat_id, instance, status, count(price) AS price_count, max(price) AS price_max FROM episode GROUP BY ALL", "episode"))
def agg_per_person(v):
    return agg.aggregate_per_person(v.episode, {"price": ["count", "max"]}, "status")


@query("agg_by_time_index", sql("""SELECT pat_id, instance, count(value) FILTER (w = 1) AS value_count_early, max(value) FILTER (w = 1) AS value_max_early,
  count(value) FILTER (w = 2) AS value_count_late, max(value) FILTER (w = 2) AS value_max_late, count(value) FILTER (w IS NULL) AS value_count_other, max(value) FILTER (w IS NULL) AS value_max_other FROM (SELECT *,
  CASE WHEN extract(day FROM recorded_time) < 15 THEN 1 WHEN extract(day FROM recorded_time) >= 15 THEN 2 END AS w FROM measure) GROUP BY 1, 2""", "measure"))
def agg_by_time_index(v):
    """Halves of the month side by side; measures without a time are the other ones."""
    df = v.measure.withColumn("half", (F.dayofmonth("recorded_time") >= 15).cast("int"))
    out = agg.aggregate_by_index(df, PERSON, "half", {"value": ["count", "max"]}, None, ["early", "late"], wide=[0, 1])
    return out.na.fill(0, ["value_count_early", "value_count_late", "value_count_other"])


@query("agg_regular_windows", sql("""SELECT pat_id, instance, strftime(recorded_time, '%Y-%m-%d-') || lpad(CAST(hour(recorded_time) // 6 AS VARCHAR), 2, '0') AS time_index_6_hour,
  round(avg(value), 6) AS value_avg, count(value) AS value_count, last(measure ORDER BY recorded_time, measure) AS measure_last FROM measure GROUP BY ALL""", "measure"))
def agg_regular_windows(v):
    df = agg.aggregate_regular(v.measure, PERSON, {"value": ["avg", "count"], "measure": "last"}, "recorded_time", "6-hour")
    return _rounded(df.drop("time_index_6_hour_label"), "value_avg")


@query("agg_custom_windows", sql("""SELECT pat_id, instance, count(value) FILTER (d < 0) AS value_count_0, count(value) FILTER (d >= 0 AND d < 7) AS value_count_1,
  count(value) FILTER (d >= 7 AND d < 14) AS value_count_2, count(value) FILTER (d >= 14) AS value_count_3, count(value) FILTER (d IS NULL) AS value_count_other FROM (SELECT *,
  date_diff('day', DATE '2024-01-05', CAST(recorded_time AS DATE)) - instance AS d FROM measure) GROUP BY 1, 2""", "measure"))
def agg_custom_windows(v):
    df = v.measure.withColumn("ref", F.date_add(F.lit("2024-01-05").cast("date"), F.col("instance")))
    out = agg.aggregate_relative(df, PERSON, {"value": "count"}, "recorded_time", "ref", [0, 7, 14])
    return out.na.fill(0)


@query("agg_collect_set_group", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS answers FROM orders GROUP BY 1")
def agg_collect_set_group(v):
    return v.t("orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ";").alias("answers"))


@query("agg_collect_codes", """SELECT n_regionkey, string_agg('N' || n_nationkey, ';' ORDER BY 'N' || n_nationkey) AS codes,
  string_agg(n_name, ';' ORDER BY 'N' || n_nationkey) AS names, (SELECT count(*) FROM customer c JOIN nation m ON c.c_nationkey = m.n_nationkey
  WHERE m.n_regionkey = n.n_regionkey) AS n_people FROM nation n GROUP BY 1""")
def agg_collect_codes(v):
    """Aligned code and name lists per group; a list is bounded by the vocabulary."""
    nation = v.t("nation")
    pair = F.array_sort(F.collect_list(F.struct(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_name").alias("name"))))
    lists = nation.groupBy("n_regionkey").agg(pair.alias("l")).select(
        "n_regionkey", F.array_join(F.transform("l", lambda x: x["code"]), ";").alias("codes"), F.array_join(F.transform("l", lambda x: x["name"]), ";").alias("names"))
    people = v.t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n_people"))
    return lists.join(people, "n_regionkey")


@query("agg_count_distinct", sql("SELECT pat_id, instance, count(DISTINCT short_name) AS n_drugs FROM med GROUP BY 1, 2", "med"))
def agg_count_distinct(v):
    return v.med.select(*PERSON, "short_name").distinct().groupBy(*PERSON).agg(F.count("short_name").alias("n_drugs"))


@query("agg_pivot_count", sql("""SELECT pat_id, instance, count(*) FILTER (order_mode = 'Inpatient') AS inpatient_meds_count,
  count(*) FILTER (order_mode = 'Outpatient') AS outpatient_meds_count FROM med GROUP BY 1, 2""", "med"))
def agg_pivot_count(v):
    wide = v.med.groupBy(*PERSON).pivot("order_mode", ["Inpatient", "Outpatient"]).count().na.fill(0)
    return wide.withColumnsRenamed({"Inpatient": "inpatient_meds_count", "Outpatient": "outpatient_meds_count"})


@query("agg_total_unique", sql("""SELECT pat_id, instance, coalesce(n_total_diagnoses, 0) AS n_total_diagnoses, coalesce(n_unique_diagnoses, 0) AS n_unique_diagnoses FROM person
  LEFT JOIN (SELECT pat_id, instance, count(*) AS n_total_diagnoses, count(DISTINCT dx_id) AS n_unique_diagnoses FROM dx GROUP BY ALL) USING (pat_id, instance)""", "person", "dx"))
def agg_total_unique(v):
    counts = features.total_and_unique(v.dx, PERSON, "dx_id", "diagnoses")
    return v.person.select(*PERSON).join(counts, PERSON, "left").na.fill(0)


@query("agg_max_severity", sql("""SELECT pat_id, instance, max(CASE WHEN lvl = 2 AND value > 90 THEN 3 ELSE lvl END) AS max_device FROM (SELECT *,
  CASE measure WHEN 'click' THEN 2 WHEN 'error' THEN 3 WHEN 'purchase' THEN 1 ELSE 0 END AS lvl FROM measure) GROUP BY 1, 2""", "measure"))
def agg_max_severity(v):
    text = {"click": "high-flow nasal cannula;room air", "error": "T-piece", "purchase": "room air;nasal cannula", "view": "room air", "signup": "unlisted"}
    df = v.measure.select(*PERSON, lookup(F.col("measure"), text).alias("devices"), (F.col("value") > 90).cast("int").alias("pressor"))
    return features.max_levels(df, PERSON, "devices", "pressor")


@query("agg_global_minmax", sql("SELECT min(delivery) AS first_delivery, max(delivery) AS last_delivery, count(*) AS n FROM episode", "episode"))
def agg_global_minmax(v):
    return v.episode.agg(F.min("delivery").alias("first_delivery"), F.max("delivery").alias("last_delivery"), F.count(F.lit(1)).alias("n"))


_DIST = """WITH e AS (SELECT o_orderkey, CAST(140 + o_orderkey % 161 AS INTEGER) AS g, CAST(40 + o_orderkey % 120 AS DOUBLE) AS w, o_orderstatus AS s FROM orders),
 d AS (SELECT s, 'preterm' AS measure, CASE WHEN g >= 259 THEN 'term' WHEN g >= 238 THEN 'late_preterm' WHEN g >= 224 THEN 'moderate_preterm'
   WHEN g >= 196 THEN 'very_preterm' ELSE 'extremely_preterm' END AS category FROM e
 UNION ALL SELECT s, 'term', CASE WHEN g >= 259 THEN 'term' ELSE 'preterm' END FROM e
 UNION ALL SELECT s, 'low_weight', CASE WHEN w < 88.1849 THEN 'low_birth_weight' ELSE 'normal_birth_weight' END FROM e
 UNION ALL SELECT s, 'very_low_weight', CASE WHEN w < 52.91094 THEN 'extremely_low_birth_weight' ELSE 'normal_birth_weight' END FROM e
 UNION ALL SELECT s, 'sex', CASE o_orderkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Unknown' END FROM e
 UNION ALL SELECT s, 'trimester', CASE WHEN g - 140 <= 91 THEN '1st trimester' WHEN g - 140 <= 189 THEN '2nd trimester' ELSE '3rd trimester' END FROM e)"""


def distribution(v):
    """Counts of six outcome categories by group, zero cells included, from one scan."""
    e = v.episode
    measures = {
        "preterm": (cat.preterm(F.col("gest_days")), cat.PRETERM_LABELS),
        "term": (F.when(F.col("gest_days") >= 259, "term").otherwise("preterm"), ["term", "preterm"]),
        "low_weight": (F.when(F.col("weight_oz") < 88.1849, "low_birth_weight").otherwise("normal_birth_weight"), ["low_birth_weight", "normal_birth_weight"]),
        "very_low_weight": (F.when(F.col("weight_oz") < 52.91094, "extremely_low_birth_weight").otherwise("normal_birth_weight"),
                            ["extremely_low_birth_weight", "normal_birth_weight"]),
        "sex": (cat.fetal_sex(F.col("sex")), ["Male", "Female", "Unknown"]),
        "trimester": (cat.trimester(F.col("gest_days") - 140), cat.TRIMESTERS),
    }
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), c.alias("category")) for m, (c, _) in measures.items()])
    counted = e.select(F.col("status").alias("s"), F.inline(cells)).groupBy("s", "measure", "category").agg(F.count(F.lit(1)).alias("n"))
    domain = F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(d).alias("category")) for m, (_, ds) in measures.items() for d in ds])
    every = counted.select("s").distinct().select("s", F.inline(domain))
    return every.join(counted, ["s", "measure", "category"], "left").na.fill(0, ["n"])


@query("agg_category_distribution", _DIST + """, m AS (SELECT measure, category FROM d UNION SELECT 'trimester', '3rd trimester'), g AS (SELECT DISTINCT s FROM d)
  SELECT g.s, m.measure, m.category, count(d.s) AS n FROM g CROSS JOIN m LEFT JOIN d ON d.s = g.s AND d.measure = m.measure AND d.category = m.category GROUP BY ALL""")
def agg_category_distribution(v):
    return distribution(v)


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _counts_sql(rows: str, by: str, measures: dict[str, tuple[str, list[str]]]) -> str:
    """Counts of every label of every domain, and of the rows with no label of it, written plainly."""
    parts = []
    for m, (label, domain) in measures.items():
        cells = ", ".join(f"({_quoted([d])})" for d in [*domain, "none of these"])
        parts.append(f"""SELECT {by}, '{m}' AS measure, category, count(*) FILTER (CASE WHEN v IN ({_quoted(domain)}) THEN v ELSE 'none of these' END = category) AS n
          FROM (SELECT {by}, {label} AS v FROM {rows}) CROSS JOIN (VALUES {cells}) d(category) GROUP BY ALL""")
    return " UNION ALL ".join(parts)


_AGES = ["18-25", "25-30", "30-35", "35-40", "40-45"]
_BMIS = ["Underweight", "Normal", "Overweight", "Obese", "Severely Obese"]
_QUINTILES = ["1st Quintile", "2nd Quintile", "3rd Quintile", "4th Quintile", "5th Quintile"]
_PARITIES = ["Nulliparity", "Low Multiparity", "Grand Multipara"]
_GRAVIDITIES = ["Primagravida", "Low Multigravidia", "Grand Multigravidia"]
_RUCAS = ["Metropolitan", "Micropolitan", "SmallTown", "Rural", "NotCoded"]


@query("agg_category_demographics", sql(_counts_sql("(SELECT segment, 18 + pat_id % 30 AS a, 10 + floor(balance / 250) AS b, balance / 8000 AS q, pat_id % 8 AS p, CASE WHEN nation = 24 THEN 99 ELSE nation END AS r FROM person)", "segment", {
    "age": ("CASE WHEN a < 25 THEN '18-25' WHEN a < 30 THEN '25-30' WHEN a < 35 THEN '30-35' WHEN a < 40 THEN '35-40' WHEN a < 45 THEN '40-45' ELSE 'Missing' END", [*_AGES, "Missing"]),
    "bmi": ("CASE WHEN b >= 15 AND b < 18.5 THEN 'Underweight' WHEN b < 25 THEN 'Normal' WHEN b < 30 THEN 'Overweight' WHEN b < 35 THEN 'Obese' WHEN b < 40 THEN 'Severely Obese' ELSE 'Missing' END", [*_BMIS, "Missing"]),
    "quintile": ("CASE WHEN q < 0 OR q > 1 THEN 'Missing' WHEN q < 0.2 THEN '1st Quintile' WHEN q < 0.4 THEN '2nd Quintile' WHEN q < 0.6 THEN '3rd Quintile' WHEN q < 0.8 THEN '4th Quintile' ELSE '5th Quintile' END", [*_QUINTILES, "Missing"]),
    "parity": ("CASE WHEN p <= 1 THEN 'Nulliparity' WHEN p < 5 THEN 'Low Multiparity' ELSE 'Grand Multipara' END", _PARITIES),
    "gravidity": ("CASE WHEN p <= 1 THEN 'Primagravida' WHEN p < 6 THEN 'Low Multigravidia' ELSE 'Grand Multigravidia' END", _GRAVIDITIES),
    "ruca": ("CASE WHEN r < 4 THEN 'Metropolitan' WHEN r < 7 THEN 'Micropolitan' WHEN r < 10 THEN 'SmallTown' WHEN r < 99 THEN 'Rural' ELSE 'NotCoded' END", _RUCAS)}), "person"))
def agg_category_demographics(v):
    p = v.person.select("segment", "pat_id", (F.lit(18) + F.col("pat_id") % 30).alias("a"), (F.lit(10) + F.floor(F.col("balance") / 250)).cast("double").alias("b"),
                        (F.col("balance") / 8000).alias("q"), (F.col("pat_id") % 8).alias("par"), F.when(F.col("nation") == 24, 99).otherwise(F.col("nation")).alias("r"))
    measures = {"age": (cat.age_band(F.col("a")), [*_AGES, "Missing"]), "bmi": (cat.bmi_band(F.col("b")), [*_BMIS, "Missing"]),
                "quintile": (cat.quintile(F.col("q")), [*_QUINTILES, "Missing"]), "parity": (cat.parity_band(F.col("par")), _PARITIES),
                "gravidity": (cat.gravidity_band(F.col("par")), _GRAVIDITIES), "ruca": (cat.ruca(F.col("r")), _RUCAS)}
    return agg.category_counts(p, measures, ["segment"])


# The percentile of a birth weight on the chart, for every episode, and how many small packs were ordered with it.
_OUTCOMES = """growth AS (SELECT episode_id, CASE WHEN n_above = 0 THEN 95.0 WHEN n_above = 5 THEN 5.0 ELSE plo + (phi - plo) * (w - glo) / (ghi - glo) END AS gp FROM (
  SELECT episode_id, w, count(*) FILTER (w < g) AS n_above, min(p) FILTER (w < g) AS phi, min(g) FILTER (w < g) AS ghi, max(p) FILTER (w >= g) AS plo, max(g) FILTER (w >= g) AS glo FROM (
    SELECT e.episode_id, a.percentile AS p, a.grams + (e.age - e.wk) * (b.grams - a.grams) AS g, e.w FROM (SELECT episode_id, gest_days / 7.0 AS age, least(greatest(CAST(floor(gest_days / 7.0) AS INTEGER), 14), 39) AS wk,
      CASE WHEN weight_oz < 500 THEN weight_oz * 28.3495 ELSE weight_oz END AS w, CASE WHEN sex = 'Male' THEN 'male' WHEN sex = 'Female' THEN 'female' ELSE 'unknown' END AS sx FROM episode) e
    JOIN chart a ON a.sex = e.sx AND a.week = e.wk JOIN chart b ON b.sex = a.sex AND b.percentile = a.percentile AND b.week = e.wk + 1) GROUP BY ALL)),
  pressor AS (SELECT l_orderkey AS episode_id, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size <= 10 GROUP BY 1),
  outcome AS (SELECT status, gp, n FROM episode LEFT JOIN growth USING (episode_id) LEFT JOIN pressor USING (episode_id))"""


@query("agg_category_outcomes", sql(_counts_sql("outcome", "status", {"size_for_age": ("CASE WHEN gp <= 10 THEN 'SGA' WHEN gp > 10 THEN 'normal' END", cat.SIZES_FOR_AGE),
                                                                      "vasopressor": ("CASE WHEN n > 0 THEN 'Yes' ELSE 'No' END", ["Yes", "No"])}), "episode", "chart", extra=_OUTCOMES))
def agg_category_outcomes(v):
    """Episodes by status: small for gestational age by the growth chart, and whether a vasopressor (here: a part of a small size) was given."""
    key = ["episode_id"]
    grown = features.growth_percentile(v.episode, v.chart, numbers.grams(F.col("weight_oz")), F.col("gest_days"), F.col("sex"), key)
    small = v.t("part").where("p_size <= 10").select(F.col("p_partkey").alias("l_partkey"))
    given = v.t("lineitem").join(small, "l_partkey").groupBy(F.col("l_orderkey").alias("episode_id")).agg(F.count(F.lit(1)).alias("n"))
    rows = v.episode.select("episode_id", "status").join(grown, key, "left").join(given, key, "left")
    return agg.category_counts(rows, {"size_for_age": (cat.size_for_age(F.col("growth_percentile")), cat.SIZES_FOR_AGE),
                                      "vasopressor": (cat.any_given(F.col("n")), ["Yes", "No"])}, ["status"])


# Answers of the test episodes, by a rule on their keys (null stands for no answer).
ANSWERS = {
    "race": ["White", "Asian", "Black or African American", "Other", "Patient Refused", "American Indian or Alaska Native"],
    "ethnicity": ["Hispanic or Latino", "Not Hispanic or Latino", "Hmong", "no such answer", None],
    "method": ["Vaginal, Spontaneous", "C-Section, Low Transverse", "VBAC, Spontaneous", None],
    "living": ["Living", "Living", None, "Fetal Demise", "Living", None, "Living"],
    "payer": ["Medicaid", "Medicare HMO", "PREMERA", "Self-pay", "Uninsured", "Worker's Comp", "no such class"],
    "device": ["room air", "nasal cannula", "heated", "T-piece", "no such device"],
    "class": ["Emergency", "Inpatient", "Outpatient", None],
    "cord": ["2 Vessels", "3 Vessels", "not seen"],
}
_GROUPS = sorted(set(COVERAGE_GROUPS.values()))
_ERAS = [e[0] for e in cat.ERAS]


def answer(name: str):
    return F.get(F.array(*[F.lit(a) for a in ANSWERS[name]]), (F.col("episode_id") % len(ANSWERS[name])).cast("int"))


_LATER = "delivery + 8766"
_K = "episode_id"


@query("agg_category_clinical", sql(_counts_sql("episode", "status", {
    "race": (f"CASE {_K} % 6 WHEN 1 THEN 'Asian' WHEN 3 THEN CASE WHEN {_K} % 11 = 0 THEN 'Asian' ELSE 'Other' END WHEN 4 THEN CASE WHEN {_K} % 11 = 0 THEN 'Asian' ELSE 'Unknown' END ELSE CASE WHEN {_K} % 11 = 0 THEN 'Multiracial' "
             f"ELSE ['White or Caucasian', '', 'Black or African American', '', '', 'American Indian or Alaska Native'][{_K} % 6 + 1] END END", cat.RACES),
    "race_simple": (f"CASE WHEN {_K} % 11 = 0 AND {_K} % 6 <> 1 THEN 'Multiracial' ELSE ['White or Caucasian', 'Asian', 'Black or African American', 'Other', 'Unknown', 'American Indian or Alaska Native'][{_K} % 6 + 1] END", cat.RACES),
    "ethnicity": (f"CASE {_K} % 5 WHEN 0 THEN 'Hispanic or Latino' WHEN 1 THEN 'Not Hispanic or Latino' WHEN 2 THEN 'Not Hispanic or Latino' ELSE 'Unknown' END", ["Hispanic or Latino", "Not Hispanic or Latino", "Unknown"]),
    "delivery_method": (f"CASE {_K} % 4 WHEN 0 THEN 'Vaginal' WHEN 1 THEN 'C-Section' END", ["Vaginal", "C-Section"]),
    "living_status": (f"CASE WHEN {_K} % 7 = 3 THEN 'Fetal Demise' ELSE 'Living' END", ["Living", "Fetal Demise"]),
    "preterm_history": (f"CASE WHEN {_K} % 3 = 0 OR ({_K} % 3 = 1 AND gest_days < 259) THEN '0' ELSE '1' END", ["0", "1"]),
    "variant": (f"CASE WHEN {_LATER} >= DATE '2022-07-02' THEN 'Omicron BA.5' WHEN {_LATER} >= DATE '2022-05-28' THEN 'Omicron BA.2.12.1' WHEN {_LATER} >= DATE '2022-03-26' THEN 'Omicron BA.2' "
                f"WHEN {_LATER} >= DATE '2021-12-25' THEN 'Omicron' WHEN {_LATER} >= DATE '2021-07-03' THEN 'Delta' WHEN {_LATER} >= DATE '2021-04-24' THEN 'Alpha' ELSE 'Wild-type' END", cat.VARIANTS),
    "era": (f"CASE WHEN {_LATER} <= DATE '2021-05-29' THEN 'pre-delta' WHEN {_LATER} BETWEEN DATE '2021-07-17' AND DATE '2021-12-11' THEN 'delta' WHEN {_LATER} >= DATE '2022-01-01' THEN 'omicron' END", _ERAS),
    "insurance": (f"['1_Medicaid', '2_Medicare', '3_Commercial', '4_Uninsured-Self-Pay', '7_Uninsured', '6_Other', NULL][{_K} % 7 + 1]", _GROUPS),
    "oxygen_device": (f"['0', '1', '2', '3', NULL][{_K} % 5 + 1]", ["0", "1", "2", "3"]),
    "patient_class": (f"['2', '3', '1', NULL][{_K} % 4 + 1]", ["1", "2", "3"]),
    "hospitalised": (f"CASE WHEN {_K} % 4 = 1 THEN '1' ELSE '0' END", ["0", "1"]),
    "cord_vessels": (f"['0', '1', '-1'][{_K} % 3 + 1]", ["0", "1", "-1"]),
    "exposure_trimester": (f"CASE WHEN {_K} % 280 <= 90 THEN '1st trimester' WHEN {_K} % 280 <= 181 THEN '2nd trimester' ELSE '3rd trimester' END", cat.TRIMESTERS)}), "episode"))
def agg_category_clinical(v):
    """Clinical and social categories of episodes by status: fixed domains, zero cells and a row for all other answers."""
    both = F.when(F.col("episode_id") % 11 == 0, F.array_distinct(F.array(answer("race"), F.lit("Asian")))).otherwise(F.array(answer("race")))
    later = F.date_add("delivery", 8766)
    text = lambda c: c.cast("string")
    measures = {
        "race": (cat.race(both), cat.RACES), "race_simple": (cat.race_simple(both), cat.RACES),
        "ethnicity": (cat.ethnicity(answer("ethnicity")), ["Hispanic or Latino", "Not Hispanic or Latino", "Unknown"]),
        "delivery_method": (cat.delivery_method_group(answer("method")), ["Vaginal", "C-Section"]),
        "living_status": (cat.living_status(answer("living")), ["Living", "Fetal Demise"]),
        "preterm_history": (text(cat.preterm_history(text(F.col("episode_id") % 3), F.col("gest_days"))), ["0", "1"]),
        "variant": (cat.variant(later), cat.VARIANTS), "era": (cat.period(later), _ERAS),
        "insurance": (coverage_group(answer("payer")), _GROUPS),
        "oxygen_device": (text(lookup(answer("device"), cat.OXYGEN_DEVICE_LEVELS)), ["0", "1", "2", "3"]),
        "patient_class": (text(lookup(answer("class"), cat.PATIENT_CLASS_LEVELS)), ["1", "2", "3"]),
        "hospitalised": (text(F.coalesce(cat.indicator(answer("class"), "Inpatient"), F.lit(0))), ["0", "1"]),
        "cord_vessels": (text(cat.cord_vessels(answer("cord"))), ["0", "1", "-1"]),
        "exposure_trimester": (cat.trimester(F.col("episode_id") % 280, cat.TRIMESTER_CUTS["exposure"]), cat.TRIMESTERS),
    }
    return agg.category_counts(v.episode, measures, ["status"])


@query("agg_proportion_table", _DIST + """, m AS (SELECT measure, category FROM d UNION SELECT 'trimester', '3rd trimester'), g AS (SELECT DISTINCT s FROM d),
  c AS (SELECT g.s, m.measure, m.category, count(d.s) AS n FROM g CROSS JOIN m LEFT JOIN d ON d.s = g.s AND d.measure = m.measure AND d.category = m.category GROUP BY ALL)
  SELECT *, round(n / sum(n) OVER (PARTITION BY s, measure), 8) AS share FROM c""")
def agg_proportion_table(v):
    return agg.proportions(distribution(v), ["s", "measure"]).withColumn("share", F.round("share", 8))


@query("agg_describe", """SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(median(o_totalprice), 4) AS median,
  round(quantile_cont(o_totalprice, 0.75), 4) AS q3, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr, max(o_totalprice) AS max FROM orders GROUP BY 1""")
def agg_describe(v):
    df = agg.describe(v.t("orders"), ["o_orderstatus"], "o_totalprice")
    return df.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3", "iqr")})


@query("agg_parity_counts", sql("""SELECT p.pat_id, p.instance, count(DISTINCT episode_id) FILTER (gest_days >= 168) AS parity, count(DISTINCT episode_id) AS gravidity
  FROM person p LEFT JOIN episode e USING (pat_id, instance) GROUP BY ALL""", "person", "episode"))
def agg_parity_counts(v):
    return features.obstetric_counts(v.person.select(*PERSON), v.episode)


@query("agg_weekly_rate", sql("""SELECT w.week, coalesce(n, 0) AS n, coalesce(n_events, 0)::BIGINT AS n_events, round(CASE WHEN n > 9 THEN 100.0 * n_events / n ELSE 0 END, 8) AS rate
  FROM (SELECT CAST(unnest(range((SELECT least(min(week), 0) FROM x), (SELECT greatest(max(week) + 1, 91) FROM x))) AS INTEGER) AS week) w LEFT JOIN x USING (week)""", "infection",
  extra="""x AS (SELECT CAST(floor(date_diff('day', DATE '1998-01-26', delivery) / 7) AS INTEGER) AS week, count(*) AS n, sum(CASE WHEN infection_date IS NOT NULL THEN 1 ELSE 0 END) AS n_events
  FROM infection WHERE delivery IS NOT NULL GROUP BY 1)"""))
def agg_weekly_rate(v):
    infected = cohorts.infection_in_episode(v.episode, v.positive)
    df = agg.weekly_rate(infected, "delivery", F.col("infection_date").isNotNull(), "1998-01-26", 91)
    return df.withColumn("rate", F.round("rate", 8))


@query("agg_histogram", """WITH d AS (SELECT date_diff('day', DATE '1997-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders) SELECT CAST(b AS INTEGER) AS bin, CASE WHEN b >= 0 THEN CAST(b * 20 AS DOUBLE) END AS bin_start,
  (SELECT count(*) FROM d WHERE CASE b WHEN -1 THEN d < 0 WHEN 40 THEN d >= 800 ELSE d >= b * 20 AND d < (b + 1) * 20 END) AS n FROM range(-1, 41) r(b)""")
def agg_histogram(v):
    return agg.histogram(v.t("orders"), days_from("1997-01-01", F.to_date("o_orderdate")), 0, 800, 40)


@query("agg_histogram_range", """WITH d AS (SELECT CAST(l_quantity AS DOUBLE) AS v FROM lineitem), r AS (SELECT min(v) AS lo, (max(v) - min(v)) / 12 AS w FROM d)
  SELECT CAST(b AS INTEGER) AS bin, lo + b * w AS bin_start, (SELECT count(*) FROM d WHERE least(floor((v - lo) / w), 11) = b) AS n FROM r, range(0, 12) t(b)""")
def agg_histogram_range(v):
    return agg.histogram(v.t("lineitem"), F.col("l_quantity"), bins=12)
