"""Concept, cohort and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions import categories as cat
from cohortspark.functions.dates import age_years
from cohortspark.operators import aggregate as agg
from cohortspark.operators import cohorts, concepts, features, joins, matching
from cohortspark.operators.cohorts import PERSON
from cohortspark.plans.registry import query
from cohortspark.plans.relational import CHAIN, CODES, EPISODE, concept_tables, coverage_tables, label_codes
from cohortspark.plans.scalars import GPAL, NOTE, notes
from cohortspark.sources.views import CODE_LABELS, sql, state_sql

# ---- concepts ----------------------------------------------------------------------------------------------------


@query("concept_codes", sql("SELECT DISTINCT label, code, name FROM codes", extra=CODES))
def concept_codes(v):
    concept, ancestor, _ = concept_tables(v)
    return concepts.concept_codes(label_codes(v), concept, ancestor)


def local_ids(v):
    concept, ancestor, mapping = concept_tables(v)
    return concepts.source_ids(concepts.expand_by_hierarchy(label_codes(v), concept, ancestor), mapping, "NAT", "dx_id")


IDS = CODES + """, ids AS (SELECT DISTINCT label, s_suppkey AS dx_id, CAST(s_suppkey % 3 + 1 AS INTEGER) AS instance FROM supplier JOIN codes ON code = 'N' || s_nationkey)"""


@query("concept_source_ids", sql("SELECT label, dx_id, instance FROM ids", extra=IDS))
def concept_source_ids(v):
    return local_ids(v)


@query("concept_reverse_codes", sql("""SELECT dx_id, instance, 'N' || s_nationkey AS codes, n_name AS names FROM (SELECT DISTINCT dx_id, instance FROM ids) JOIN supplier ON s_suppkey = dx_id
  JOIN nation ON n_nationkey = s_nationkey""", extra=IDS))
def concept_reverse_codes(v):
    concept, _, mapping = concept_tables(v)
    return concepts.reverse_codes(local_ids(v), mapping, concept, "NAT", "dx_id")


@query("concept_flag", sql("""SELECT pat_id, dx_id, dx_date, (dx_id, instance) IN (SELECT dx_id, instance FROM ids WHERE label = 'west') AS west,
  (dx_id, instance) IN (SELECT dx_id, instance FROM ids WHERE label = 'east') AS east FROM dx""", "dx", extra=IDS))
def concept_flag(v):
    return concepts.add_concept_flags(v.dx, local_ids(v), "dx_id", ["west", "east"]).select("pat_id", "dx_id", "dx_date", "west", "east")


@query("concept_value", """SELECT l_orderkey, l_partkey, CASE WHEN l_returnflag = 'A' THEN l_quantity END AS flag_a, CASE WHEN l_returnflag IN ('R', 'N') THEN l_quantity END AS flag_r FROM lineitem""")
def concept_value(v):
    df = concepts.add_concept_values(v.t("lineitem"), F.array("l_returnflag"), "l_quantity", {k: CODE_LABELS[k] for k in ("flag_a", "flag_r")})
    return df.select("l_orderkey", "l_partkey", "flag_a", "flag_r")


@query("concept_value_string", """SELECT p_partkey, CASE WHEN (p_name LIKE '%red%' OR p_name LIKE '%blue%') AND (p_type LIKE '%ECONOMY%' OR p_type LIKE '%SMALL%') THEN p_retailprice END AS hit,
  CASE WHEN p_brand LIKE '%Brand#1%' THEN p_retailprice END AS brand FROM part""")
def concept_value_string(v):
    labels = {"hit": {"p_name": ["red", "blue"], "p_type": ["economy", "small"]}, "brand": {"p_brand": ["brand#1"]}}
    return concepts.add_string_values(v.t("part"), "p_retailprice", labels).select("p_partkey", "hit", "brand")


@query("concept_lab_mapping", """SELECT l_orderkey, l_partkey, l_shipdate::DATE AS day, codes FROM lineitem JOIN (SELECT l_shipmode, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS codes
  FROM (SELECT l_linenumber AS l_shipmode, l_returnflag FROM lineitem) GROUP BY 1) ON l_shipmode = l_linenumber""")
def concept_lab_mapping(v):
    df = v.t("lineitem").select("l_orderkey", "l_partkey", F.to_date("l_shipdate").alias("day"), F.concat(F.lit("lab "), F.col("l_linenumber").cast("string")).alias("result_name"),
                                F.when(F.col("l_quantity") > 25, F.concat(F.lit("X"), "l_returnflag")).alias("loinc_code"), F.col("l_returnflag").alias("default_loinc_code"))
    return concepts.add_lab_codes(df).select("l_orderkey", "l_partkey", "day", F.array_join("lab_codes", ";").alias("codes"))


@query("concept_flags_from_wide", sql("""SELECT pat_id, instance, bool_or(dx_id % 5 = 0) OR bool_or(dx_id % 7 = 0) AS one, bool_or(dx_id % 11 = 0) AS two, false AS three FROM dx GROUP BY 1, 2""", "dx"))
def concept_flags_from_wide(v):
    wide = v.dx.groupBy(*PERSON).agg(*[F.bool_or(F.col("dx_id") % k == 0).alias(f"SNOMED_{k}") for k in (5, 7, 11)])
    return concepts.flags_from_wide(wide, {"one": ["5", "7"], "two": ["11"], "three": ["999"]}).select(*PERSON, "one", "two", "three")


@query("concept_name_tabular", """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'C' || s_nationkey ELSE 'S' || s_suppkey END AS resolved_id FROM supplier""")
def concept_name_tabular(v):
    k = F.col("s_suppkey")
    hits = v.t("supplier").select("s_suppkey", F.when(k % 2 == 0, F.concat(F.lit("C"), "s_nationkey", F.lit("|C9"))).otherwise("").alias("primary"),
                                  F.concat(F.lit("S"), "s_suppkey", F.lit("|S0")).alias("secondary"))
    return concepts.resolved_names(hits, ["primary", "secondary"]).select("s_suppkey", "resolved_id")


# ---- cohorts -----------------------------------------------------------------------------------------------------


def infections(v):
    return cohorts.infection_in_episode(v.episode, v.positive)


def states(v):
    return cohorts.exposure_state(v.episode, cohorts.exposure_history(v.dose))


_STATE = dict(extra=state_sql("episode", "delivery"))


@query("cohort_test_status", sql("""SELECT pat_id, instance, count(*) AS n_tests, count(*) FILTER (result = 'positive') AS n_positive, count(*) FILTER (result = 'negative') AS n_negative,
  min(test_date) AS first_test, max(test_date) AS last_test, min(test_date) FILTER (result = 'positive') AS first_positive,
  CASE WHEN bool_or(result = 'positive') THEN '>= 1 positive' WHEN bool_or(result = 'negative') THEN '>= 1 negative (no positive)' ELSE 'inconclusive or unknown' END AS results_category
  FROM test GROUP BY 1, 2""", "test"))
def cohort_test_status(v):
    return cohorts.person_test_status(v.test)


@query("cohort_test_lists", sql("""SELECT pat_id, instance, row_number() OVER (PARTITION BY pat_id, instance ORDER BY test_date, result) AS position, test_date, result FROM test""", "test"))
def cohort_test_lists(v):
    """The time-ordered tests of every person as rows with a position."""
    joined = v.test.withColumn("entry", F.concat_ws("|", F.col("test_date").cast("string"), "result"))
    rows = agg.ordered_elements(joined, PERSON, "entry", ["test_date", "result"])
    parts = F.split("value", r"\|")
    return rows.select(*PERSON, F.col("position"), F.get(parts, F.lit(0)).cast("date").alias("test_date"), F.get(parts, F.lit(1)).alias("result"))


@query("cohort_maternity", sql("""SELECT pat_id, instance, episode_id, CAST(280 + date_diff('day', due, delivery) AS INTEGER) AS gestational_days,
  CASE WHEN 280 + date_diff('day', due, delivery) >= 259 THEN 'term' ELSE 'late_preterm' END AS preterm_category, delivery - CAST(280 + date_diff('day', due, delivery) AS INTEGER) AS lmp FROM episode""", "episode"))
def cohort_maternity(v):
    return cohorts.maternity(v.episode).select(*EPISODE, "gestational_days", "preterm_category", "lmp")


@query("cohort_maternity_children", sql("""SELECT pat_id, instance, episode_id, -(l_orderkey * 10 + l_linenumber) AS child_episode_id, child_type, l_quantity AS birth_weight,
  CASE cord WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS vessels, CAST(280 + date_diff('day', due, delivery) AS INTEGER) AS gestational_days
  FROM episode LEFT JOIN (SELECT l_orderkey, l_linenumber, l_quantity, l_linestatus, CASE l_returnflag WHEN 'A' THEN 'DELIVERY' ELSE 'DELIVERY SUMMARY' END AS child_type FROM lineitem WHERE l_returnflag <> 'N')
  ON l_orderkey = episode_id LEFT JOIN (SELECT l_orderkey AS o, l_linenumber AS n, l_linenumber % 2 AS cord FROM lineitem WHERE l_linestatus = 'F') ON o = l_orderkey AND n = l_linenumber""", "episode"))
def cohort_maternity_children(v):
    key = -(F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    kind = F.when(F.col("l_returnflag") == "A", "DELIVERY").when(F.col("l_returnflag") == "R", "DELIVERY SUMMARY").otherwise("OTHER")
    kids = v.line.select("pat_id", "instance", key.alias("episode_id"), kind.alias("type"), F.col("l_orderkey").alias("mother_episode_id"), F.col("l_quantity").alias("birth_weight"))
    mothers = v.episode.select(*EPISODE, "due", "delivery", F.lit("PREGNANCY").alias("type"))
    vessels = v.line.where("l_linestatus = 'F'").select(key.alias("child_episode_id"), "instance", F.when(F.col("l_linenumber") % 2 == 0, "2 Vessels").otherwise("3 Vessels").alias("cord"))
    df = cohorts.mothers_and_children(mothers.unionByName(kids, allowMissingColumns=True), vessels, ["birth_weight"])
    return df.select(*EPISODE, "child_episode_id", "child_type", "birth_weight", cat.cord_vessels(F.col("cord")).alias("vessels"), "gestational_days")


@query("cohort_positive_negative", sql("""SELECT e.pat_id, e.instance, e.episode_id, results_category FROM episode e JOIN person p USING (pat_id, instance) JOIN (
  SELECT pat_id, instance, min(test_date) AS first_test, CASE WHEN bool_or(result = 'positive') THEN '>= 1 positive' ELSE '>= 1 negative (no positive)' END AS results_category
  FROM test GROUP BY 1, 2 HAVING bool_or(result IN ('positive', 'negative'))) t USING (pat_id, instance)
  WHERE fetuses = 1 AND round(date_diff('day', birth_date, conception) / 365.25, 1) >= 18 AND round(date_diff('day', birth_date, conception) / 365.25, 1) < 45
  AND gest_days >= 140 AND delivery >= DATE '1996-01-01' AND delivery >= first_test""", "person", "episode", "test"))
def cohort_positive_negative(v):
    tests = cohorts.person_test_status(v.test).where("results_category <> 'inconclusive or unknown'").select(*PERSON, "first_test", "results_category")
    df = v.episode.join(v.person.select(*PERSON, "birth_date"), PERSON).join(tests, PERSON)
    keep = cohorts.eligible(age_years(F.col("birth_date"), F.col("conception")), F.col("gest_days"), F.col("fetuses"), F.col("delivery"), "1996-01-01")
    return df.where(keep & (F.col("delivery") >= F.col("first_test"))).select(*EPISODE, "results_category")


@query("cohort_infection_in_pregnancy", sql("""SELECT pat_id, instance, episode_id, infection_date, CAST(date_diff('day', conception, infection_date) AS INTEGER) AS days_from_conception,
  CASE WHEN date_diff('day', conception, infection_date) <= 90 THEN '1st trimester' WHEN date_diff('day', conception, infection_date) <= 181 THEN '2nd trimester' ELSE '3rd trimester' END AS infection_trimester,
  CASE WHEN prior_date IS NOT NULL THEN 1 ELSE 0 END AS prior_infection FROM infection WHERE infection_date IS NOT NULL""", "infection"))
def cohort_infection_in_pregnancy(v):
    return infections(v).where("infection_date is not null").select(*EPISODE, "infection_date", "days_from_conception", "infection_trimester", "prior_infection")


@query("cohort_prior_infection", sql("SELECT pat_id, instance, episode_id, prior_date FROM infection WHERE prior_date IS NOT NULL", "infection"))
def cohort_prior_infection(v):
    return infections(v).where("prior_infection = 1").select(*EPISODE, "prior_date")


@query("cohort_postnatal", sql("""SELECT e.pat_id, e.instance, e.episode_id, min(test_date) AS post_test_date, CAST(min(date_diff('day', delivery, test_date)) AS INTEGER) AS days_after_delivery
  FROM episode e JOIN positive p ON p.pat_id = e.pat_id AND p.instance = e.instance AND test_date > delivery AND test_date <= delivery + 42 GROUP BY 1, 2, 3""", "episode", "positive"))
def cohort_postnatal(v):
    return cohorts.postnatal_infection(v.episode, v.positive).select(*EPISODE, "post_test_date", "days_after_delivery")


@query("cohort_trimester_split", sql("""SELECT CASE WHEN d <= 91 THEN '1st trimester' WHEN d <= 189 THEN '2nd trimester' ELSE '3rd trimester' END AS infection_trimester, count(*) AS n FROM (
  SELECT date_diff('day', conception, infection_date) AS d FROM infection WHERE infection_date IS NOT NULL) GROUP BY 1""", "infection"))
def cohort_trimester_split(v):
    df = cohorts.infection_in_episode(v.episode, v.positive, cuts=cat.TRIMESTER_CUTS["infection"])
    return df.where("infection_date is not null").groupBy("infection_trimester").agg(F.count(F.lit(1)).alias("n"))


@query("cohort_exposure_state", sql("SELECT pat_id, instance, episode_id, state, full_date, full_product, booster_date FROM state", "episode", "history", **_STATE))
def cohort_exposure_state(v):
    return states(v).select(*EPISODE, "state", "full_date", "full_product", "booster_date")


@query("cohort_fully_vaccinated", sql("SELECT pat_id, instance, episode_id, full_date, full_product FROM state WHERE full_date IS NOT NULL", "episode", "history", **_STATE))
def cohort_fully_vaccinated(v):
    return states(v).where("full_date is not null").select(*EPISODE, "full_date", "full_product")


@query("cohort_breakthrough", sql("SELECT pat_id, instance, episode_id, full_date, infection_date FROM state WHERE full_date < infection_date AND prior_date IS NULL",
                                  "infection", "history", extra="infected AS (SELECT * FROM infection WHERE infection_date IS NOT NULL), " + state_sql("infected", "infection_date")))
def cohort_breakthrough(v):
    infected = infections(v).where("infection_date is not null")
    at_test = cohorts.exposure_state(infected, cohorts.exposure_history(v.dose), index="infection_date")
    return cohorts.breakthrough(at_test).select(*EPISODE, "full_date", "infection_date")


_AT_TEST = "infected AS (SELECT * FROM infection WHERE infection_date IS NOT NULL), " + state_sql("infected", "infection_date", "at_test") + ", " + state_sql("infection", "delivery")


@query("cohort_breakthrough_by_class", sql("""SELECT product_class, count(*) FILTER (hit) AS n_breakthrough, count(*) FILTER (NOT hit) AS n_full, round(count(*) FILTER (hit) / nullif(count(*) FILTER (NOT hit), 0), 8) AS rate FROM (
  SELECT string_split(full_product, ' ')[1] AS product_class, true AS hit FROM at_test WHERE full_date < infection_date AND prior_date IS NULL
  UNION ALL SELECT string_split(full_product, ' ')[1], false FROM state WHERE full_date IS NOT NULL) GROUP BY 1""", "infection", "history", extra=_AT_TEST))
def cohort_breakthrough_by_class(v):
    history, rows = cohorts.exposure_history(v.dose), infections(v)
    at_test = cohorts.exposure_state(rows.where("infection_date is not null"), history, index="infection_date")
    df = cohorts.breakthrough_rates(cohorts.breakthrough(at_test), cohorts.exposure_state(rows, history))
    return df.withColumn("rate", F.round("rate", 8))


@query("cohort_unvaccinated", sql("""SELECT pat_id, instance, episode_id, CASE WHEN prior_date IS NOT NULL THEN 1 ELSE 0 END AS prior_infection FROM state
  WHERE state IN ('never', 'later')""", "infection", "history", extra=state_sql("infection", "delivery")))
def cohort_unvaccinated(v):
    df = cohorts.exposure_state(infections(v), cohorts.exposure_history(v.dose))
    return df.where(cohorts.unexposed(F.col("state"))).select(*EPISODE, "prior_infection")


@query("cohort_boosted", sql("""SELECT pat_id, instance, episode_id, state, booster_date, state = 'full' AND full_date + 168 < delivery AS due_for_booster,
  booster_product LIKE '%BIVALENT%' AS bivalent_booster, booster_product NOT LIKE '%BIVALENT%' AND last_product LIKE '%BIVALENT%' AS bivalent_later
  FROM state WHERE state IN ('full', 'boosted') AND full_product NOT LIKE '%JANSSEN%'""", "episode", "history", **_STATE))
def cohort_boosted(v):
    df = states(v).where(F.col("state").isin("full", "boosted") & ~F.col("full_product").like("%JANSSEN%"))
    bi = F.col("booster_product").like("%BIVALENT%")
    return df.select(*EPISODE, "state", "booster_date", ((F.col("state") == "full") & (F.date_add("full_date", cohorts.BOOSTER_GAP_DAYS) < F.col("delivery"))).alias("due_for_booster"),
                     bi.alias("bivalent_booster"), (~bi & F.col("last_product").like("%BIVALENT%")).alias("bivalent_later"))


@query("cohort_one_dose", sql("SELECT pat_id, instance, episode_id, first_date FROM state WHERE first_date < delivery AND (second_date IS NULL OR second_date > delivery)", "episode", "history", **_STATE))
def cohort_one_dose(v):
    return cohorts.one_dose(states(v)).select(*EPISODE, "first_date")


@query("cohort_vaccination_maintained", sql("""SELECT pat_id, instance, episode_id FROM state e WHERE EXISTS (SELECT 1 FROM dose d WHERE d.pat_id = e.pat_id AND d.instance = e.instance
  AND d.dose_date < delivery AND delivery < d.dose_date + INTERVAL 6 MONTH) AND full_date IS NOT NULL""", "episode", "history", **_STATE))
def cohort_vaccination_maintained(v):
    return cohorts.maintained(states(v).where("full_date is not null")).select(*EPISODE)


@query("cohort_dose_timing", sql("""SELECT pattern, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM state WHERE state IN ('full', 'boosted')), 6) AS share FROM (SELECT CASE
  WHEN state = 'boosted' AND conception < first_date AND delivery > last_date THEN '3 during'
  WHEN state = 'boosted' AND conception > first_date AND conception < full_date AND delivery > last_date THEN '1 before, 2 during'
  WHEN state = 'boosted' AND conception > first_date AND conception > full_date AND delivery > last_date AND conception < last_date THEN '2 before, 1 during'
  WHEN state = 'boosted' AND conception > last_date THEN '3 before' WHEN state = 'full' AND conception > last_date THEN '2 before'
  WHEN state = 'full' AND conception > first_date AND conception < last_date AND delivery > last_date THEN '1 before, 1 during'
  WHEN state = 'full' AND conception < first_date AND delivery > full_date THEN '2 during' END AS pattern FROM state WHERE state IN ('full', 'boosted')) GROUP BY 1""", "episode", "history", **_STATE))
def cohort_dose_timing(v):
    df = cohorts.dose_timing(states(v).where(F.col("state").isin("full", "boosted"))).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return agg.proportions(df).select("pattern", "n", F.round(F.col("share") * 100, 6).alias("share"))


@query("cohort_era_split", sql("""SELECT era, count(*) AS n FROM (SELECT CASE WHEN d <= DATE '2021-05-29' THEN 'pre-delta' WHEN d >= DATE '2021-07-17' AND d <= DATE '2021-12-11' THEN 'delta'
  WHEN d >= DATE '2022-01-01' THEN 'omicron' END AS era FROM (SELECT infection_date + 8400 AS d FROM infection WHERE infection_date IS NOT NULL)) GROUP BY 1""", "infection"))
def cohort_era_split(v):
    day = F.date_add("infection_date", 8400)
    return infections(v).where("infection_date is not null").groupBy(cat.period(day).alias("era")).agg(F.count(F.lit(1)).alias("n"))


@query("cohort_immunity_lag", sql("""SELECT e.pat_id, e.instance, e.episode_id, CAST(date_diff('day', max(test_date), any_value(conception)) AS INTEGER) AS lag_days FROM episode e JOIN positive p
  ON p.pat_id = e.pat_id AND p.instance = e.instance AND test_date < conception GROUP BY 1, 2, 3""", "episode", "positive"))
def cohort_immunity_lag(v):
    return cohorts.immunity_lag(v.episode, v.positive).select(*EPISODE, "lag_days")


# ---- features ----------------------------------------------------------------------------------------------------


@query("feature_condition_status", sql("""SELECT e.pat_id, e.instance, e.episode_id, CAST(coalesce(max(CASE WHEN dx_id % 4 = 0 THEN 1 ELSE 0 END), 0) AS INTEGER) AS chronic,
  CAST(coalesce(max(CASE WHEN dx_id % 7 = 0 THEN 1 ELSE 0 END), 0) AS INTEGER) AS gestational FROM episode e LEFT JOIN dx ON dx.pat_id = e.pat_id AND dx.instance = e.instance
  AND dx_date <= delivery AND delivery <= dx_date + 280 GROUP BY 1, 2, 3""", "episode", "dx"))
def feature_condition_status(v):
    labels = {"chronic": F.col("dx_id") % 4 == 0, "gestational": F.col("dx_id") % 7 == 0}
    return features.condition_status(v.episode, v.dx, labels).select(*EPISODE, "chronic", "gestational")


@query("feature_social_history", sql("""SELECT pat_id, instance, coalesce(s, 0) AS smoker, coalesce(d, 0) AS drug_user FROM person LEFT JOIN (SELECT pat_id, instance,
  max(CASE WHEN priority = '1-URGENT' THEN 1 ELSE 0 END) AS s, max(CASE WHEN status = 'P' THEN 1 ELSE 0 END) AS d FROM episode GROUP BY ALL) USING (pat_id, instance)""", "person", "episode"))
def feature_social_history(v):
    history = v.episode.select(*PERSON, F.when(F.col("priority") == "1-URGENT", "Yes").otherwise("Quit").alias("tobacco"), F.when(F.col("status") == "P", "Yes").alias("drugs"))
    return features.social_history(v.person.select(*PERSON), history, {"smoker": "tobacco", "drug_user": "drugs"})


@query("feature_notes_window", sql(f"""SELECT e.pat_id, e.instance, e.episode_id, max(g) AS notation FROM episode e LEFT JOIN (SELECT pat_id, instance, contact_date, {GPAL} AS g FROM (
  SELECT text || ' ' || {NOTE} AS note, o_custkey AS pat_id, CAST(o_custkey % 3 + 1 AS INTEGER) AS instance, CAST(o_orderdate AS DATE) - CAST(doc_id % 300 AS INTEGER) AS contact_date FROM documents JOIN orders ON o_orderkey = doc_id)) n
  ON n.pat_id = e.pat_id AND n.instance = e.instance AND contact_date <= delivery + 3 AND contact_date > delivery + 3 - 280 GROUP BY 1, 2, 3""", "episode"))
def feature_notes_window(v):
    when = v.t("orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("pat_id"), v._instance("o_custkey"), F.to_date("o_orderdate").alias("d"))
    dated = notes(v).join(when, "doc_id").withColumn("contact_date", F.date_sub("d", (F.col("doc_id") % 300).cast("int")))
    return features.notes_notation(v.episode, dated).select(*EPISODE, "notation")


@query("feature_severity_daily", sql("""SELECT pat_id, instance, CAST(recorded_time AS DATE) AS day, CAST(max(CASE measure WHEN 'click' THEN 6 WHEN 'error' THEN 5 END) AS INTEGER) AS nominal_score,
  CASE WHEN bool_or(measure = 'error') THEN 'on' END AS crrt, sum(CASE WHEN measure = 'purchase' THEN 1 END)::BIGINT AS vasopressor_sum, CASE WHEN bool_or(measure = 'signup' AND value > 60) THEN 'Expired' END AS discharge_disposition,
  CASE WHEN bool_or(measure = 'signup' AND value > 60) THEN 8 WHEN bool_or(measure = 'click') AND (bool_or(measure = 'error') OR bool_or(measure = 'purchase')) THEN 7
  WHEN bool_or(measure = 'click') THEN 6 WHEN bool_or(measure = 'error') THEN 5 END AS score,
  max(CASE WHEN measure = 'view' THEN 1 END) AS diabetes FROM measure GROUP BY 1, 2, 3""", "measure"))
def feature_severity_daily(v):
    keys = [*PERSON, "day"]
    m = v.measure.withColumn("day", F.to_date("recorded_time"))
    device = m.where("measure in ('click', 'error')").groupBy(*keys).agg(
        F.max(F.when(F.col("measure") == "click", 6).otherwise(5)).alias("nominal_score"), F.max(F.when(F.col("measure") == "error", "on")).alias("crrt"),
        F.lit(None).cast("string").alias("ecmo"))
    meds = m.where("measure = 'purchase'").groupBy(*keys).agg(F.count(F.lit(1)).alias("vasopressor_sum"))
    admit = m.where("measure = 'signup'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_admissions"))
    disch = m.where("measure = 'signup'").groupBy(*keys).agg(F.max(F.when(F.col("value") > 60, "Expired")).alias("discharge_disposition"))
    dx = m.where("measure = 'view'").groupBy(*keys).agg(F.max(F.lit(1)).alias("diabetes"))
    df = features.daily_severity(device, meds, admit, disch, dx, keys)
    return df.select(*keys, "nominal_score", "crrt", "vasopressor_sum", "discharge_disposition", "score", "diabetes")


@query("score_adjusted", """SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 8 WHEN n = 6 AND (event_type = 'error' OR value > 50) THEN 7 ELSE n END AS score FROM (SELECT *,
  CAST(3 + event_id % 4 AS INTEGER) AS n FROM events)""")
def score_adjusted(v):
    e = v.t("events")
    return e.select("event_id", cat.adjusted_score((F.col("event_id") % 4 + 3).cast("int"), F.when(F.col("event_type") == "error", "CRRT on").otherwise(""), F.lit(None).cast("string"),
                                                   F.when(F.col("value") > 50, 1), F.when(F.col("user_id") % 10 == 0, "EXPIRED in hospital")).alias("score"))


_ENC = """enc AS (SELECT pat_id, instance, CASE measure WHEN 'click' THEN 2 WHEN 'error' THEN 3 WHEN 'purchase' THEN 1 ELSE 0 END AS device_level,
  CASE WHEN value > 60 THEN 3 WHEN value > 30 THEN 2 ELSE 1 END AS class_level, CASE WHEN value > 20 THEN CAST(event_id % 6 AS INTEGER) END AS score FROM measure)"""


def encounter_rows(v):
    level = F.when(F.col("measure") == "click", 2).when(F.col("measure") == "error", 3).when(F.col("measure") == "purchase", 1).otherwise(0)
    klass = F.when(F.col("value") > 60, 3).when(F.col("value") > 30, 2).otherwise(1)
    return v.measure.select(*PERSON, level.alias("device_level"), klass.alias("class_level"), F.when(F.col("value") > 20, (F.col("event_id") % 6).cast("int")).alias("score"))


@query("feature_encounter_summary", sql("""SELECT pat_id, instance, coalesce(max_device, 0) AS max_device, coalesce(max_class, 0) AS max_class, coalesce(n_encounters, 0) AS n_encounters, coalesce(score, 2) AS score
  FROM person LEFT JOIN (SELECT pat_id, instance, max(device_level) AS max_device, max(class_level) AS max_class, count(*) AS n_encounters, max(coalesce(score, 3)) AS score FROM enc GROUP BY 1, 2)
  USING (pat_id, instance)""", "person", "measure", extra=_ENC))
def feature_encounter_summary(v):
    return features.encounter_summary(v.person.select(*PERSON), encounter_rows(v), PERSON)


@query("feature_worst_encounter", sql("""SELECT pat_id, instance, coalesce(score, 2) AS score, duration, event_id FROM person LEFT JOIN (SELECT pat_id, instance, value AS duration, event_id,
  coalesce(CASE WHEN value > 20 THEN CAST(event_id % 6 AS INTEGER) END, 3) AS score FROM measure QUALIFY row_number() OVER (PARTITION BY pat_id, instance ORDER BY score DESC, duration DESC, event_id DESC) = 1)
  USING (pat_id, instance)""", "person", "measure"))
def feature_worst_encounter(v):
    rows = v.measure.select(*PERSON, F.when(F.col("value") > 20, (F.col("event_id") % 6).cast("int")).alias("score"), F.col("value").alias("duration"), "event_id")
    return features.worst_encounter(v.person.select(*PERSON), rows, PERSON, ["event_id"])


@query("score_three_level", sql("""SELECT severity, count(*) AS n FROM (SELECT CASE WHEN death_date IS NOT NULL OR coalesce(md, 0) >= 3 THEN 'Severe' WHEN coalesce(mc, 0) >= 3 OR coalesce(md, 0) = 1 THEN 'Moderate' ELSE 'Mild' END AS severity
  FROM person LEFT JOIN (SELECT pat_id, instance, CASE WHEN max(device_level) >= 3 THEN 3 ELSE CASE WHEN max(device_level) = 1 THEN 1 ELSE 0 END END AS md, max(class_level) AS mc FROM enc GROUP BY 1, 2) USING (pat_id, instance)) GROUP BY 1""",
                                "person", "measure", extra=_ENC))
def score_three_level(v):
    per = encounter_rows(v).groupBy(*PERSON).agg(F.max("device_level").alias("md"), F.max("class_level").alias("mc"))
    df = v.person.join(per, PERSON, "left")
    device = F.when(F.col("md") >= 3, 3).when(F.col("md") == 1, 1).otherwise(0)
    label = cat.severity(F.col("death_date").isNotNull(), device, F.col("mc"))
    return df.groupBy(label.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("feature_death_flag", sql("""SELECT pat_id, instance, index_date, CASE WHEN near THEN death_date END AS death_date, CASE WHEN near THEN 1 ELSE 0 END AS died FROM (SELECT *,
  coalesce(death_date >= index_date AND death_date < index_date + INTERVAL 3 MONTH, false) AS near FROM idx LEFT JOIN person USING (pat_id, instance))""", "person", "idx"))
def feature_death_flag(v):
    return features.death_flag(v.index, v.person)


@query("feature_medication_counts", sql("""SELECT i.pat_id, i.instance, index_date, count(DISTINCT short_name) FILTER (order_mode = 'Inpatient') AS n_inpatient,
  count(DISTINCT short_name) FILTER (order_mode = 'Outpatient') AS n_outpatient, count(DISTINCT short_name) AS n_total FROM idx i LEFT JOIN med m ON m.pat_id = i.pat_id
  AND m.instance = i.instance AND start_date >= index_date - 14 AND start_date < index_date + 56 GROUP BY 1, 2, 3""", "idx", "med"))
def feature_medication_counts(v):
    return features.medication_counts(v.index, v.med)


@query("feature_insurance", sql("""SELECT pat_id, instance, split_part(min(CASE c WHEN 'Medicaid' THEN '1_Medicaid' WHEN 'Medicare' THEN '2_Medicare' WHEN 'Commercial' THEN '3_Commercial'
  WHEN 'Self-pay' THEN '4_Uninsured-Self-Pay' WHEN 'Other' THEN '6_Other' END), '_', 2) AS insurance FROM (SELECT *, CASE WHEN payor IS NULL THEN CASE WHEN financial_class = 'OTHER GOVERNMENT' THEN 'Other' ELSE financial_class END
  WHEN lower(payor) LIKE '%medicare%' THEN 'Medicare' WHEN lower(payor) LIKE '%medi-cal%' THEN 'Medicaid' WHEN lower(payor) LIKE '%victims%' THEN 'Other' ELSE 'Commercial' END AS c FROM chain) GROUP BY 1, 2""",
                                "person", extra=CHAIN))
def feature_insurance(v):
    return features.insurance(joins.coverage_chain(v.person.select(*PERSON), *coverage_tables(v)))


@query("matched_rows_extract", sql("SELECT pat_id, instance, segment, balance FROM person WHERE (pat_id, instance) IN (SELECT pat_id, instance FROM idx)", "person", "idx"))
def matched_rows_extract(v):
    return matching.keep_matched(v.person, v.index, PERSON).select(*PERSON, "segment", "balance")
