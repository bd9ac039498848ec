"""String, date, category, number and array functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions import arrays, categories as cat, dates, numbers, strings
from cohortspark.operators import cohorts, features
from cohortspark.operators.cohorts import PERSON
from cohortspark.plans.registry import query
from cohortspark.sources.views import DEVICE_TEXTS, sql, state_sql

E = ["episode_id"]


@query("str_clean", r"""SELECT doc_id, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, regexp_replace(lower(regexp_replace(regexp_replace(text, '[.*:()-]', '', 'g'),
  '^[ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+$', '', 'g')), ' +', ' ', 'g') AS c FROM documents)""")
def str_clean(v):
    df = v.t("documents").select("doc_id", strings.clean_text(F.col("text")).alias("c"))
    return df.select("doc_id", F.length("c").cast("bigint").alias("n"), F.md5("c").alias("digest"))


@query("str_zero_pad", "SELECT o_orderkey, right('000' || o_orderkey, 3) AS short, right('00000000' || o_orderkey, 8) AS long FROM orders")
def str_zero_pad(v):
    return v.t("orders").select("o_orderkey", strings.pad_front(F.col("o_orderkey"), 3).alias("short"), strings.pad_front(F.col("o_orderkey"), 8).alias("long"))


@query("str_split_code", "SELECT s_suppkey, 'NAT' AS vocabulary, CAST(s_nationkey AS VARCHAR) AS code FROM supplier")
def str_split_code(v):
    return v.t("supplier").select("s_suppkey", strings.split_code(F.concat(F.lit("NAT#"), "s_nationkey")).alias("c")).select("s_suppkey", "c.*")


@query("str_strip_prefix", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' || o_orderstatus WHEN o_orderkey % 3 = 1 THEN o_orderstatus ELSE o_orderpriority END AS code FROM orders")
def str_strip_prefix(v):
    k = F.col("o_orderkey")
    code = F.when(k % 3 == 0, F.concat(F.lit("XX"), "o_orderstatus")).when(k % 3 == 1, F.concat(F.lit("X"), "o_orderstatus"))
    return v.t("orders").select("o_orderkey", strings.lab_code(code, F.col("o_orderpriority")).alias("code"))


@query("str_first_of_pipe", "SELECT o_orderkey, o_orderpriority AS first FROM orders")
def str_first_of_pipe(v):
    return v.t("orders").select("o_orderkey", strings.first_of_pipe(F.concat_ws("|", "o_orderpriority", "o_orderstatus")).alias("first"))


NOTE = """CASE doc_id % 5 WHEN 0 THEN 'G' || doc_id % 10 || 'P' || lpad(CAST(doc_id * 7 % 10000 AS VARCHAR), 4, '0') WHEN 1 THEN 'G' || doc_id % 10 || ' P' || doc_id % 4 || ' T1 P' || doc_id % 3 || ' A0'
  WHEN 2 THEN 'G' || doc_id % 10 || 'P' || doc_id % 6 WHEN 3 THEN 'G' || doc_id % 10 || ' P' || doc_id % 6 ELSE '' END"""


def notes(v):
    """Documents as notes: each whole text with an obstetric notation appended."""
    k = F.col("doc_id")
    d = lambda m: (k % m).cast("string")
    tail = (F.when(k % 5 == 0, F.concat(F.lit("G"), d(10), F.lit("P"), F.lpad((k * 7 % 10000).cast("string"), 4, "0")))
            .when(k % 5 == 1, F.concat(F.lit("G"), d(10), F.lit(" P"), d(4), F.lit(" T1 P"), d(3), F.lit(" A0")))
            .when(k % 5 == 2, F.concat(F.lit("G"), d(10), F.lit("P"), d(6))).when(k % 5 == 3, F.concat(F.lit("G"), d(10), F.lit(" P"), d(6))).otherwise(""))
    return v.t("documents").select("doc_id", F.concat("text", F.lit(" "), tail).alias("text"))


GPAL = r"""coalesce(nullif(regexp_extract(note, 'G\d{1}P\d{4}'), ''), nullif(regexp_extract(note, 'G\d{1}\s+P\d{1}\s+T\d{1}\s+P\d{1}\s+A\d{1}'), ''),
  nullif(regexp_extract(note, 'G\d{1}P\d{1}'), ''), nullif(regexp_extract(note, 'G\d{1}\s{1}P\d{1}'), ''))"""


@query("str_regex_first", rf"""WITH n AS (SELECT doc_id, text || ' ' || {NOTE} AS note FROM documents), g AS (SELECT doc_id, {GPAL} AS notation FROM n)
  SELECT doc_id, notation, nullif(regexp_extract(notation, 'G(\d)', 1), '') AS gravidity, nullif(regexp_extract(notation, 'P(\d)', 1), '') AS parity,
  CASE WHEN regexp_matches(notation, 'P\d{{4}}') THEN regexp_extract(notation, 'P\d(\d)\d\d', 1)
  WHEN len(regexp_extract_all(notation, 'P\d')) = 2 THEN regexp_extract_all(notation, 'P(\d)', 1)[2] END AS preterm FROM g""")
def str_regex_first(v):
    df = notes(v).select("doc_id", strings.obstetric_notation(F.col("text")).alias("notation"))
    g = F.col("notation")
    return df.select("doc_id", "notation", strings.notation_gravidity(g).alias("gravidity"), strings.notation_parity(g).alias("parity"),
                     strings.notation_preterm(g).alias("preterm"))


RESULT_TEXTS = {"A": " Not Detected. ", "N": "SEE  COMMENT", "R": "*Presumptive Pos*"}


@query("str_result_class", """SELECT l_returnflag, l_linestatus, CASE WHEN l_linestatus = 'F' THEN 'unknown' WHEN l_returnflag = 'A' THEN 'negative' WHEN l_returnflag = 'R' THEN 'positive'
  ELSE 'see report or comment' END AS result, count(*) AS n FROM lineitem GROUP BY ALL""")
def str_result_class(v):
    text = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("lot "), F.col("l_linenumber").cast("string"))).otherwise(strings.lookup(F.col("l_returnflag"), RESULT_TEXTS))
    return v.t("lineitem").groupBy("l_returnflag", "l_linestatus", strings.result_class(text).alias("result")).agg(F.count(F.lit(1)).alias("n"))


@query("str_contains_class", "SELECT event_id, CASE event_type WHEN 'error' THEN 6 WHEN 'click' THEN 5 WHEN 'purchase' THEN 4 WHEN 'view' THEN 3 END AS level FROM events")
def str_contains_class(v):
    return v.t("events").select("event_id", strings.support_level(strings.lookup(F.col("event_type"), DEVICE_TEXTS)).alias("level"))


PAYERS = {0: "Medicare A", 1: "State MEDICAID", 2: "Uninsured fund", 3: "Workers Compensation", 4: "Patient responsibility", 5: "Blue Plan"}


@query("str_payor_class", """WITH p AS (SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'Medicare' WHEN 1 THEN 'Medicaid' WHEN 2 THEN 'Self-pay' WHEN 3 THEN 'Other' WHEN 4 THEN 'Self-pay'
  WHEN 5 THEN 'Commercial' WHEN 6 THEN 'Other' ELSE 'PREMERA' END AS payer_class FROM customer)
  SELECT *, CASE payer_class WHEN 'Medicare' THEN '2_Medicare' WHEN 'Medicaid' THEN '1_Medicaid' WHEN 'Self-pay' THEN '4_Uninsured-Self-Pay' WHEN 'Other' THEN '6_Other'
  ELSE '3_Commercial' END AS coverage FROM p""")
def str_payor_class(v):
    k = (F.col("c_custkey") % 8).cast("int")
    klass = F.when(k == 6, "OTHER GOVERNMENT").otherwise("PREMERA")
    df = v.t("customer").select("c_custkey", strings.payer_class(strings.lookup(k, PAYERS), klass).alias("payer_class"))
    return df.withColumn("coverage", strings.coverage_group(F.col("payer_class")))


@query("str_format_label", """SELECT p_partkey, upper(left(a, 1)) || lower(substr(a, 2)) || ' ' || upper(left(b, 1)) || lower(substr(b, 2)) AS label FROM (SELECT p_partkey,
  split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)""")
def str_format_label(v):
    return v.t("part").select("p_partkey", strings.format_label(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("label"))


# ---- dates -------------------------------------------------------------------------------------------------------


@query("date_age_years", sql("SELECT episode_id, round(date_diff('day', birth_date, delivery) / 365.25, 1) AS age FROM episode JOIN person USING (pat_id, instance)", "episode", "person"))
def date_age_years(v):
    return v.episode.join(v.person.select(*PERSON, "birth_date"), PERSON).select("episode_id", dates.age_years(F.col("birth_date"), F.col("delivery")).alias("age"))


@query("date_gestation", sql("SELECT episode_id, CAST(280 + date_diff('day', due, delivery) AS INTEGER) AS days, delivery - CAST(280 + date_diff('day', due, delivery) AS INTEGER) AS lmp FROM episode", "episode"))
def date_gestation(v):
    df = v.episode.select("episode_id", "delivery", dates.gestation_days(F.col("delivery"), F.col("due")).alias("days"))
    return df.select("episode_id", "days", dates.pregnancy_start(F.col("delivery"), F.col("days")).alias("lmp"))


@query("date_duration_days", """SELECT event_id, round((CAST(floor(epoch(ts)) AS BIGINT) - epoch(TIMESTAMP '2024-01-01 00:00:00')) / 86400 + 1e-9, 2) AS days FROM events""")
def date_duration_days(v):
    return v.t("events").select("event_id", dates.duration_days(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).alias("days"))


@query("date_time_index", """SELECT event_id, strftime(ts, '%Y') AS year, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day,
  strftime(ts, '%Y-%m-%d-') || lpad(CAST(hour(ts) // 12 AS VARCHAR), 2, '0') AS half, strftime(ts, '%Y-%m-%d-') || lpad(CAST(hour(ts) // 6 AS VARCHAR), 2, '0') AS quarter,
  strftime(ts, '%Y-%m-%d-%H') AS hour FROM events""")
def date_time_index(v):
    names = {"year": "year", "month": "month", "day": "day", "12-hour": "half", "6-hour": "quarter", "hour": "hour"}
    return v.t("events").select("event_id", *[dates.time_index(F.col("ts"), k).alias(n) for k, n in names.items()])


@query("time_index_defined", sql("""SELECT episode_id, (CASE WHEN d >= -280 THEN 1 ELSE 0 END) + (CASE WHEN d >= 0 THEN 1 ELSE 0 END) + (CASE WHEN d >= 42 THEN 1 ELSE 0 END) AS period
  FROM (SELECT episode_id, date_diff('day', DATE '1998-06-01', delivery) AS d FROM episode)""", "episode"))
def time_index_defined(v):
    return v.episode.select("episode_id", dates.defined_index(F.col("delivery"), F.to_date(F.lit("1998-06-01")), [0, 42, -280]).alias("period"))


@query("date_gestational_day", sql("SELECT episode_id, CAST(gest_days - date_diff('day', due, delivery) AS INTEGER) AS day FROM episode", "episode"))
def date_gestational_day(v):
    return v.episode.select("episode_id", dates.gestational_day(F.col("gest_days"), F.col("delivery"), F.col("due")).alias("day"))


@query("date_days_from_epoch", sql("SELECT episode_id, CAST(date_diff('day', DATE '1997-03-05', conception) AS INTEGER) AS days FROM episode", "episode"))
def date_days_from_epoch(v):
    return v.episode.select("episode_id", dates.days_from("1997-03-05", F.col("conception")).alias("days"))


@query("date_fallback_delivery", sql("""SELECT episode_id, CASE WHEN episode_id % 4 > 1 THEN delivery WHEN episode_id % 4 = 1 THEN due
  ELSE conception + CASE WHEN gest_days > 200 THEN gest_days ELSE 280 END END AS day FROM episode""", "episode"))
def date_fallback_delivery(v):
    k = F.col("episode_id") % 4
    day = dates.delivery_or_estimate(F.when(k > 1, F.col("delivery")), F.when(k == 1, F.col("due")), F.col("conception"),
                                     F.when(F.col("gest_days") > 200, F.col("gest_days")).otherwise(0))
    return v.episode.select("episode_id", day.alias("day"))


@query("date_in_window", sql("""SELECT episode_id, conception < due AND due < delivery AS during, due < conception AS before FROM episode""", "episode"))
def date_in_window(v):
    c, d, x = F.col("conception"), F.col("delivery"), F.col("due")
    return v.episode.select("episode_id", dates.strictly_between(x, c, d).alias("during"), dates.before(x, c).alias("before"))


# ---- categories --------------------------------------------------------------------------------------------------


def _tri(a, b):
    return f"CASE WHEN g <= {a} THEN '1st trimester' WHEN g <= {b} THEN '2nd trimester' ELSE '3rd trimester' END"


@query("cat_trimester", f"SELECT o_orderkey, {_tri(91, 189)} AS infection, {_tri(90, 181)} AS exposure, {_tri(84, 182)} AS breakdown FROM (SELECT o_orderkey, o_orderkey % 301 AS g FROM orders)")
def cat_trimester(v):
    g = F.col("o_orderkey") % 301
    return v.t("orders").select("o_orderkey", *[cat.trimester(g, c).alias(n) for n, c in cat.TRIMESTER_CUTS.items()])


@query("cat_preterm", sql("""SELECT episode_id, CASE WHEN gest_days >= 259 THEN 'term' WHEN gest_days >= 238 THEN 'late_preterm' WHEN gest_days >= 224 THEN 'moderate_preterm'
  WHEN gest_days >= 196 THEN 'very_preterm' ELSE 'extremely_preterm' END AS class FROM episode""", "episode"))
def cat_preterm(v):
    return v.episode.select("episode_id", cat.preterm(F.col("gest_days")).alias("class"))


@query("cat_ruca", """SELECT o_orderkey, CASE WHEN r < 4 THEN 'Metropolitan' WHEN r < 7 THEN 'Micropolitan' WHEN r < 10 THEN 'SmallTown' WHEN r < 99 THEN 'Rural' WHEN r = 99 THEN 'NotCoded' END AS class
  FROM (SELECT o_orderkey, o_orderkey % 103 AS r FROM orders)""")
def cat_ruca(v):
    return v.t("orders").select("o_orderkey", cat.ruca(F.col("o_orderkey") % 103).alias("class"))


@query("cat_bands", """SELECT o_orderkey, CASE WHEN a < 25 THEN 0 WHEN a < 30 THEN 1 WHEN a < 35 THEN 2 WHEN a < 40 THEN 3 WHEN a < 45 THEN 4 ELSE -1 END AS age,
  CASE WHEN b >= 15 AND b < 18.5 THEN 0 WHEN b < 25 THEN 1 WHEN b < 30 THEN 2 WHEN b < 35 THEN 3 WHEN b < 40 THEN 4 ELSE -1 END AS bmi,
  CASE WHEN p <= 1 THEN 0 WHEN p < 5 THEN 1 ELSE 2 END AS parity, CASE WHEN p <= 1 THEN 0 WHEN p < 6 THEN 1 ELSE 2 END AS gravidity,
  CASE o_orderkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Unknown' END AS sex,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END AS method, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END AS vessels,
  CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS vaccine FROM (SELECT *, 18 + o_orderkey % 31 AS a, 10 + o_orderkey % 34 AS b, o_orderkey % 9 AS p FROM orders)""")
def cat_bands(v):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    pick = lambda f, o, p: strings.lookup(s, {"F": f, "O": o, "P": p})
    return v.t("orders").select(
        "o_orderkey", cat.age_ordinal(k % 31 + 18).alias("age"), cat.bmi_ordinal((k % 34 + 10).cast("double")).alias("bmi"),
        cat.parity_ordinal(k % 9).alias("parity"), cat.gravidity_ordinal(k % 9).alias("gravidity"),
        cat.fetal_sex(F.when(k % 3 == 0, "Male").when(k % 3 == 1, "Female").otherwise("Other")).alias("sex"),
        cat.delivery_method(pick("Vaginal, Breech", "C-Section, Classical", "Unlisted")).alias("method"),
        cat.cord_vessels(pick("2 Vessels", "3 Vessels", "Unknown")).alias("vessels"),
        cat.vaccine_type(pick("COVID-19 (MODERNA)", "COVID-19 (PFIZER)", "OTHER")).alias("vaccine"))


@query("cat_status_at_conception", sql("""SELECT episode_id, CASE WHEN full_date < conception THEN 2 WHEN first_date < conception THEN 1 ELSE 0 END AS status FROM state
  WHERE full_date IS NOT NULL""", "episode", "history", extra=state_sql("episode", "delivery")))
def cat_status_at_conception(v):
    df = cohorts.exposure_state(v.episode, cohorts.exposure_history(v.dose)).where("full_date is not null")
    return df.select("episode_id", cat.status_at_conception(F.col("first_date"), F.col("full_date"), F.col("conception")).alias("status"))


RACE_ANSWERS = {"1-URGENT": "White", "2-HIGH": "Asian", "3-MEDIUM": "Other", "4-NOT SPECIFIED": "Declined", "5-LOW": "White or Caucasian"}


@query("cat_race_consolidate", """WITH a AS (SELECT o_custkey, list(DISTINCT CASE o_orderpriority WHEN '1-URGENT' THEN 'White or Caucasian' WHEN '2-HIGH' THEN 'Asian' WHEN '3-MEDIUM' THEN 'Other'
  WHEN '5-LOW' THEN 'White or Caucasian' END) FILTER (o_orderpriority <> '4-NOT SPECIFIED') AS k FROM orders GROUP BY 1),
  b AS (SELECT o_custkey, coalesce(k, []) AS k, CASE WHEN len(k) > 1 THEN list_filter(k, lambda x: x <> 'Other') ELSE k END AS s FROM a)
  SELECT o_custkey, CASE WHEN len(k) = 0 THEN 'Unknown' WHEN len(s) = 1 THEN s[1] ELSE 'Multiracial' END AS race FROM b""")
def cat_race_consolidate(v):
    answers = v.t("orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    named = answers.select("o_custkey", F.transform("p", lambda x: strings.lookup(x, RACE_ANSWERS)).alias("race"))
    return named.select("o_custkey", cat.race(F.col("race")).alias("race"))


@query("cat_ethnicity", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Hispanic or Latino' WHEN 1 THEN 'Not Hispanic or Latino' WHEN 2 THEN 'Not Hispanic or Latino' ELSE 'Unknown' END AS ethnicity,
  CASE WHEN c_custkey % 5 = 0 THEN 'Hispanic or Latino' WHEN c_custkey % 5 = 4 THEN 'Unknown' ELSE 'Not Hispanic or Latino' END AS as_published FROM customer""")
def cat_ethnicity(v):
    text = strings.lookup((F.col("c_custkey") % 5).cast("int"), {0: "Hispanic or Latino", 1: "Samoan", 2: "Hmong", 3: "Patient Refused"})
    return v.t("customer").select("c_custkey", cat.ethnicity(text).alias("ethnicity"), cat.ethnicity(text, literal=True).alias("as_published"))


@query("cat_preterm_history", sql("SELECT episode_id, CASE WHEN episode_id % 3 = 0 OR (episode_id % 3 = 1 AND gest_days < 259) THEN 0 ELSE 1 END AS history FROM episode", "episode"))
def cat_preterm_history(v):
    return v.episode.select("episode_id", cat.preterm_history((F.col("episode_id") % 3).cast("string"), F.col("gest_days")).alias("history"))


@query("cat_one_hot", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS is_building, CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS is_machinery,
  CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'AUTOMOBILE' THEN 1 ELSE -1 END AS code FROM customer""")
def cat_one_hot(v):
    s = F.col("c_mktsegment")
    return v.t("customer").select("c_custkey", cat.indicator(s, "BUILDING").alias("is_building"), cat.indicator(s, "MACHINERY").alias("is_machinery"),
                                  strings.lookup(s, {"BUILDING": 0, "AUTOMOBILE": 1}, F.lit(-1)).alias("code"))


@query("cat_variant", """SELECT d AS day, CASE WHEN d >= DATE '2022-07-02' THEN 'Omicron BA.5' WHEN d >= DATE '2022-05-28' THEN 'Omicron BA.2.12.1' WHEN d >= DATE '2022-03-26' THEN 'Omicron BA.2'
  WHEN d >= DATE '2021-12-25' THEN 'Omicron' WHEN d >= DATE '2021-07-03' THEN 'Delta' WHEN d >= DATE '2021-04-24' THEN 'Alpha' ELSE 'Wild-type' END AS variant, count(*) AS n
  FROM (SELECT CAST(l_shipdate AS DATE) + 7850 AS d FROM lineitem) GROUP BY ALL""")
def cat_variant(v):
    day = F.date_add(F.to_date("l_shipdate"), 7850).alias("day")
    return v.t("lineitem").groupBy(day).agg(F.count(F.lit(1)).alias("n")).select("day", cat.variant(F.col("day")).alias("variant"), "n")


# ---- numbers -----------------------------------------------------------------------------------------------------


@query("num_clean_range", """SELECT c_custkey, coalesce(CASE WHEN b >= 12 AND b < 100 THEN b END, 25.0 + c_nationkey) AS bmi, CASE WHEN q >= 0 AND q <= 1 THEN q END AS svi
  FROM (SELECT c_custkey, c_nationkey, round(c_acctbal / 80, 1) AS b, c_acctbal / 8000 AS q FROM customer)""")
def num_clean_range(v):
    bmi = numbers.clean_bmi(F.col("c_acctbal") / 80)
    return v.t("customer").select("c_custkey", F.coalesce(bmi, F.lit(25.0) + F.col("c_nationkey")).alias("bmi"), numbers.quintile_value(F.col("c_acctbal") / 8000).alias("svi"))


@query("num_growth_percentile", sql("""SELECT episode_id, round(CASE WHEN n_above = 0 THEN 95.0 WHEN n_above = 5 THEN 5.0 ELSE plo + (phi - plo) * (w - glo) / (ghi - glo) END, 6) AS growth_percentile FROM (
  SELECT episode_id, w, count(*) FILTER (w < g) AS n_above, min(p) FILTER (w < g) AS phi, min(g) FILTER (w < g) AS ghi, max(p) FILTER (w >= g) AS plo, max(g) FILTER (w >= g) AS glo FROM (
    SELECT e.episode_id, a.percentile AS p, a.grams + (e.age - e.wk) * (b.grams - a.grams) AS g, e.w FROM (
      SELECT episode_id, gest_days / 7.0 AS age, least(greatest(CAST(floor(gest_days / 7.0) AS INTEGER), 14), 39) AS wk, CASE WHEN weight_oz < 500 THEN weight_oz * 28.3495 ELSE weight_oz END AS w,
      CASE WHEN sex = 'Male' THEN 'male' WHEN sex = 'Female' THEN 'female' ELSE 'unknown' END AS sx FROM episode) e
    JOIN chart a ON a.sex = e.sx AND a.week = e.wk JOIN chart b ON b.sex = a.sex AND b.percentile = a.percentile AND b.week = e.wk + 1) GROUP BY ALL)""", "episode", "chart"))
def num_growth_percentile(v):
    df = features.growth_percentile(v.episode, v.chart, numbers.grams(F.col("weight_oz")), F.col("gest_days"), F.col("sex"), E)
    return df.withColumn("growth_percentile", F.round("growth_percentile", 6))


@query("num_log_trend", """SELECT o_orderpriority AS curve, round(regr_slope(o_totalprice, ln(140 + o_orderkey % 161)), 4) AS slope, round(regr_intercept(o_totalprice, ln(140 + o_orderkey % 161)), 4) AS intercept
  FROM orders GROUP BY 1""")
def num_log_trend(v):
    curves = v.episode.select(F.col("priority").alias("curve"), F.col("price").alias("grams"), F.col("gest_days").alias("week"))
    df = features.log_trend(curves, ["curve"])
    return df.select("curve", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


# ---- arrays ------------------------------------------------------------------------------------------------------


def dose_lists(v):
    """Ordered dose days of a person: at most one entry per calendar day."""
    return cohorts.exposure_history(v.dose)


@query("arr_element_safe", sql("SELECT pat_id, instance, second_date AS second, third_date AS third FROM history", "history"))
def arr_element_safe(v):
    days = F.transform("doses", lambda x: x["dose_date"])
    return dose_lists(v).select(*PERSON, arrays.nth_distinct(days, 2).alias("second"), arrays.nth_distinct(days, 3).alias("third"))


@query("arr_first_match", sql("""SELECT p.pat_id, p.instance, min(test_date) FILTER (result = 'positive' AND test_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31') AS first_hit
  FROM test p GROUP BY ALL""", "test"))
def arr_first_match(v):
    """Tests of a person reduced to one per day and result, then searched as parallel lists (bounded by calendar days)."""
    days = v.test.select(*PERSON, "test_date", "result").distinct()
    lists = days.groupBy(*PERSON).agg(F.array_sort(F.collect_list(F.struct("test_date", "result"))).alias("t"))
    hit = arrays.first_match(F.transform("t", lambda x: x["test_date"]), F.transform("t", lambda x: x["result"]), "positive",
                             F.to_date(F.lit("1997-01-01")), F.to_date(F.lit("1999-12-31")))
    return lists.select(*PERSON, hit.alias("first_hit"))


@query("arr_exists_window", sql("""SELECT episode_id, EXISTS (SELECT 1 FROM dose d WHERE d.pat_id = e.pat_id AND d.instance = e.instance AND d.dose_date < delivery
  AND delivery < d.dose_date + INTERVAL 6 MONTH) AS covered FROM episode e""", "episode", "dose"))
def arr_exists_window(v):
    df = v.episode.join(dose_lists(v).select(*PERSON, "doses"), PERSON, "left")
    days = F.transform("doses", lambda x: x["dose_date"])
    return df.select("episode_id", arrays.any_covers(days, F.col("delivery")).alias("covered"))


@query("arr_zip_explode", sql("SELECT pat_id, instance, dose_date, product FROM dose_day", "history"))
def arr_zip_explode(v):
    return dose_lists(v).select(*PERSON, F.inline("doses"))


@query("arr_membership", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') OR o_orderpriority = '1-URGENT' THEN o_totalprice END AS value FROM orders")
def arr_membership(v):
    hit = arrays.overlaps(F.array("o_orderstatus", "o_orderpriority"), ["F", "P", "1-URGENT"])
    return v.t("orders").select("o_orderkey", F.when(hit, F.col("o_totalprice")).alias("value"))


@query("arr_any_category", sql("""SELECT pat_id, instance, CASE WHEN bool_or(result = 'positive') THEN '>= 1 positive' WHEN bool_or(result = 'negative') THEN '>= 1 negative (no positive)'
  ELSE 'inconclusive or unknown' END AS category FROM test GROUP BY ALL""", "test"))
def arr_any_category(v):
    sets = v.test.groupBy(*PERSON).agg(F.collect_set("result").alias("r"))
    return sets.select(*PERSON, arrays.results_category(F.col("r")).alias("category"))


@query("arr_size_distinct", sql("SELECT pat_id, instance, n_doses FROM history WHERE n_doses = 1", "history"))
def arr_size_distinct(v):
    df = dose_lists(v).withColumn("n", arrays.count_distinct_elements(F.transform("doses", lambda x: x["dose_date"])))
    return df.where("n = 1").select(*PERSON, F.col("n").alias("n_doses"))


@query("json_meta", """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{"k":' || json_extract(props, '$.k') || ',"type":"' || event_type || '"}' AS meta FROM events""")
def json_meta(v):
    df = v.t("events").select("event_id", "event_type", F.from_json("props", "k int").alias("p"))
    return df.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("type"))).alias("meta"))
