"""Record views over the test tables, in Spark and (for the checks) as SQL common table expressions.

A customer is a person, an order an episode, a line item a dose, a test, a diagnosis or a medication order, an
event a measurement. ``instance`` is derived from the person key, so no view needs a join to get it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.sources.records import Records
from cohortspark.sources.registry import mapping_from_text

# The measure mapping used with the event types of the test tables.
MEASURE_TEXT = """flo_meas_id\tinstance\tcode\tcode_system\tdescription
click\t1\t426854004\tSNOMED\thigh flow oxygen
click\t2\t426854004\tSNOMED\thigh flow oxygen
click\t3\t426854004\tSNOMED\thigh flow oxygen
error\t1\t706172005\tSNOMED\tventilator
error\t2\t706172005\tSNOMED\tventilator
view\t1\t271649006\tSNOMED\tsystolic pressure
view\t2\t271649006\tSNOMED\tsystolic pressure
view\t3\t271649006\tSNOMED\tsystolic pressure
"""
CODE_LABELS = {"oxygen_device": ["426854004", "706172005"], "blood_pressure": ["271649006"], "flag_a": ["A"], "flag_r": ["R", "N"]}

# Device text recorded for an event type.
DEVICE_TEXTS = {"click": "HFNC 40L", "error": "Transport Vent", "purchase": "Nasal Cannula", "view": "Room air", "signup": "other"}


class Views:
    """The views of one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @staticmethod
    def _instance(col: str):
        return (F.col(col) % 3 + 1).cast("int").alias("instance")

    @cached_property
    def person(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.t("customer").select(
            k.alias("pat_id"), self._instance("c_custkey"),
            F.date_add(F.to_date(F.lit("1955-01-01")), (k * 37 % 10000).cast("int")).alias("birth_date"),
            F.when(k % 17 == 0, F.date_add(F.to_date(F.lit("1996-01-01")), (k * 13 % 2000).cast("int"))).alias("death_date"),
            F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"),
            F.col("c_nationkey").alias("nation"))

    @cached_property
    def episode(self) -> DataFrame:
        k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
        days = (k % 161 + 140).cast("int")
        return self.t("orders").select(
            F.col("o_custkey").alias("pat_id"), self._instance("o_custkey"), k.alias("episode_id"), day.alias("delivery"),
            days.alias("gest_days"), F.date_sub(day, days).alias("conception"),
            F.date_add(day, (k % 29 - 14).cast("int")).alias("due"), (k % 120 + 40).cast("double").alias("weight_oz"),
            F.when(k % 3 == 0, "Male").when(k % 3 == 1, "Female").otherwise("Other").alias("sex"),
            F.when(k % 50 == 0, 2).otherwise(1).alias("fetuses"), F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))

    @cached_property
    def line(self) -> DataFrame:
        own = self.t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("pat_id"))
        return self.t("lineitem").join(own, "l_orderkey").withColumn("instance", self._instance("pat_id")).withColumn(
            "day", F.to_date("l_shipdate"))

    @cached_property
    def dose(self) -> DataFrame:
        name = F.when(F.col("l_returnflag") == "A", "MODERNA").when(F.col("l_returnflag") == "R", "PFIZER").otherwise("JANSSEN")
        name = F.concat(name, F.when(F.col("l_tax") > 0.065, " BIVALENT").otherwise(""))
        return self.line.where((F.col("l_linestatus") == "F") & (F.col("l_quantity") <= 3)).select(
            "pat_id", "instance", F.col("day").alias("dose_date"), name.alias("product")).distinct()

    @cached_property
    def test(self) -> DataFrame:
        result = F.when(F.col("l_returnflag") == "R", "positive").when(F.col("l_returnflag") == "A", "negative").otherwise("unknown")
        return self.line.where((F.col("l_linestatus") == "O") & (F.col("l_quantity") <= 10)).select(
            "pat_id", "instance", F.col("day").alias("test_date"), result.alias("result"))

    @cached_property
    def positive(self) -> DataFrame:
        return self.test.where("result = 'positive'").select("pat_id", "instance", "test_date")

    @cached_property
    def dx(self) -> DataFrame:
        return self.line.select("pat_id", "instance", F.col("l_suppkey").alias("dx_id"), F.col("day").alias("dx_date"))

    @cached_property
    def med(self) -> DataFrame:
        drug = self.t("part").select(F.col("p_partkey").alias("medication_id"), F.col("p_brand").alias("short_name"))
        mode = F.when(F.col("l_linestatus") == "O", "Inpatient").otherwise("Outpatient")
        return self.line.select("pat_id", "instance", F.col("l_partkey").alias("medication_id"), F.col("day").alias("start_date"),
                                mode.alias("order_mode"), F.col("l_quantity").alias("quantity")).join(drug, "medication_id")

    @cached_property
    def measure(self) -> DataFrame:
        return self.t("events").select(F.col("user_id").alias("pat_id"), self._instance("user_id"), F.col("ts").alias("recorded_time"),
                                       F.col("event_type").alias("measure"), "value", "event_id")

    @cached_property
    def index(self) -> DataFrame:
        """First positive test per person."""
        return self.positive.groupBy("pat_id", "instance").agg(F.min("test_date").alias("index_date"))

    @cached_property
    def chart(self) -> DataFrame:
        """A reference growth chart from a rule: grams by sex, week (14..40) and percentile."""
        weeks = self.spark.range(14, 41).select(F.col("id").cast("int").alias("week"))
        cells = [(s, p) for s, ps in (("male", (5, 25, 50, 75, 95)), ("female", (5, 25, 50, 75, 95)), ("unknown", (5, 25, 50, 75, 95)))
                 for p in ps]
        curves = F.inline(F.array(*[F.struct(F.lit(s).alias("sex"), F.lit(float(p)).alias("percentile")) for s, p in cells]))
        base = F.pow(F.col("week") / 10.0, F.lit(3.5)) * 26.0
        shift = F.when(F.col("sex") == "male", 1.03).when(F.col("sex") == "female", 0.97).otherwise(1.0)
        return weeks.select("week", curves).withColumn("grams", base * shift * (0.7 + F.col("percentile") / 170.0))

    @cached_property
    def records(self) -> Records:
        key3 = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("instance")
        orders, line, ev = self.t("orders"), self.line, self.t("events")
        visit = [F.col("l_orderkey").alias("pat_enc_csn_id"), "instance", F.col("l_linenumber").alias("line")]
        own = [F.col("o_custkey").alias("pat_id"), self._instance("o_custkey")]
        who = [F.col("user_id").alias("pat_id"), self._instance("user_id")]
        ids = self.t("supplier").select(
            F.when(F.col("s_suppkey") % 4 == 0, "diabetes").otherwise("asthma").alias("label"),
            F.col("s_suppkey").alias("dx_id"), key3).where("label = 'diabetes' or dx_id % 4 = 1")
        drugs = self.t("part").where("p_size <= 10").select(F.lit("vasopressor").alias("label"), F.col("p_partkey").alias("medication_id"), key3)
        return Records(
            tables={
                "person": self.person,
                "person_race": orders.select(*own, F.col("o_orderpriority").alias("race")),
                "encounter": orders.select(*own, F.col("o_orderkey").alias("pat_enc_csn_id"), F.to_date("o_orderdate").alias("contact_date"),
                                           F.col("o_orderstatus").alias("encounter_type"), F.lit("x").alias("acuity")),
                "encounterdiagnosis": line.select(F.col("l_orderkey").alias("pat_enc_csn_id"), "instance", F.col("l_suppkey").alias("dx_id")),
                "adtevent": line.where("l_quantity > 25").select(*visit, F.col("day").alias("effective_date"), F.col("l_returnflag").alias("adt_event_type"), F.lit("x").alias("adt_bed_id")),
                "admissionreason": line.where("l_linenumber <= 2").select(*visit, F.col("l_returnflag").alias("reason"), F.col("day").alias("pat_enc_date_real")),
                "chiefcomplaint": line.where("l_discount > 0.05").select(*visit, F.col("l_linestatus").alias("complaint"), F.col("day").alias("pat_enc_date_real")),
                "medicalhistory": line.where("l_tax > 0.04").select(*visit, F.col("l_suppkey").alias("dx_id"), F.col("day").alias("medical_hx_date")),
                "notes": line.where("l_tax <= 0.04").select(*visit, F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("text"), F.col("l_suppkey").alias("author_user_id")),
                "cardiovascularfinding": line.where("l_quantity <= 25").select(F.col("l_orderkey").alias("order_proc_id"), "instance", F.col("l_returnflag").alias("finding"),
                                                                               F.col("l_linenumber").alias("finding_id")),
                "medicationadministration": line.where("l_linestatus = 'F'").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_med_id"), "instance",
                                                                                    F.date_add("day", 1).alias("taken_date"), F.col("l_returnflag").alias("action"), F.col("day").alias("due_datetime")),
                "inpatientdata": ev.where("value > 20").select(F.col("event_id").alias("inpatient_data_id"), self._instance("user_id"), F.col("event_type").alias("admission_type")),
                "diagnosis": self.t("supplier").select(F.col("s_suppkey").alias("dx_id"), F.col("s_name").alias("diagnosis_name"), key3),
                "procedureorders": orders.select(*own, F.col("o_orderkey").alias("order_proc_id"), F.to_date("o_orderdate").alias("ordering_datetime"),
                                                 F.col("o_orderpriority").alias("order_name")),
                "labresult": line.select(F.col("l_orderkey").alias("order_proc_id"), "instance", F.col("l_linestatus").alias("result_value"),
                                         F.when(F.col("l_returnflag") == "A", "first").otherwise("second").alias("result_name"),
                                         F.when(F.col("l_quantity") > 25, F.concat(F.lit("X"), "l_returnflag")).alias("loinc_code"),
                                         F.col("l_returnflag").alias("default_loinc_code")),
                "medicationorders": line.select("pat_id", "instance", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_med_id"),
                                                F.col("l_partkey").alias("medication_id"), F.col("day").alias("ordering_datetime"),
                                                F.col("l_quantity").alias("quantity")),
                "medication": self.t("part").select(F.col("p_partkey").alias("medication_id"), F.col("p_name").alias("name"), key3),
                "flowsheet": ev.select(*who, F.col("event_id").alias("fsd_id"), F.col("event_id").alias("inpatient_data_id")),
                "flowsheetentry": ev.select(F.col("event_id").alias("fsd_id"), self._instance("user_id"), F.col("event_type").alias("flo_meas_id"),
                                            F.col("ts").alias("recorded_time"), F.round(F.col("value") * 100).cast("bigint").cast("string").alias("value")),
                "flowsheetdefinition": ev.select(F.col("event_type").alias("flo_meas_id"), self._instance("user_id")).distinct().withColumn(
                    "measure_name", F.upper("flo_meas_id")),
                "episode": orders.select(*own, F.col("o_orderkey").alias("episode_id"), F.to_date("o_orderdate").alias("start_date")),
                "deliverysummary": orders.select(F.col("o_orderkey").alias("summary_block_id"), self._instance("o_custkey"),
                                                 F.col("o_totalprice").alias("birth_weight")).where("summary_block_id % 3 <> 0"),
                "obhistory": orders.select(F.col("o_orderkey").alias("episode_id"), self._instance("o_custkey"),
                                           F.col("o_orderstatus").alias("outcome")).where("episode_id % 2 = 0"),
            },
            condition_ids=ids, medication_ids=drugs, measure_codes=mapping_from_text(self.spark, MEASURE_TEXT), code_labels=CODE_LABELS)


_LINE = "line AS (SELECT l.*, o.o_custkey AS pat_id, CAST(o.o_custkey % 3 + 1 AS INTEGER) AS instance, CAST(l_shipdate AS DATE) AS day " \
        "FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey)"

_SQL = {
    "person": ([], """person AS (SELECT c_custkey AS pat_id, CAST(c_custkey % 3 + 1 AS INTEGER) AS instance,
      DATE '1955-01-01' + CAST(c_custkey * 37 % 10000 AS INTEGER) AS birth_date,
      CASE WHEN c_custkey % 17 = 0 THEN DATE '1996-01-01' + CAST(c_custkey * 13 % 2000 AS INTEGER) END AS death_date,
      c_name AS full_name, c_mktsegment AS segment, c_acctbal AS balance, c_nationkey AS nation FROM customer)"""),
    "episode": ([], """episode AS (SELECT o_custkey AS pat_id, CAST(o_custkey % 3 + 1 AS INTEGER) AS instance, o_orderkey AS episode_id,
      CAST(o_orderdate AS DATE) AS delivery, CAST(140 + o_orderkey % 161 AS INTEGER) AS gest_days,
      CAST(o_orderdate AS DATE) - CAST(140 + o_orderkey % 161 AS INTEGER) AS conception,
      CAST(o_orderdate AS DATE) + CAST(o_orderkey % 29 - 14 AS INTEGER) AS due,
      CAST(40 + o_orderkey % 120 AS DOUBLE) AS weight_oz,
      CASE o_orderkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Other' END AS sex,
      CASE WHEN o_orderkey % 50 = 0 THEN 2 ELSE 1 END AS fetuses, o_orderstatus AS status, o_orderpriority AS priority,
      o_totalprice AS price FROM orders)"""),
    "line": ([], _LINE),
    "dose": (["line"], """dose AS (SELECT DISTINCT pat_id, instance, day AS dose_date,
      CASE l_returnflag WHEN 'A' THEN 'MODERNA' WHEN 'R' THEN 'PFIZER' ELSE 'JANSSEN' END ||
      CASE WHEN l_tax > 0.065 THEN ' BIVALENT' ELSE '' END AS product FROM line WHERE l_linestatus = 'F' AND l_quantity <= 3)"""),
    "test": (["line"], """test AS (SELECT pat_id, instance, day AS test_date,
      CASE l_returnflag WHEN 'R' THEN 'positive' WHEN 'A' THEN 'negative' ELSE 'unknown' END AS result
      FROM line WHERE l_linestatus = 'O' AND l_quantity <= 10)"""),
    "positive": (["test"], "positive AS (SELECT pat_id, instance, test_date FROM test WHERE result = 'positive')"),
    "idx": (["positive"], "idx AS (SELECT pat_id, instance, min(test_date) AS index_date FROM positive GROUP BY ALL)"),
    "dx": (["line"], "dx AS (SELECT pat_id, instance, l_suppkey AS dx_id, day AS dx_date FROM line)"),
    "med": (["line"], """med AS (SELECT pat_id, instance, l_partkey AS medication_id, day AS start_date,
      CASE l_linestatus WHEN 'O' THEN 'Inpatient' ELSE 'Outpatient' END AS order_mode, l_quantity AS quantity, p_brand AS short_name
      FROM line JOIN part ON l_partkey = p_partkey)"""),
    "measure": ([], """measure AS (SELECT user_id AS pat_id, CAST(user_id % 3 + 1 AS INTEGER) AS instance, ts AS recorded_time,
      event_type AS measure, value, event_id FROM events)"""),
    "chart": ([], """chart AS (SELECT CAST(w AS INTEGER) AS week, sex, CAST(p AS DOUBLE) AS percentile, pow(w / 10.0, 3.5) * 26.0 *
      CASE sex WHEN 'male' THEN 1.03 WHEN 'female' THEN 0.97 ELSE 1.0 END * (0.7 + p / 170.0) AS grams
      FROM range(14, 41) r(w), (VALUES ('male'), ('female'), ('unknown')) s(sex), (VALUES (5), (25), (50), (75), (95)) q(p))"""),
    # Dose history: one row per person and dose day, numbered, then the person's first three and last.
    "history": (["dose"], """dose_day AS (SELECT pat_id, instance, dose_date, min(product) AS product FROM dose GROUP BY ALL),
      dose_no AS (SELECT *, row_number() OVER (PARTITION BY pat_id, instance ORDER BY dose_date) AS n FROM dose_day),
      history AS (SELECT pat_id, instance, CAST(count(*) AS INTEGER) AS n_doses,
      max(CASE WHEN n = 1 THEN dose_date END) AS first_date, max(CASE WHEN n = 1 THEN product END) AS first_product,
      max(CASE WHEN n = 2 THEN dose_date END) AS second_date, max(CASE WHEN n = 2 THEN product END) AS second_product,
      max(CASE WHEN n = 3 THEN dose_date END) AS third_date, max(CASE WHEN n = 3 THEN product END) AS third_product,
      max(dose_date) AS last_date, max_by(product, dose_date) AS last_product FROM dose_no GROUP BY pat_id, instance)"""),
    "infection": (["episode", "positive"], """infection AS (SELECT e.*,
      (SELECT min(test_date) FROM positive p WHERE p.pat_id = e.pat_id AND p.instance = e.instance AND p.test_date >= e.conception
       AND p.test_date <= e.delivery) AS infection_date,
      (SELECT min(test_date) FROM positive p WHERE p.pat_id = e.pat_id AND p.instance = e.instance AND p.test_date < e.conception)
       AS prior_date FROM episode e)"""),
}


def state_sql(source: str, at: str, name: str = "state") -> str:
    """The exposure rule as a CTE over ``source`` with the index date ``at`` (needs ``history``)."""
    return f"""{name}_a AS (SELECT s.*, h.* EXCLUDE (pat_id, instance),
      (first_product LIKE '%JANSSEN%') AND (second_date IS NULL OR second_date > s.{at} OR first_product = last_product)
        AND first_date + 14 < s.{at} AS by_one,
      ((first_product LIKE '%MODERNA%' AND second_product LIKE '%MODERNA%') OR
       (first_product LIKE '%PFIZER%' AND second_product LIKE '%PFIZER%')) AND second_date + 14 < s.{at} AS by_two
      FROM {source} s LEFT JOIN history h USING (pat_id, instance)),
    {name} AS (SELECT *, CASE WHEN by_one THEN first_date + 14 WHEN by_two THEN second_date + 14 END AS full_date,
      CASE WHEN by_one THEN first_product WHEN by_two THEN second_product END AS full_product,
      CASE WHEN by_two AND third_date < {at} THEN third_date END AS booster_date,
      CASE WHEN by_two AND third_date < {at} THEN third_product END AS booster_product,
      CASE WHEN first_date IS NULL THEN 'never' WHEN first_date > {at} THEN 'later'
        WHEN by_two AND third_date < {at} THEN 'boosted' WHEN by_one OR by_two THEN 'full' ELSE 'partial' END AS state
      FROM {name}_a)"""


def sql(body: str, *names: str, extra: str = "") -> str:
    """``body`` with the named views (and what they need) in front as CTEs, then ``extra`` ones."""
    done: list[str] = []

    def need(name: str) -> None:
        if name not in done:
            for other in _SQL[name][0]:
                need(other)
            done.append(name)

    for n in names:
        need(n)
    ctes = [_SQL[n][1] for n in done] + ([extra] if extra else [])
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
