"""Record getters, sources, tables and profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortspark.operators import models, profile, stats
from cohortspark.plans.registry import query
from cohortspark.session import scratch_path
from cohortspark.sources import records as rec
from cohortspark.sources import registry, tables
from cohortspark.sources.views import CODE_LABELS, MEASURE_TEXT, sql

_RACE = """race AS (SELECT o_custkey AS pat_id, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS race FROM orders
  GROUP BY o_custkey)"""
_KEY3 = "(VALUES (1), (2), (3)) k(instance)"


@query("scan_person_cohort", sql("SELECT p.pat_id, p.instance, birth_date, segment, race FROM person p LEFT JOIN race r ON p.pat_id = r.pat_id "
                                 "WHERE birth_date < DATE '1975-01-01'", "person", extra=_RACE))
def scan_person_cohort(v):
    df = rec.person_cohort(v.records, "birth_date < date'1975-01-01'", True)
    return df.select("pat_id", "instance", "birth_date", "segment", F.array_join("race", ";").alias("race"))


@query("scan_encounters", sql(f"""SELECT p.pat_id, p.instance, o_orderkey AS pat_enc_csn_id, CAST(o_orderdate AS DATE) AS contact_date,
  round(date_diff('day', birth_date, CAST(o_orderdate AS DATE)) / 365.25, 1) AS age_at_contact_dt, l_suppkey AS dx_id, s_name AS diagnosis_name,
  coalesce(l_suppkey % 4 = 0, false) AS diabetes, coalesce(l_suppkey % 4 = 1, false) AS asthma
  FROM person p JOIN orders ON o_custkey = p.pat_id LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey
  WHERE o_orderdate >= DATE '1999-01-01'""", "person"))
def scan_encounters(v):
    cohort = rec.person_cohort(v.records, include_race=False)
    df = rec.encounters(v.records, cohort, ["birth_date"], "encounterdiagnosis", "contact_date >= date'1999-01-01'", None, ["diabetes", "asthma"])
    return df.select("pat_id", "instance", "pat_enc_csn_id", "contact_date", "age_at_contact_dt", "dx_id", "diagnosis_name", "diabetes", "asthma")


@query("scan_procedure_orders", sql("""SELECT p.pat_id, p.instance, o_orderkey AS order_proc_id, o_orderpriority AS order_name,
  round(date_diff('day', birth_date, CAST(o_orderdate AS DATE)) / 365.25, 1) AS age_at_order_dt, l_returnflag AS lab_code, array_to_string(codes, ';') AS lab_codes,
  CASE WHEN list_contains(codes, 'A') THEN l_linestatus END AS flag_a, CASE WHEN list_has_any(codes, ['R', 'N']) THEN l_linestatus END AS flag_r
  FROM person p JOIN orders ON o_custkey = p.pat_id JOIN lineitem l ON l_orderkey = o_orderkey JOIN named ON first = (l.l_returnflag = 'A') WHERE l_linestatus = 'F'""", "person",
  extra="named AS (SELECT l_returnflag = 'A' AS first, list_sort(list(DISTINCT l_returnflag)) AS codes FROM lineitem GROUP BY 1)"))
def scan_procedure_orders(v):
    cohort = rec.person_cohort(v.records, include_race=False)
    df = rec.procedure_orders(v.records, cohort, ["birth_date"], "labresult", "result_value = 'F'", None, ["flag_a", "flag_r"])
    return df.select("pat_id", "instance", "order_proc_id", "order_name", "age_at_order_dt", "lab_code", F.array_join("lab_codes", ";").alias("lab_codes"), "flag_a", "flag_r")


@query("scan_medication_orders", sql("""SELECT pat_id, instance, l_orderkey * 10 + l_linenumber AS order_med_id, l_partkey AS medication_id, p_name AS name,
  coalesce(p_size <= 10, false) AS vasopressor, round(date_diff('day', birth_date, day) / 365.25, 1) AS age_at_order_dt
  FROM person JOIN line USING (pat_id, instance) LEFT JOIN part ON p_partkey = l_partkey WHERE l_quantity < 10""", "person", "line"))
def scan_medication_orders(v):
    cohort = rec.person_cohort(v.records, include_race=False)
    df = rec.medication_orders(v.records, cohort, ["birth_date"], None, "quantity < 10", (), ["vasopressor"])
    return df.select("pat_id", "instance", "order_med_id", "medication_id", "name", "vasopressor", "age_at_order_dt")


@query("scan_flowsheets", sql("""SELECT pat_id, instance, event_id AS fsd_id, measure AS flo_meas_id, upper(measure) AS measure_name,
  CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS value,
  CASE WHEN measure = 'click' OR (measure = 'error' AND instance <> 3) THEN CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS oxygen_device,
  CASE WHEN measure = 'view' THEN CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS blood_pressure,
  round(date_diff('day', birth_date, CAST(recorded_time AS DATE)) / 365.25, 1) AS age_at_recorded_dt
  FROM person JOIN measure USING (pat_id, instance)""", "person", "measure"))
def scan_flowsheets(v):
    cohort = rec.person_cohort(v.records, include_race=False)
    df = rec.flowsheets(v.records, cohort, ["birth_date"], None, "fsd_id is not null", None, ["oxygen_device", "blood_pressure"])
    return df.select("pat_id", "instance", "fsd_id", "flo_meas_id", "measure_name", "value", "oxygen_device", "blood_pressure", "age_at_recorded_dt")


@query("scan_episode_blocks", sql("""SELECT pat_id, instance, o_orderkey AS episode_id,
  round(date_diff('day', birth_date, CAST(o_orderdate AS DATE)) / 365.25, 1) AS age_at_start_dt,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS birth_weight, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS outcome
  FROM person LEFT JOIN orders ON o_custkey = pat_id""", "person"))
def scan_episode_blocks(v):
    df = rec.episode_blocks(v.records, rec.person_cohort(v.records, include_race=False), ["birth_date"])
    return df.select("pat_id", "instance", "episode_id", "age_at_start_dt", "birth_weight", "outcome")


# The other children of each getter: name, SQL of the child with its key, columns it adds. Default omissions are dropped.
_VISIT_CHILDREN = {
    "adtevent": ("l_quantity > 25", "day AS effective_date, l_returnflag AS adt_event_type", ["effective_date", "adt_event_type"]),
    "admissionreason": ("l_linenumber <= 2", "l_returnflag AS reason", ["reason"]),
    "chiefcomplaint": ("l_discount > 0.05", "l_linestatus AS complaint", ["complaint"]),
    "medicalhistory": ("l_tax > 0.04", "l_suppkey AS dx_id, day AS medical_hx_date, s_name AS diagnosis_name", ["dx_id", "medical_hx_date", "diagnosis_name"]),
    "notes": ("l_tax <= 0.04", "l_returnflag || ' ' || l_linestatus AS text", ["text"]),
}


def _scan_visits(child: str, where: str, select: str, added: list[str]) -> None:
    text = f"""SELECT p.pat_id, p.instance, o_orderkey AS pat_enc_csn_id, CAST(o_orderdate AS DATE) AS contact_date, c.* EXCLUDE (k) FROM person p LEFT JOIN orders ON o_custkey = p.pat_id
      LEFT JOIN (SELECT l_orderkey AS k, l_linenumber AS line, {select} FROM line JOIN supplier ON s_suppkey = l_suppkey WHERE {where}) c ON k = o_orderkey"""

    @query(f"scan_encounters_{child}", sql(text, "person", "line"))
    def scan(v):
        df = rec.encounters(v.records, rec.person_cohort(v.records, include_race=False), [], child)
        return df.select("pat_id", "instance", "pat_enc_csn_id", "contact_date", "line", *added)


for _child, _parts in _VISIT_CHILDREN.items():
    _scan_visits(_child, *_parts)


@query("scan_procedure_findings", sql("""SELECT p.pat_id, p.instance, o_orderkey AS order_proc_id, o_orderpriority AS order_name, l_returnflag AS finding
  FROM person p LEFT JOIN orders ON o_custkey = p.pat_id LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity <= 25""", "person"))
def scan_procedure_findings(v):
    df = rec.procedure_orders(v.records, rec.person_cohort(v.records, include_race=False), [], "cardiovascularfinding")
    return df.select("pat_id", "instance", "order_proc_id", "order_name", "finding")


@query("scan_medication_administrations", sql("""SELECT pat_id, instance, l_orderkey * 10 + l_linenumber AS order_med_id, p_name AS name, taken_date, action
  FROM person LEFT JOIN line USING (pat_id, instance) LEFT JOIN part ON p_partkey = l_partkey
  LEFT JOIN (SELECT l_orderkey * 10 + l_linenumber AS k, instance AS i, day + 1 AS taken_date, l_returnflag AS action FROM line WHERE l_linestatus = 'F') ON k = l_orderkey * 10 + l_linenumber AND i = instance""", "person", "line"))
def scan_medication_administrations(v):
    df = rec.medication_orders(v.records, rec.person_cohort(v.records, include_race=False), [], "medicationadministration")
    return df.select("pat_id", "instance", "order_med_id", "name", "taken_date", "action")


@query("scan_flowsheets_inpatient", sql("""SELECT pat_id, instance, event_id AS fsd_id, measure AS flo_meas_id, CASE WHEN value > 20 THEN measure END AS admission_type
  FROM person LEFT JOIN measure USING (pat_id, instance)""", "person", "measure"))
def scan_flowsheets_inpatient(v):
    df = rec.flowsheets(v.records, rec.person_cohort(v.records, include_race=False), [], "inpatientdata")
    return df.select("pat_id", "instance", "fsd_id", "flo_meas_id", "admission_type")


@query("omit_default_columns", sql("SELECT pat_id, instance, birth_date, death_date, segment, balance, nation FROM person", "person"))
def omit_default_columns(v):
    return v.person.drop(*rec.default_omissions(["person", "person_race"]))


@query("inline_mapping_source", """SELECT event_type, c.code, c.description, count(*) AS n FROM events LEFT JOIN (VALUES ('click', '426854004',
  'high flow oxygen'), ('error', '706172005', 'ventilator'), ('view', '271649006', 'systolic pressure')) c(m, code, description) ON m = event_type
  AND NOT (m = 'error' AND user_id % 3 = 2) GROUP BY ALL""")
def inline_mapping_source(v):
    mapping = registry.mapping_from_text(v.spark, MEASURE_TEXT).withColumnRenamed("flo_meas_id", "event_type")
    events = v.t("events").withColumn("instance", (F.col("user_id") % 3 + 1).cast("int"))
    return events.join(F.broadcast(mapping), ["event_type", "instance"], "left").groupBy("event_type", "code", "description").agg(
        F.count(F.lit(1)).alias("n"))


@query("registry_source", """SELECT label, count(*) AS n FROM lineitem JOIN (VALUES ('flag_a', 'A'), ('flag_r', 'R'), ('flag_r', 'N')) c(label, code)
  ON code = l_returnflag GROUP BY label""")
def registry_source(v):
    codes = registry.registry_frame(v.spark, {k: CODE_LABELS[k] for k in ("flag_a", "flag_r")})
    return v.t("lineitem").join(F.broadcast(codes), F.col("l_returnflag") == F.col("code")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _stage(v):
    return v.t("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_key"))


_STAGE = "SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS last_key FROM orders GROUP BY o_orderstatus"


def _name(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex[:12]}"


@query("table_write", _STAGE)
def table_write(v):
    name = _name("stage_write")
    tables.write_table(_stage(v), name)
    tables.write_table(_stage(v), name, replace=True)
    return v.spark.table(name)


@query("table_append", f"SELECT * FROM ({_STAGE}) UNION ALL SELECT * FROM ({_STAGE})")
def table_append(v):
    name = _name("stage_append")
    tables.write_table(_stage(v), name)
    tables.append_table(_stage(v).select("last_key", "n", "o_orderstatus"), name)
    return v.spark.table(name)


@query("table_cache", _STAGE)
def table_cache(v):
    return v.spark.table(tables.cache_table(_stage(v)))


@query("table_path_write", _STAGE)
def table_path_write(v):
    name = _name("stage_path")
    tables.write_path_table(_stage(v), name, scratch_path(v.spark, name))
    return v.spark.table(name)


@query("table_path_append", f"SELECT * FROM ({_STAGE}) UNION ALL SELECT * FROM ({_STAGE})")
def table_path_append(v):
    name = _name("stage_path_append")
    tables.write_path_table(_stage(v), name, scratch_path(v.spark, name))
    tables.append_path_table(_stage(v), name)
    return v.spark.table(name)


@query("table_drop", "SELECT count(*) AS n_orders, true AS existed, false AS still_there FROM orders")
def table_drop(v):
    name = _name("stage_drop")
    tables.write_table(_stage(v), name)
    n = v.spark.table(name).agg(F.sum("n").alias("n_orders"))
    total = n.first()[0]
    existed = tables.drop_table(v.spark, name)
    left = v.spark.catalog.tableExists(name)
    return v.t("orders").agg(F.count(F.lit(1)).alias("n_orders")).where(F.col("n_orders") == total).select(
        "n_orders", F.lit(existed).alias("existed"), F.lit(left).alias("still_there"))


@query("table_drop_cached", "SELECT count(*) AS n_orders, true AS dropped FROM orders")
def table_drop_cached(v):
    database = _name("stage_db")
    v.spark.sql(f"CREATE DATABASE {database}")
    name = tables.cache_table(_stage(v), database).split(".")[1]
    gone = tables.drop_cached_tables(v.spark, database)
    v.spark.sql(f"DROP DATABASE {database} CASCADE")
    return v.t("orders").agg(F.count(F.lit(1)).alias("n_orders")).withColumn("dropped", F.lit(gone == [name]))


@query("table_list_permanent", "SELECT count(*) AS n_orders, true AS listed FROM orders")
def table_list_permanent(v):
    name = _name("stage_list")
    tables.write_table(_stage(v), name)
    listed = name in tables.list_tables(v.spark)
    return v.spark.table(name).agg(F.sum("n").alias("n_orders")).withColumn("listed", F.lit(listed))


@query("profile_field_values", """WITH c AS (
  SELECT 'orders' AS "table", 'o_orderstatus' AS field, o_orderstatus AS value, CAST(NULL AS VARCHAR) AS value_2, count(*) AS n FROM orders GROUP BY ALL
  UNION ALL SELECT 'orders', 'o_orderpriority,o_orderstatus', o_orderpriority, o_orderstatus, count(*) FROM orders GROUP BY ALL
  UNION ALL SELECT 'lineitem', 'l_returnflag', l_returnflag, NULL, count(*) FROM lineitem GROUP BY ALL
  UNION ALL SELECT 'lineitem', 'l_suppkey', CAST(l_suppkey AS VARCHAR), NULL, count(*) FROM lineitem GROUP BY ALL)
  SELECT *, row_number() OVER (PARTITION BY "table", field ORDER BY value, value_2) AS row_id FROM c""")
def profile_field_values(v):
    out = profile.value_counts(
        {"orders": v.t("orders"), "lineitem": v.t("lineitem")},
        {"orders": ["o_orderstatus", ("o_orderpriority", "o_orderstatus")], "lineitem": ["l_returnflag", "l_suppkey"]})
    return out.drop("instance")


@query("profile_table_details", sql("""SELECT "column", type, count(*) AS n_rows, count(DISTINCT x) AS n_distinct,
  count(DISTINCT CASE WHEN x IS NOT NULL THEN x || '/' || instance END) AS n_distinct_with_instance, count(*) - count(x) AS n_null FROM (
  SELECT instance, unnest([{'c': 'pat_id', 't': 'bigint', 'x': CAST(pat_id AS VARCHAR)}, {'c': 'death_date', 't': 'date', 'x': CAST(death_date AS VARCHAR)},
  {'c': 'segment', 't': 'string', 'x': segment}, {'c': 'nation', 't': 'int', 'x': CAST(nation AS VARCHAR)}]) AS u FROM person) s,
  LATERAL (SELECT u.c AS "column", u.t AS type, u.x AS x) GROUP BY ALL""", "person"))
def profile_table_details(v):
    return profile.table_details(v.person.select("pat_id", "instance", "death_date", "segment", "nation"))


@query("model_info_io", """WITH x AS (SELECT unnest([{'f': 'price', 'v': floor(o_totalprice / 1000 / 100)}, {'f': 'days', 'v': floor((o_orderkey % 161 + 140) / 30)}]) AS u, o_orderstatus = 'F' AS y FROM orders),
  c AS (SELECT u.f AS f, u.v AS v, y, count(*) AS n FROM x GROUP BY ALL), e AS (SELECT f, v, y, n, sum(n) OVER (PARTITION BY f, v) * sum(n) OVER (PARTITION BY f, y) / sum(n) OVER (PARTITION BY f) AS e FROM c)
  SELECT f AS feature, round(sum((n - e) ** 2 / e), 5) AS chi_square, (count(DISTINCT v) - 1) * (count(DISTINCT y) - 1) AS df, 1000 AS max_iter, (SELECT count(*) FROM orders) AS n_rows, 'price,days' AS features FROM e GROUP BY 1""")
def model_info_io(v):
    """A fitted model, its coefficient table with the features' tests, and its notes survive a round trip through storage."""
    df = v.episode.select((F.col("price") / 1000).alias("price"), F.col("gest_days").cast("double").alias("days"),
                          (F.col("status") == "F").cast("int").alias("y"))
    features = ["price", "days"]
    model = models.logistic(df, features, "y")
    banded = df.select(F.floor(F.col("price") / 100).alias("price"), F.floor(F.col("days") / 30).alias("days"), "y")
    tests = stats.with_p(stats.chi_square_features(banded, features, "y"), stats.chi2_tail, "chi_square", "df")
    path = scratch_path(v.spark, "model")
    models.save_model(model, features, tests, path, max_iter=model.stages[-1].getMaxIter(), n_rows=df.count())
    again, coefficients, notes = models.load_model(v.spark, path)
    # The stored table must be that of the stored model.
    found = coefficients.join(models.coefficient_table(v.spark, again, notes["features"]), ["feature", "coefficient"], "left_semi")
    return found.where("p_value is not null").select("feature", F.round("chi_square", 5).alias("chi_square"), "df", F.lit(notes["max_iter"]).alias("max_iter"),
                                                     F.lit(notes["n_rows"]).cast("bigint").alias("n_rows"), F.lit(",".join(notes["features"])).alias("features"))
