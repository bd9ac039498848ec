"""Filters, joins, windows, ordering and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cohortspark.functions import sqlrules
from cohortspark.functions.dates import age_years
from cohortspark.functions.numbers import bmi_from
from cohortspark.functions.strings import coverage_group
from cohortspark.operators import cohorts, concepts, features, joins, matching, models, timeline
from cohortspark.operators.cohorts import PERSON, eligible
from cohortspark.operators.ranks import ranked
from cohortspark.plans.registry import query
from cohortspark.session import broadcast_if_small
from cohortspark.sources.views import sql

EPISODE = ["pat_id", "instance", "episode_id"]


def count_rows():
    return F.count(F.lit(1)).alias("n")


# ---- filters -----------------------------------------------------------------------------------------------------


@query("filter_sql_string", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderpriority LIKE '1%'")
def filter_sql_string(v):
    return v.t("orders").where("o_totalprice > 250000 and o_orderpriority like '1%'").select("o_orderkey", "o_totalprice")


@query("filter_sql_rule", """SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders
  WHERE right('0000' || o_orderkey, 4) >= '0500' AND lower(replace(o_orderpriority, '-', '')) IN ('1urgent', '4not specified') AND o_orderstatus <> 'P'""")
def filter_sql_rule(v):
    """A filter string that calls column rules by name."""
    sqlrules.register(v.spark)
    kept = v.t("orders").where("""zero_pad_front(CAST(o_orderkey AS STRING), 4) >= '0500' AND clean_text(o_orderpriority) IN ('1urgent', '4not specified')
                                  AND code_of(concat('STATUS#', o_orderstatus)) <> 'P'""")
    return kept.select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("filter_any_concept", sql("""SELECT pat_id, order_med_id, heavy, note FROM (SELECT pat_id, l_orderkey * 10 + l_linenumber AS order_med_id,
  l_quantity > 45 AS heavy, CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS note FROM line) WHERE heavy OR note IS NOT NULL""", "line"))
def filter_any_concept(v):
    df = v.line.select("pat_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_med_id"), (F.col("l_quantity") > 45).alias("heavy"),
                       F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("note"))
    return concepts.any_concept(df, ["heavy", "note"])


@query("filter_date_window", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate >= DATE '1997-03-05' AND o_orderdate < DATE '1999-06-01'")
def filter_date_window(v, start: str = "1997-03-05", end: str = "1999-06-01"):
    ts = F.col("o_orderdate")
    return v.t("orders").where((ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))).select(
        "o_orderkey", F.to_date(ts).alias("day"))


@query("filter_eligibility", sql("""SELECT pat_id, instance, episode_id, age, gest_days FROM (SELECT e.*,
  round(date_diff('day', birth_date, conception) / 365.25, 1) AS age FROM episode e JOIN person USING (pat_id, instance))
  WHERE fetuses = 1 AND age >= 18 AND age < 45 AND gest_days >= 140 AND delivery >= DATE '1997-01-01'""", "person", "episode"))
def filter_eligibility(v):
    df = v.episode.join(v.person.select(*PERSON, "birth_date"), PERSON).withColumn("age", age_years(F.col("birth_date"), F.col("conception")))
    keep = eligible(F.col("age"), F.col("gest_days"), F.col("fetuses"), F.col("delivery"), "1997-01-01")
    return df.where(keep).select(*EPISODE, "age", "gest_days")


@query("filter_like", sql("SELECT product, count(*) AS n FROM dose WHERE product LIKE '%MODERNA%' OR product LIKE '%PFIZER%' GROUP BY 1", "dose"))
def filter_like(v):
    return v.dose.where(F.col("product").like("%MODERNA%") | F.col("product").like("%PFIZER%")).groupBy("product").agg(count_rows())


@query("filter_not_like", sql("SELECT product, count(*) AS n FROM dose WHERE product NOT LIKE '%BIVALENT%' GROUP BY 1", "dose"))
def filter_not_like(v):
    return v.dose.where(~F.col("product").like("%BIVALENT%")).groupBy("product").agg(count_rows())


@query("filter_isin", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_isin(v):
    return v.t("orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@query("filter_code_predicate", sql("SELECT dx_id, count(*) AS n FROM dx WHERE dx_id % 4 IN (0, 1) GROUP BY 1", "dx"))
def filter_code_predicate(v):
    kept = concepts.filter_by_codes(v.dx, v.records.condition_ids, ["diabetes", "asthma"], ["dx_id", "instance"])
    return kept.groupBy("dx_id").agg(count_rows())


@query("drop_null_keys", sql("SELECT pat_id, instance, death_date FROM person WHERE death_date IS NOT NULL", "person"))
def drop_null_keys(v):
    return v.person.na.drop(subset=["pat_id", "death_date"]).select(*PERSON, "death_date")


@query("fill_nulls", """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_quantity > 5 THEN l_quantity END AS q,
  CASE WHEN l_tax > 0.04 THEN l_tax END AS t FROM lineitem), m AS (SELECT median(t) AS mt FROM x)
  SELECT l_orderkey, l_partkey, l_extendedprice, coalesce(q, 0) AS q, coalesce(t, mt) AS t,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_linenumber AS VARCHAR) END AS s FROM x, m""")
def fill_nulls(v):
    df = v.t("lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("q"),
                                F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("t"),
                                F.when(F.col("l_linenumber") == 3, "-999.0").otherwise(F.col("l_linenumber").cast("string")).alias("s"))
    return matching.fill_with_medians(df.na.fill(0, ["q"]), ["t"]).withColumn("s", F.nullif(F.col("s"), F.lit("-999.0")))


@query("rename_columns", "SELECT o_orderkey AS episode_id, o_custkey AS pat_id, o_totalprice AS price FROM orders")
def rename_columns(v):
    df = v.t("orders").withColumnsRenamed({"o_orderkey": "episode_id", "o_custkey": "pat_id", "o_totalprice": "price"})
    return df.select("episode_id", "pat_id", "price")


@query("coalesce_sources", sql("SELECT pat_id, instance, coalesce(death_date, index_date, birth_date) AS day FROM person LEFT JOIN idx USING (pat_id, instance)", "person", "idx"))
def coalesce_sources(v):
    return v.person.join(v.index, PERSON, "left").select(*PERSON, F.coalesce("death_date", "index_date", "birth_date").alias("day"))


@query("flag_from_sum", sql("""SELECT pat_id, instance, CASE WHEN sum(CASE WHEN dx_id % 4 = 0 THEN 1 ELSE 0 END) > 0 THEN 1 ELSE 0 END AS diabetes,
  CASE WHEN sum(CASE WHEN dx_id % 7 = 0 THEN 1 ELSE 0 END) > 0 THEN 1 ELSE 0 END AS asthma FROM dx GROUP BY 1, 2""", "dx"))
def flag_from_sum(v):
    labels = {"diabetes": F.col("dx_id") % 4 == 0, "asthma": F.col("dx_id") % 7 == 0}
    sums = v.dx.groupBy(*PERSON).agg(*[F.sum(c.cast("int")).alias(n) for n, c in labels.items()])
    return sums.select(*PERSON, *[F.when(F.col(n) > 0, 1).otherwise(0).alias(n) for n in labels])


# ---- joins -------------------------------------------------------------------------------------------------------


@query("join_inner_equi", sql("SELECT pat_id, instance, episode_id, segment FROM episode JOIN person USING (pat_id, instance)", "episode", "person"))
def join_inner_equi(v):
    return v.episode.join(v.person, PERSON).select(*EPISODE, "segment")


@query("join_left_equi", sql("SELECT pat_id, instance, segment, episode_id FROM person LEFT JOIN episode USING (pat_id, instance)", "episode", "person"))
def join_left_equi(v):
    return joins.fan_out(v.person, v.episode, PERSON).select(*PERSON, "segment", "episode_id")


@query("join_right_residual", sql("""SELECT i.pat_id, i.instance, index_date, p.death_date FROM idx i LEFT JOIN person p ON p.pat_id = i.pat_id
  AND p.instance = i.instance AND p.death_date >= i.index_date AND p.death_date < i.index_date + INTERVAL 3 MONTH""", "person", "idx"))
def join_right_residual(v):
    near = (F.col("death_date") >= F.col("index_date")) & (F.col("death_date") < F.add_months("index_date", 3))
    return joins.left_with_condition(v.index, v.person.select(*PERSON, "death_date"), PERSON, near)


@query("join_left_anti", sql("SELECT pat_id, instance FROM person WHERE (pat_id, instance) NOT IN (SELECT pat_id, instance FROM dose)", "person", "dose"))
def join_left_anti(v):
    return v.person.join(v.dose, PERSON, "left_anti").select(*PERSON)


@query("join_not_exists", sql("""SELECT pat_id, instance, 0 AS infected FROM person p WHERE NOT EXISTS (SELECT 1 FROM positive t WHERE t.pat_id = p.pat_id
  AND t.instance = p.instance)""", "person", "positive"))
def join_not_exists(v):
    return v.person.join(v.positive, PERSON, "left_anti").select(*PERSON, F.lit(0).alias("infected"))


@query("join_semi", sql("SELECT pat_id, instance, episode_id FROM episode WHERE (pat_id, instance) IN (SELECT pat_id, instance FROM dose WHERE product LIKE '%BIVALENT%')", "episode", "dose"))
def join_semi(v):
    return v.episode.join(v.dose.where(F.col("product").like("%BIVALENT%")), PERSON, "left_semi").select(*EPISODE)


@query("join_broadcast", """SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL""")
def join_broadcast(v):
    place = v.t("nation").join(broadcast_if_small(v.t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return v.t("customer").join(broadcast_if_small(place), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(count_rows())


@query("join_interval_between", sql("""SELECT e.pat_id, e.instance, e.episode_id, count(dx_date) AS n_dx FROM episode e LEFT JOIN dx ON dx.pat_id = e.pat_id
  AND dx.instance = e.instance AND dx_date BETWEEN conception AND delivery GROUP BY ALL""", "episode", "dx"))
def join_interval_between(v):
    return timeline.count_between(v.episode, v.dx, PERSON, "conception", "delivery", "dx_date", "n_dx").select(*EPISODE, "n_dx")


@query("join_inequality_window", sql("""SELECT pat_id, instance, episode_id, first_date, infection_date FROM infection JOIN history USING (pat_id, instance)
  WHERE first_date + 14 < infection_date""", "infection", "history"))
def join_inequality_window(v):
    infected = cohorts.infection_in_episode(v.episode, v.positive)
    history = cohorts.exposure_history(v.dose).select(*PERSON, "first_date")
    return infected.join(history, PERSON).where(F.date_add("first_date", 14) < F.col("infection_date")).select(
        *EPISODE, "first_date", "infection_date")


@query("join_relative_window", sql("""SELECT pat_id, instance, medication_id, start_date, index_date FROM idx JOIN med USING (pat_id, instance)
  WHERE start_date >= index_date - 14 AND start_date < index_date + 56""", "idx", "med"))
def join_relative_window(v):
    near = (F.col("start_date") >= F.date_sub("index_date", 14)) & (F.col("start_date") < F.date_add("index_date", 56))
    return v.med.join(v.index, PERSON).where(near).select(*PERSON, "medication_id", "start_date", "index_date")


@query("join_asof_last", sql("""SELECT e.pat_id, e.instance, e.episode_id, round(h.inches, 4) AS height, round(w.ounces, 4) AS weight,
  round((w.ounces / 35.274) / ((h.inches / 39.37) * (h.inches / 39.37)), 4) AS bmi FROM episode e
  LEFT JOIN (SELECT pat_id, instance, max_by(inches, day) AS inches FROM (SELECT pat_id, instance, day, max(60 + l_quantity / 5) AS inches FROM line
    WHERE l_returnflag = 'A' GROUP BY ALL) GROUP BY ALL) h USING (pat_id, instance)
  LEFT JOIN (SELECT e.episode_id, max_by(ounces, day) AS ounces FROM episode e JOIN (SELECT pat_id, instance, day, max(1800 + 20 * l_quantity) AS ounces FROM line
    WHERE l_returnflag = 'R' GROUP BY ALL) x USING (pat_id, instance) WHERE day > conception - 365 AND day <= conception + 91 GROUP BY ALL) w
  ON w.episode_id = e.episode_id""", "episode", "line"))
def join_asof_last(v):
    """Last height ever and last weight from a year before to three months after conception, and the ratio."""
    height = v.line.where("l_returnflag = 'A'").groupBy(*PERSON, "day").agg(F.max(60 + F.col("l_quantity") / 5).alias("inches"))
    height = height.groupBy(*PERSON).agg(F.max_by("inches", "day").alias("height"))
    weight = timeline.daily(v.line.where("l_returnflag = 'R'"), PERSON, "day", {"ounces": F.max(1800 + 20 * F.col("l_quantity"))})
    probes = v.episode.withColumn("upto", F.date_add("conception", 91))
    found = timeline.last_event(probes, weight, PERSON, "upto", "day", ["ounces"])
    w = F.when(F.col("last_day") > F.date_sub("conception", 365), F.col("last_ounces"))
    df = found.join(height, PERSON, "left").withColumn("weight", w)
    return df.select(*EPISODE, F.round("height", 4).alias("height"), F.round("weight", 4).alias("weight"),
                     F.round(bmi_from(F.col("weight"), F.col("height")), 4).alias("bmi"))


@query("join_range_hint", sql("SELECT pat_id, instance, segment, count(*) AS n FROM person JOIN episode USING (pat_id, instance) GROUP BY ALL", "person", "episode"))
def join_range_hint(v):
    """The hint applied to an equi join has no effect on Spark, so it is left out."""
    return v.person.join(v.episode, PERSON).groupBy(*PERSON, "segment").agg(count_rows())


@query("join_multi_key_fanin", sql("""SELECT pat_id, instance, day, n_dx, n_tests, n_orders FROM (SELECT pat_id, instance, dx_date AS day, count(*) AS n_dx FROM dx GROUP BY ALL) a
  FULL JOIN (SELECT pat_id, instance, test_date AS day, count(*) AS n_tests FROM test GROUP BY ALL) b USING (pat_id, instance, day)
  FULL JOIN (SELECT pat_id, instance, delivery AS day, count(*) AS n_orders FROM episode GROUP BY ALL) c USING (pat_id, instance, day)""", "dx", "test", "episode"))
def join_multi_key_fanin(v):
    def per(df, day, name):
        return df.groupBy(*PERSON, F.col(day).alias("day")).agg(F.count(F.lit(1)).alias(name))
    return joins.spine_join([per(v.dx, "dx_date", "n_dx"), per(v.test, "test_date", "n_tests"), per(v.episode, "delivery", "n_orders")], [*PERSON, "day"])


@query("join_mother_child", """WITH b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'Pregnancy' ELSE 'Delivery' END AS type,
  o_orderkey - o_orderkey % 3 AS parent_id, CAST(o_orderdate AS DATE) AS day FROM orders)
  SELECT p.id, p.day, c.id AS child_id, c.day AS child_day, s.n_lines FROM b p LEFT JOIN b c ON c.parent_id = p.id AND c.type = 'Delivery'
  LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) s ON s.l_orderkey = c.id WHERE p.type = 'Pregnancy'""")
def join_mother_child(v):
    key = F.col("o_orderkey")
    blocks = v.t("orders").select(key.alias("id"), F.when(key % 3 == 0, "Pregnancy").otherwise("Delivery").alias("type"),
                                  (key - key % 3).alias("parent_id"), F.to_date("o_orderdate").alias("day"))
    pairs = joins.parent_child(blocks, "type", "Pregnancy", "Delivery", "id", "parent_id", ["day"])
    lines = v.t("lineitem").groupBy(F.col("l_orderkey").alias("child_id")).agg(F.count(F.lit(1)).alias("n_lines"))
    return pairs.join(lines, "child_id", "left").select("id", "day", "child_id", "child_day", "n_lines")


def coverage_tables(v):
    """person -> account -> coverage tables: an order is an account, its lines carry coverages."""
    pa = v.t("orders").select(F.col("o_custkey").alias("pat_id"), v._instance("o_custkey"), F.col("o_orderkey").alias("account_id"),
                              F.when(F.col("o_orderkey") % 11 != 0, "Self").alias("relationship"))
    acc = v.t("orders").select(F.col("o_orderkey").alias("account_id"), v._instance("o_custkey"),
                               F.when(F.col("o_orderstatus") != "P", "Personal/Family").otherwise("Workers Comp").alias("type"),
                               F.when(F.col("o_orderpriority") == "1-URGENT", "Medicaid").when(F.col("o_orderpriority") == "2-HIGH", "Commercial")
                               .when(F.col("o_orderpriority") == "3-MEDIUM", "OTHER GOVERNMENT").when(F.col("o_orderpriority") == "5-LOW", "Self-pay").alias("financial_class"))
    ac = v.line.select(F.col("l_orderkey").alias("account_id"), "instance", F.col("l_suppkey").alias("coverage_id")).distinct()
    cov = v.t("supplier").select(F.col("s_suppkey").alias("coverage_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("instance"),
                                 F.when(F.col("s_suppkey") % 5 == 0, "Medi-Cal plan").when(F.col("s_suppkey") % 5 == 1, "MEDICARE A")
                                 .when(F.col("s_suppkey") % 5 == 2, "Victims fund").when(F.col("s_suppkey") % 5 == 3, "Blue Plan").alias("payor"))
    return pa, acc, ac, cov


CHAIN = """chain AS (SELECT p.pat_id, p.instance, o_orderkey AS account_id, l_suppkey AS coverage_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Medicaid' WHEN '2-HIGH' THEN 'Commercial' WHEN '3-MEDIUM' THEN 'OTHER GOVERNMENT' WHEN '5-LOW' THEN 'Self-pay' END AS financial_class,
  CASE l_suppkey % 5 WHEN 0 THEN 'Medi-Cal plan' WHEN 1 THEN 'MEDICARE A' WHEN 2 THEN 'Victims fund' WHEN 3 THEN 'Blue Plan' END AS payor
  FROM person p JOIN orders ON o_custkey = p.pat_id LEFT JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_orderkey = o_orderkey
  WHERE o_orderkey % 11 <> 0 AND o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'))"""


@query("join_chain_insurance", sql("SELECT pat_id, instance, account_id, coverage_id, financial_class, payor FROM chain", "person", extra=CHAIN))
def join_chain_insurance(v):
    chain = joins.coverage_chain(v.person.select(*PERSON), *coverage_tables(v))
    return chain.select(*PERSON, "account_id", "coverage_id", "financial_class", "payor")


def concept_tables(v):
    """Vocabulary tables from region and nation: every region is an ancestor of its nations."""
    region = v.t("region").select((F.col("r_regionkey") + 1000).cast("bigint").alias("concept_id"), F.concat(F.lit("R"), "r_regionkey").alias("concept_code"),
                                  F.col("r_name").alias("concept_name"))
    nation = v.t("nation").select(F.col("n_nationkey").cast("bigint").alias("concept_id"), F.concat(F.lit("N"), "n_nationkey").alias("concept_code"),
                                  F.col("n_name").alias("concept_name"))
    ancestor = v.t("nation").select((F.col("n_regionkey") + 1000).cast("bigint").alias("ancestor_concept_id"),
                                    F.col("n_nationkey").cast("bigint").alias("descendant_concept_id"))
    mapping = v.t("supplier").select(F.col("s_suppkey").alias("value"), (F.col("s_suppkey") % 3 + 1).cast("int").alias("instance"),
                                     F.concat(F.lit("NAT#N"), "s_nationkey").alias("concept"))
    return region.unionByName(nation), ancestor, mapping


def label_codes(v):
    """Two labels over the vocabulary: one by region code, one by nation code."""
    return v.t("region").select(F.when(F.col("r_regionkey") < 2, "west").otherwise("east").alias("label"), F.concat(F.lit("R"), "r_regionkey").alias("code")).unionByName(
        v.t("nation").where("n_nationkey = 7").select(F.lit("west").alias("label"), F.concat(F.lit("N"), "n_nationkey").alias("code")))


CODES = """codes AS (SELECT CASE WHEN r_regionkey < 2 THEN 'west' ELSE 'east' END AS label, 'R' || r_regionkey AS code, r_name AS name FROM region
  UNION SELECT CASE WHEN n_regionkey < 2 THEN 'west' ELSE 'east' END, 'N' || n_nationkey, n_name FROM nation
  UNION SELECT 'west', 'N7', n_name FROM nation WHERE n_nationkey = 7)"""


@query("join_hierarchy_expand", sql("SELECT DISTINCT label, code FROM codes", extra=CODES))
def join_hierarchy_expand(v):
    concept, ancestor, _ = concept_tables(v)
    return concepts.expand_by_hierarchy(label_codes(v), concept, ancestor)


# Nations related by their suppliers' numbers: a relation with loops and in both directions, unlike the hierarchy.
RELATED = """start AS (SELECT CASE WHEN r_regionkey < 2 THEN 'west' ELSE 'east' END AS label, 'R' || r_regionkey AS code FROM region UNION SELECT 'west', 'N' || n_nationkey FROM nation WHERE n_nationkey = 7),
  codes AS (SELECT label, code FROM start UNION SELECT label, 'N' || to_nation FROM start JOIN (SELECT 'N' || s_nationkey AS code, s_suppkey % 25 AS to_nation FROM supplier UNION ALL SELECT 'R' || s_nationkey % 5, s_nationkey FROM supplier WHERE s_suppkey % 2 = 0) USING (code))"""


@query("join_relationship_expand", sql("SELECT DISTINCT label, code FROM codes", extra=RELATED))
def join_relationship_expand(v):
    """Codes one relation away. Suppliers relate their nation to another one, and every other supplier a region to a nation of any region."""
    concept, _, _ = concept_tables(v)
    s = v.t("supplier")
    nation, other = F.col("s_nationkey").cast("bigint"), (F.col("s_suppkey") % 25).cast("bigint")
    relation = s.select(nation.alias("concept_id_1"), other.alias("concept_id_2")).unionByName(
        s.where("s_suppkey % 2 = 0").select((nation % 5 + 1000).alias("concept_id_1"), nation.alias("concept_id_2")))
    return concepts.expand_by_relationship(label_codes(v), concept, relation)


@query("join_geo", sql("""SELECT pat_id, instance, svi FROM person LEFT JOIN (SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS fips,
  CASE WHEN n_regionkey <> 2 THEN '0.' || n_nationkey END AS svi FROM nation) ON fips = lpad(CAST(nation AS VARCHAR), 5, '0')""", "person"))
def join_geo(v):
    home = v.person.select(*PERSON, F.concat(F.lpad(F.col("nation").cast("string"), 5, "0"), F.lit("1234567")).alias("block_group"),
                           F.lit("98101-0001").alias("zip"), F.lit("WA").alias("state"))
    geo = v.t("nation").select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("fips"),
                               F.when(F.col("n_regionkey") == 2, "-999.0").otherwise(F.concat(F.lit("0."), "n_nationkey")).alias("svi"))
    return joins.add_geography(v.person.select(*PERSON), home, geo, "fips", "county")


# ---- windows -----------------------------------------------------------------------------------------------------


@query("window_full_partition", """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total,
  count(*) OVER (PARTITION BY o_custkey) AS n FROM orders""")
def window_full_partition(v):
    """A whole-partition aggregate on every row, as an aggregate joined back (a hot person is not sorted in one task)."""
    per = v.t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), count_rows())
    return v.t("orders").join(per, "o_custkey").select("o_orderkey", F.round("total", 2).alias("total"), "n")


@query("window_first_last", """SELECT o_custkey, first(o_orderstatus ORDER BY o_orderdate, o_orderkey) AS first_status,
  last(o_orderstatus ORDER BY o_orderdate, o_orderkey) AS last_status FROM orders GROUP BY 1""")
def window_first_last(v):
    at = F.struct("o_orderdate", "o_orderkey")
    return v.t("orders").groupBy("o_custkey").agg(F.min_by("o_orderstatus", at).alias("first_status"), F.max_by("o_orderstatus", at).alias("last_status"))


@query("window_row_number", """SELECT o_orderdate_day, o_orderpriority, n, row_number() OVER (ORDER BY o_orderdate_day, o_orderpriority) AS row_id FROM (
  SELECT CAST(o_orderdate AS DATE) AS o_orderdate_day, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)""")
def window_row_number(v):
    """Global row numbers over grouped values, without a single-partition window."""
    counted = v.t("orders").groupBy(F.to_date("o_orderdate").alias("o_orderdate_day"), "o_orderpriority").agg(count_rows())
    return ranked(counted, [], ["o_orderdate_day", "o_orderpriority"], "row_id")


@query("window_label_max", """WITH m AS (SELECT *, max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS ever,
  max(o_orderkey) OVER (PARTITION BY o_custkey) AS latest FROM orders) SELECT o_custkey, o_orderkey, o_totalprice, ever FROM m WHERE o_orderkey = latest""")
def window_label_max(v):
    df = v.t("orders").withColumn("y", (F.col("o_orderstatus") == "P").cast("int"))
    ever = df.groupBy("o_custkey").agg(F.max("y").alias("ever"), F.max_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("r"))
    return ever.select("o_custkey", "r.o_orderkey", "r.o_totalprice", "ever")


@query("window_latest_row", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey DESC) = 1""")
def window_latest_row(v):
    return features.latest_row(v.t("orders"), ["o_custkey"], ["o_orderpriority", "o_totalprice", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("window_earliest_test", sql("""SELECT pat_id, instance, test_date, result FROM test QUALIFY row_number() OVER (PARTITION BY pat_id, instance
  ORDER BY test_date, result) = 1""", "test"))
def window_earliest_test(v):
    return features.latest_row(v.test, PERSON, ["test_date", "result"], ["test_date", "result"], last=False)


@query("window_nth_distinct", sql("SELECT pat_id, instance, n_doses, first_date, second_date, third_date, first_product, second_product FROM history", "history"))
def window_nth_distinct(v):
    return cohorts.exposure_history(v.dose).select(*PERSON, "n_doses", "first_date", "second_date", "third_date", "first_product", "second_product")


# ---- order, sampling, sets ---------------------------------------------------------------------------------------


@query("sort_multi", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def sort_multi(v):
    return v.t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")


@query("limit_random", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('611:' || o_orderkey), o_orderkey LIMIT 500")
def limit_random(v, n: int = 500, seed: int = 611):
    """A reproducible random sample of n rows: ordered by a seeded hash of the key."""
    return v.t("orders").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("o_orderkey").cast("string"))), "o_orderkey").limit(n).select("o_orderkey", "o_custkey")


@query("sample_shuffle_split", "SELECT o_orderkey, CAST('0x' || substr(md5('0:' || o_orderkey), 1, 8) AS UBIGINT) / 4294967296.0 < 0.2 AS is_test FROM orders")
def sample_shuffle_split(v):
    return models.split_by_hash(v.t("orders").select("o_orderkey"), "o_orderkey")


@query("dedup_keys", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_partkey, l_suppkey, l_shipdate) = 1""")
def dedup_keys(v):
    return features.latest_row(v.t("lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate"], ["l_partkey", "l_suppkey"], last=False)


@query("topk_first_by_rank", sql("""SELECT pat_id, instance, split_part(min(CASE financial_class WHEN 'Medicaid' THEN '1_Medicaid' WHEN 'Commercial' THEN '3_Commercial'
  WHEN 'Self-pay' THEN '4_Uninsured-Self-Pay' WHEN 'OTHER GOVERNMENT' THEN '5_Other-Government' END), '_', 2) AS label FROM chain GROUP BY ALL""", "person", extra=CHAIN))
def topk_first_by_rank(v):
    chain = joins.coverage_chain(v.person.select(*PERSON), *coverage_tables(v))
    best = chain.groupBy(*PERSON).agg(F.min(coverage_group(F.col("financial_class"))).alias("g"))
    return best.select(*PERSON, F.get(F.split("g", "_"), F.lit(1)).alias("label"))


@query("setop_union_distinct", sql("SELECT pat_id, instance FROM dose UNION SELECT pat_id, instance FROM positive", "dose", "positive"))
def setop_union_distinct(v):
    return v.dose.select(*PERSON).unionByName(v.positive.select(*PERSON)).distinct()


@query("setop_union_many", sql("""SELECT pat_id, dose_date AS day FROM dose UNION SELECT pat_id, test_date FROM test UNION SELECT pat_id, dx_date FROM dx
  UNION SELECT pat_id, delivery FROM episode""", "dose", "test", "dx", "episode"))
def setop_union_many(v):
    parts = [(v.dose, "dose_date"), (v.test, "test_date"), (v.dx, "dx_date"), (v.episode, "delivery")]
    return reduce(lambda a, b: a.unionByName(b), [d.select("pat_id", F.col(c).alias("day")) for d, c in parts]).distinct()


@query("setop_union_by_name", "SELECT o_custkey AS pat_id, o_totalprice AS price, NULL AS segment FROM orders UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")
def setop_union_by_name(v):
    a = v.t("orders").select(F.col("o_custkey").alias("pat_id"), F.col("o_totalprice").alias("price"))
    return a.unionByName(v.t("customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("pat_id")), allowMissingColumns=True)


@query("setop_complement", sql("""SELECT pat_id, instance, CASE WHEN (pat_id, instance) IN (SELECT pat_id, instance FROM positive) THEN 1 ELSE 0 END AS infected
  FROM person""", "person", "positive"))
def setop_complement(v):
    return joins.with_flag(v.person.select(*PERSON), v.positive, PERSON, "infected")
