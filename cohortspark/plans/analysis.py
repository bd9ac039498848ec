"""Matching, survival, statistics and model queries."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from cohortspark.functions import categories as cat
from cohortspark.functions.dates import age_years
from cohortspark.functions.strings import coverage_group
from cohortspark.operators import cohorts, encoders, matching, models, stats, survival
from cohortspark.operators.cohorts import PERSON
from cohortspark.plans.aggregates import answer
from cohortspark.plans.clinical import infections, states
from cohortspark.plans.registry import query
from cohortspark.plans.relational import EPISODE
from cohortspark.session import durable, scratch_path
from cohortspark.sources.views import sql, state_sql

COVARIATES = ["balance", "age", "n_episodes", "nation"]


def _integral(f: str, upper: str) -> str:
    """SQL for the integral of f(``{x}``) from 0 to ``upper`` by Simpson's rule."""
    weight = "CASE WHEN k_ IN (0, 2000) THEN 1 WHEN k_ % 2 = 1 THEN 4 ELSE 2 END"
    return f"list_sum(list_transform(range(0, 2001), lambda k_: ({weight}) * {f.format(x=f'({upper} * k_ / 2000)')})) * {upper} / 6000"


def _t_tail(t: str, df: str) -> str:
    area = _integral(f"pow(1 + pow({{x}}, 2) / {df}, -({df} + 1) / 2)", f"abs({t})")
    return f"greatest(1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) * {area}, 0)"


def _chi_tail(x: str, df: str) -> str:
    area = _integral(f"pow({{x}}, {df} - 1) * exp(-pow({{x}}, 2) / 2)", f"least(sqrt({x}), 45)")
    return f"greatest(1 - 2 * exp(-{df} / 2 * ln(2) - lgamma({df} / 2)) * {area}, 0)"


def _tested(body: str, p: str, stat: str, digits: int = 6) -> str:
    """``body`` with its statistic rounded only after the p-value was taken from it."""
    return f"SELECT * REPLACE (round({stat}, {digits}) AS {stat}), round({p}, 6) AS p_value FROM ({body})"


def people(v):
    """Person rows with the treatment flag (any dose) and covariates."""
    n = v.episode.groupBy(*PERSON).agg(F.count(F.lit(1)).alias("n_episodes"))
    dosed = v.dose.select(*PERSON).distinct().withColumn("treated", F.lit(1))
    df = v.person.join(n, PERSON, "left").join(dosed, PERSON, "left")
    age = age_years(F.col("birth_date"), F.to_date(F.lit("2000-01-01")))
    return df.select(*PERSON, F.coalesce("treated", F.lit(0)).alias("treated"), "balance", age.alias("age"),
                     F.coalesce("n_episodes", F.lit(0)).cast("double").alias("n_episodes"), F.col("nation").cast("double").alias("nation"))


PEOPLE = """people AS (SELECT pat_id, instance, CASE WHEN (pat_id, instance) IN (SELECT pat_id, instance FROM dose) THEN 1 ELSE 0 END AS treated, balance,
  round(date_diff('day', birth_date, DATE '2000-01-01') / 365.25, 1) AS age, CAST((SELECT count(*) FROM episode e WHERE e.pat_id = p.pat_id) AS DOUBLE) AS n_episodes,
  CAST(nation AS DOUBLE) AS nation FROM person p)"""

_TRAIN = "CAST('0x' || substr(md5('0:' || pat_id), 1, 8) AS BIGINT) / 4294967296 >= 0.2"


def _margin(x: str) -> str:
    return f"(b[1] + b[2] * {x}balance + b[3] * {x}age + b[4] * {x}n_episodes + b[5] * {x}nation)"


def _logistic_ctes(rows: str, seen: str = "people", steps: int = 800) -> str:
    """CTEs ``z`` (the rows of ``seen``, covariates on the scale of those of ``rows``) and ``fit`` (b: intercept, coefficients).

    ``rows`` has columns g (the model), w and those of people. Every model climbs by gradient steps until nothing changes.
    """
    names = ("balance", "age", "n_episodes", "nation")
    scale = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in names)
    scaled = lambda t: ", ".join(f"({t}.{c} - m_{c}) / s_{c} AS {c}" for c in names)
    up = ", ".join(f"any_value(b[{k}]) + 4 * sum(r{x}) / sum(w)" for k, x in enumerate(["", *[f" * {c}" for c in names]], 1))
    return f"""lr_rows AS MATERIALIZED ({rows}), lr_scale AS MATERIALIZED (SELECT g, {scale} FROM lr_rows GROUP BY g),
  lr_x AS MATERIALIZED (SELECT r.g, r.w, r.treated, {scaled('r')} FROM lr_rows r JOIN lr_scale USING (g)),
  lr_step AS (SELECT g, 0 AS i, [0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS b FROM lr_scale
    UNION ALL SELECT g, any_value(i) + 1, [{up}] FROM (SELECT x.*, i, b, w * (treated - 1 / (1 + exp(-{_margin('x.')}))) AS r FROM lr_step JOIN lr_x x USING (g) WHERE i < {steps}) GROUP BY g),
  fit AS MATERIALIZED (SELECT g, b FROM lr_step WHERE i = {steps}),
  z AS MATERIALIZED (SELECT pat_id, treated, g, {scaled('p')} FROM {seen} p CROSS JOIN lr_scale)"""


def _recursive(text: str) -> str:
    return text.replace("WITH", "WITH RECURSIVE", 1)


_PROPENSITY = PEOPLE + ", " + _logistic_ctes("""SELECT 0 AS g, p.*, n / (2 * CASE WHEN treated = 1 THEN t ELSE n - t END) AS w FROM people p, (SELECT sum(treated) AS t, count(*) AS n FROM people)""") + \
    f", scored AS MATERIALIZED (SELECT pat_id, treated, {_margin('')} AS logit FROM z JOIN fit USING (g))"
_TRAINED = PEOPLE + ", " + _logistic_ctes(f"SELECT 0 AS g, p.*, CASE WHEN treated = 1 THEN 0.4 ELSE 0.6 END AS w FROM people p WHERE {_TRAIN}", f"(SELECT * FROM people WHERE NOT ({_TRAIN}))")
_PEOPLE_VIEWS = ("person", "episode", "dose")

# ---- matching ----------------------------------------------------------------------------------------------------


@query("match_feature_frame", sql("""WITH x AS (SELECT pat_id, treated, CASE WHEN balance > 0 THEN balance END AS balance, 1 - nation / 25 AS nation, CASE WHEN n_episodes > 3 THEN n_episodes END AS n_episodes FROM people),
  m AS (SELECT median(balance) AS mb FROM x) SELECT pat_id, treated, coalesce(balance, mb) AS balance, round(nation, 8) AS nation, coalesce(n_episodes, 0) AS n_episodes FROM x, m""",
                                  "person", "episode", "dose", extra=PEOPLE).replace(") WITH x AS", "), x AS", 1))
def match_feature_frame(v):
    df = people(v).select("pat_id", "treated", F.when(F.col("balance") > 0, F.col("balance")).alias("balance"), (F.col("nation") / 25).alias("nation"),
                          F.when(F.col("n_episodes") > 3, F.col("n_episodes")).alias("n_episodes"))
    return matching.feature_frame(df, ["balance"], ["nation"]).withColumn("nation", F.round("nation", 8))


# The covariates of an episode, by name: how SQL says them, and the values the encoder finds, the most frequent of which are not known beforehand.
_ENCODED = {
    "race": ("['White or Caucasian', 'Asian', 'Black or African American', 'Other', 'Unknown', 'American Indian or Alaska Native'][episode_id % 6 + 1]",
             ["White or Caucasian", "Asian", "Black or African American", "Other", "Unknown", "American Indian or Alaska Native"]),
    "ethnicity": ("CASE episode_id % 5 WHEN 0 THEN 'Hispanic or Latino' WHEN 1 THEN 'Not Hispanic or Latino' WHEN 2 THEN 'Not Hispanic or Latino' ELSE 'Unknown' END", ["Hispanic or Latino", "Not Hispanic or Latino", "Unknown"]),
    "method": ("CASE episode_id % 4 WHEN 0 THEN 'Vaginal' WHEN 1 THEN 'C-Section' END", ["Vaginal", "C-Section"]),
    "insurance": ("['1_Medicaid', '2_Medicare', '3_Commercial', '4_Uninsured-Self-Pay', '7_Uninsured', '6_Other', NULL][episode_id % 7 + 1]",
                  ["1_Medicaid", "2_Medicare", "3_Commercial", "4_Uninsured-Self-Pay", "7_Uninsured", "6_Other"]),
    "ruca": ("CASE WHEN nation < 4 THEN 'Metropolitan' WHEN nation < 7 THEN 'Micropolitan' WHEN nation < 10 THEN 'SmallTown' ELSE 'Rural' END", ["Metropolitan", "Micropolitan", "SmallTown", "Rural"]),
    "timing": ("CASE WHEN d IS NULL THEN NULL WHEN d < 0 THEN 'before' WHEN d <= 90 THEN '1st trimester' WHEN d <= 181 THEN '2nd trimester' ELSE '3rd trimester' END", ["before", "1st trimester", "2nd trimester", "3rd trimester"]),
}


def _encoded_sql() -> str:
    cells = []
    for c, (_, domain) in _ENCODED.items():
        listed = ", ".join(f"'{d}'" for d in domain)
        cells += [f"CAST(coalesce({c} = '{d}', false) AS INTEGER) AS {c}_{encoders.slug(d)}" for d in domain]
        cells += [f"CAST(coalesce({c} NOT IN ({listed}), false) AS INTEGER) AS {c}_unseen", f"CAST({c} IS NULL AS INTEGER) AS {c}_missing"]
    said = ", ".join(f"{text} AS {c}" for c, (text, _) in _ENCODED.items())
    return f"""SELECT episode_id, treated, parity, {', '.join(cells)} FROM (SELECT episode_id, CASE WHEN state IN ('full', 'boosted') THEN 1 ELSE 0 END AS treated, count(*) OVER (PARTITION BY pat_id)::BIGINT AS parity, {said}
      FROM (SELECT s.*, p.nation, date_diff('day', conception, full_date) AS d FROM state s JOIN person p ON p.pat_id = s.pat_id))"""


def covariate_frame(v):
    """Episodes with the exposure and their covariates as categories: race, ethnicity, delivery method, insurance, place and timing."""
    s = states(v).join(v.person.select(*PERSON, "nation"), PERSON)
    n = v.episode.groupBy(*PERSON).agg(F.count(F.lit(1)).alias("parity"))
    day = F.datediff("full_date", "conception")
    return s.join(n, PERSON).select(
        "episode_id", F.col("state").isin("full", "boosted").cast("int").alias("treated"), "parity", cat.race_simple(F.array(answer("race"))).alias("race"),
        cat.ethnicity(answer("ethnicity")).alias("ethnicity"), cat.delivery_method_group(answer("method")).alias("method"), coverage_group(answer("payer")).alias("insurance"),
        cat.ruca(F.col("nation")).alias("ruca"), F.when(day < 0, "before").when(day <= 90, "1st trimester").when(day <= 181, "2nd trimester").when(day > 181, "3rd trimester").alias("timing"))


@query("match_covariate_frame", sql(_encoded_sql(), "person", "episode", "history", extra=state_sql("episode", "delivery")))
def match_covariate_frame(v):
    """All covariates one-hot by an encoder that was fitted on four fifths of the episodes, stored, and read again."""
    frame = durable(covariate_frame(v))
    path = scratch_path(v.spark, "encoder")
    encoders.save(encoders.fit(models.split_by_hash(frame, "episode_id").where("not is_test"), list(_ENCODED)), path)
    return encoders.one_hot(frame, encoders.load(v.spark, path), list(_ENCODED))


@query("match_propensity_score", _recursive(sql("SELECT pat_id, treated, round(1 / (1 + exp(-logit)), 4) AS propensity, round(logit, 4) AS logit FROM scored", *_PEOPLE_VIEWS, extra=_PROPENSITY)))
def match_propensity_score(v):
    df = matching.propensity(people(v), "treated", COVARIATES)
    return df.select("pat_id", "treated", F.round("propensity", 4).alias("propensity"), F.round("logit", 4).alias("logit"))


# Rounds over all pairs inside the caliper: those that are the closest for both sides are taken, and their people leave.
_CLOSEST = """picks AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY gap, c) = 1 AND row_number() OVER (PARTITION BY c ORDER BY gap, t) = 1 AS taken
    FROM (SELECT x.pat_id AS t, y.pat_id AS c, abs(x.logit - y.logit) AS gap FROM scored x JOIN scored y ON x.treated = 1 AND y.treated = 0 AND abs(x.logit - y.logit) <= 0.6)
  UNION ALL SELECT t, c, gap, row_number() OVER (PARTITION BY t ORDER BY gap, c) = 1 AND row_number() OVER (PARTITION BY c ORDER BY gap, t) = 1
    FROM (SELECT t, c, gap FROM (SELECT *, bool_or(taken) OVER (PARTITION BY t) OR bool_or(taken) OVER (PARTITION BY c) AS gone FROM picks) WHERE NOT gone))"""


@query("match_caliper_1to1", _recursive(sql("SELECT t AS treated_id, c AS control_id, round(gap, 5) AS distance FROM picks WHERE taken", *_PEOPLE_VIEWS, extra=f"{_PROPENSITY}, {_CLOSEST}")))
def match_caliper_1to1(v):
    """Pairs within 0.6 on the propensity logit; each person at most once."""
    scored = matching.propensity(people(v), "treated", COVARIATES)
    return matching.match_one_to_one(scored, "pat_id", "treated", "logit", 0.6).withColumn("distance", F.round("distance", 5))


@query("match_effect_size", sql("""SELECT c AS covariate, round(avg(x) FILTER (treated = 1), 6) AS mean_1, round(avg(x) FILTER (treated = 0), 6) AS mean_0,
  round((avg(x) FILTER (treated = 1) - avg(x) FILTER (treated = 0)) / sqrt((var_samp(x) FILTER (treated = 1) + var_samp(x) FILTER (treated = 0)) / 2), 6) AS smd
  FROM people UNPIVOT (x FOR c IN (balance, age, n_episodes, nation)) GROUP BY 1""", "person", "episode", "dose", extra=PEOPLE))
def match_effect_size(v):
    df = matching.effect_sizes(people(v), "treated", COVARIATES)
    return df.withColumns({c: F.round(c, 6) for c in ("mean_1", "mean_0", "smd")})


_Z = """z AS (SELECT pat_id, treated, (balance - avg(balance) OVER ()) / stddev_samp(balance) OVER () AS a, (age - avg(age) OVER ()) / stddev_samp(age) OVER () AS b,
  (n_episodes - avg(n_episodes) OVER ()) / stddev_samp(n_episodes) OVER () AS c, (nation - avg(nation) OVER ()) / stddev_samp(nation) OVER () AS d FROM people)"""


@query("match_knn_euclidean", sql("""SELECT treated_id, control_id, round(dist, 5) AS distance, CAST(rn AS INTEGER) AS place FROM (SELECT t.pat_id AS treated_id, k.pat_id AS control_id,
  sqrt((t.a - k.a) ** 2 + (t.b - k.b) ** 2 + (t.c - k.c) ** 2 + (t.d - k.d) ** 2) AS dist, row_number() OVER (PARTITION BY t.pat_id ORDER BY
  sqrt((t.a - k.a) ** 2 + (t.b - k.b) ** 2 + (t.c - k.c) ** 2 + (t.d - k.d) ** 2), k.pat_id) AS rn FROM z t, z k WHERE t.treated = 1 AND k.treated = 0) WHERE rn <= 2""",
                                  "person", "episode", "dose", extra=PEOPLE + ", " + _Z))
def match_knn_euclidean(v):
    df = matching.nearest_controls(people(v), "pat_id", "treated", COVARIATES, n=2)
    return df.withColumn("distance", F.round("distance", 5))


def _risk_set_sql(shifts: tuple[int, ...]) -> str:
    """The rule tried out: for every start day each number of pairs k is tested rank by rank, and the largest is kept; a draw's
    place is followed back move by move."""
    steps = ["""c0 AS MATERIALIZED (SELECT episode_id AS case_id, conception AS case_start, full_date AS index_date FROM state WHERE full_date IS NOT NULL AND full_date >= conception),
      p0 AS MATERIALIZED (SELECT episode_id AS control_id, conception AS d, delivery AS stop FROM state WHERE state IN ('never', 'later'))"""]
    for n, shift in enumerate(shifts):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY d ORDER BY stop, md5(CAST(case_id AS VARCHAR)), case_id) AS i FROM (SELECT *, case_start + ({shift}) AS d, index_date + 182 AS stop FROM c{n}) WHERE d <= index_date),
      b{n} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY d ORDER BY stop DESC, md5(CAST(control_id AS VARCHAR)), control_id) AS j FROM p{n}),
      k{n} AS MATERIALIZED (SELECT d, max(k) AS k FROM (SELECT q.d, q.i AS k FROM a{n} q JOIN a{n} a ON a.d = q.d AND a.i <= q.i JOIN b{n} b ON b.d = q.d AND b.j = q.i + 1 - a.i
        GROUP BY q.d, q.i HAVING count(*) FILTER (a.stop <= b.stop) = q.i) GROUP BY d),
      s{n} AS MATERIALIZED (SELECT d, case_id, q, q + CAST(floor(u * (ends - q + 1)) AS BIGINT) AS p FROM (SELECT a.d, a.case_id, k + 1 - a.i AS q,
        CAST(CAST('0x' || substr(md5('0:' || CAST(a.case_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u,
        (SELECT count(*) FROM b{n} b WHERE b.d = a.d AND b.stop >= a.stop) AS ends FROM a{n} a JOIN k{n} k ON k.d = a.d AND a.i <= k.k)),
      f{n} AS (SELECT d, q, p AS spot, q AS t FROM s{n} UNION ALL SELECT f.d, f.q, max(s.q), max(s.q) FROM f{n} f JOIN s{n} s ON s.d = f.d AND s.p = f.spot AND s.q < f.t GROUP BY f.d, f.q, f.spot, f.t),
      m{n} AS MATERIALIZED (SELECT s.case_id, b.control_id, s.d AS control_start FROM s{n} s JOIN (SELECT d, q, arg_min(spot, t) AS spot FROM f{n} GROUP BY d, q) f ON f.d = s.d AND f.q = s.q JOIN b{n} b ON b.d = s.d AND b.j = f.spot),
      c{n + 1} AS MATERIALIZED (SELECT * FROM c{n} ANTI JOIN m{n} USING (case_id)), p{n + 1} AS MATERIALIZED (SELECT * FROM p{n} ANTI JOIN m{n} USING (control_id))""")
    pairs = " UNION ALL ".join(f"SELECT * FROM m{n}" for n in range(len(shifts)))
    return _recursive(sql(f"SELECT case_id, control_id, index_date, case_start, control_start FROM c0 LEFT JOIN ({pairs}) m USING (case_id)",
                          "episode", "history", extra=", ".join([state_sql("episode", "delivery"), *steps])))


def _risk_set(v, max_shift=None):
    s = states(v)
    cases = s.where("full_date is not null and full_date >= conception").select("episode_id", "conception", "full_date")
    pool = s.where("state in ('never', 'later')").select("episode_id", "conception", "delivery")
    return matching.match_risk_set(cases, pool, "episode_id", "conception", "delivery", "full_date", horizon=182, max_shift=max_shift)


@query("match_risk_set")
def match_risk_set(v):
    """Fully exposed episodes against never-exposed ones of the nearest conception day, drawn at random, until no control is left
    that a case could take. How far the days go is not known beforehand, so SQL checks the first three in the next query."""
    return _risk_set(v)


@query("match_risk_set_caliper", _risk_set_sql((0, -1, 1)))
def match_risk_set_caliper(v):
    """The same with conception days at most one day apart; cases without such a control have nulls."""
    return _risk_set(v, 1)


# ---- survival ----------------------------------------------------------------------------------------------------


def survival_frame(v):
    df = states(v).where("full_date is not null and full_date >= conception").select(*EPISODE, "conception", "delivery", "full_date", "state")
    return survival.censor_frame(df, v.positive, PERSON, "full_date", cutoff="2001-12-31")


SURV = state_sql("episode", "delivery") + """, surv AS (SELECT pat_id, instance, episode_id, conception, full_date, state, CASE WHEN d < 182 THEN 1 ELSE 0 END AS event,
  CAST(CASE WHEN d < 182 THEN d ELSE 182 END AS INTEGER) AS time FROM (SELECT *, date_diff('day', full_date, (SELECT min(test_date) FROM positive p WHERE p.pat_id = s.pat_id AND p.instance = s.instance
  AND p.test_date > s.full_date)) AS d FROM state s WHERE full_date IS NOT NULL AND full_date >= conception))"""
_SV = ("episode", "history", "positive")


@query("surv_censor_frame", sql("""SELECT pat_id, instance, episode_id, time, event, CAST(date_diff('day', full_date, DATE '2001-12-31') AS INTEGER) AS days_since_start,
  CAST(date_diff('day', conception, full_date) AS INTEGER) AS gest_age_at_start FROM surv""", *_SV, extra=SURV))
def surv_censor_frame(v):
    return survival_frame(v).select(*EPISODE, "time", "event", "days_since_start", "gest_age_at_start")


@query("surv_kaplan_meier", sql("""SELECT state, time, at_risk, d, round(s, 8) AS survival, round(CASE WHEN s > 0 AND s < 1 THEN s * sqrt(v) ELSE 0 END, 8) AS std_error,
  round(CASE WHEN s > 0 AND s < 1 THEN exp(-exp(ln(-ln(s)) + 1.959963984540054 * sqrt(v) / -ln(s))) ELSE s END, 8) AS ci_low, round(CASE WHEN s > 0 AND s < 1 THEN exp(-exp(ln(-ln(s)) - 1.959963984540054 * sqrt(v) / -ln(s))) ELSE s END, 8) AS ci_high
  FROM (SELECT state, time, at_risk, d, product(1 - d / at_risk) OVER (PARTITION BY state ORDER BY time) AS s, sum(CASE WHEN at_risk > d THEN d / (CAST(at_risk AS DOUBLE) * (at_risk - d)) ELSE 0 END) OVER (PARTITION BY state ORDER BY time) AS v
  FROM (SELECT state, time, sum(event)::BIGINT AS d, sum(count(*)) OVER (PARTITION BY state ORDER BY time DESC)::BIGINT AS at_risk FROM surv GROUP BY 1, 2))""", *_SV, extra=SURV))
def surv_kaplan_meier(v):
    df = survival.kaplan_meier(survival_frame(v), "state")
    return df.withColumns({c: F.round(c, 8) for c in ("survival", "std_error", "ci_low", "ci_high")})


@query("surv_logrank", sql(_tested("""SELECT sum(d1)::BIGINT AS observed, round(sum(e), 6) AS expected, round(sum(vv), 6) AS variance, (sum(d1) - sum(e)) ** 2 / sum(vv) AS chi_square FROM (SELECT d1, d * n1 / n AS e,
  CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END AS vv FROM (SELECT time, sum(event) AS d, sum(event * g) AS d1, CAST(sum(count(*)) OVER (ORDER BY time DESC) AS DOUBLE) AS n,
  CAST(sum(sum(g)) OVER (ORDER BY time DESC) AS DOUBLE) AS n1 FROM (SELECT *, CASE WHEN state = 'boosted' THEN 1 ELSE 0 END AS g FROM surv) GROUP BY 1))""", _chi_tail("chi_square", "1"), "chi_square"), *_SV, extra=SURV))
def surv_logrank(v):
    df = survival_frame(v).withColumn("g", (F.col("state") == "boosted").cast("int"))
    return survival.logrank(df, "g").withColumns({c: F.round(c, 6) for c in ("expected", "variance", "chi_square", "p_value")})


# ---- tables ------------------------------------------------------------------------------------------------------

INF = state_sql("infection", "delivery")


def exposed_infected(v):
    return cohorts.exposure_state(infections(v), cohorts.exposure_history(v.dose)).withColumn("infected", F.col("infection_date").isNotNull().cast("int")).withColumn(
        "exposed", F.col("state").isin("full", "boosted").cast("int"))



@query("stat_fisher_2x2", sql("""SELECT a, b, c, d, round(CAST(a * d AS DOUBLE) / (b * c), 6) AS odds_ratio, (SELECT round(least(sum(CASE WHEN lp <= lo + 1e-7 THEN exp(lp - lm) ELSE 0 END) / sum(exp(lp - lm)), 1), 6) FROM (
  SELECT lp, max(lp) OVER () AS lm, max(CASE WHEN k = a THEN lp END) OVER () AS lo FROM (SELECT k, -(lgamma(k + 1) + lgamma(a + b - k + 1) + lgamma(a + c - k + 1) + lgamma(d - a + k + 1)) AS lp
  FROM (SELECT CAST(unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS DOUBLE) AS k)))) AS p_value
  FROM (SELECT count(*) FILTER (x AND i) AS a, count(*) FILTER (x AND NOT i) AS b, count(*) FILTER (NOT x AND i) AS c, count(*) FILTER (NOT x AND NOT i) AS d
  FROM (SELECT state IN ('full', 'boosted') AS x, infection_date IS NOT NULL AS i FROM state))""", "infection", "history", extra=INF))
def stat_fisher_2x2(v):
    df = stats.fisher_2x2(exposed_infected(v), "exposed", "infected")
    return df.withColumns({c: F.round(c, 6) for c in ("odds_ratio", "p_value")})


@query("stat_fisher_rxc_mc")
def stat_fisher_rxc_mc(v):
    df = exposed_infected(v)
    return stats.fisher_simulated(stats.contingency(df, "infected", "state"), "infected", "state", 2000)


def _ln_ways(n: str, k: str) -> str:
    """SQL for ln of the number of ways to choose k of n."""
    return f"(lgamma({n} + 1.0::DOUBLE) - lgamma({k} + 1.0::DOUBLE) - lgamma({n} - ({k}) + 1.0::DOUBLE))"


# All tables of the five states: the first three columns are tried out, for the last two the weights of each sum are ordered and added up.
_FIVE = f""", t AS MATERIALIZED (SELECT n, x, row_number() OVER (ORDER BY n, state) AS j FROM (SELECT state, count(*) AS n, count(*) FILTER (infection_date IS NOT NULL) AS x FROM state GROUP BY 1)),
  o AS MATERIALIZED (SELECT sum(n)::BIGINT AS n, sum(x)::BIGINT AS x, sum(n) FILTER (j > 2)::BIGINT AS n3, sum(n) FILTER (j > 3)::BIGINT AS n2, sum({_ln_ways('n', 'x')}) AS lo FROM t),
  w AS MATERIALIZED (SELECT j, k, {_ln_ways('n', 'k')} AS w FROM (SELECT j, t.n, unnest(range(0, least(t.n, o.x) + 1)) AS k FROM t, o)),
  a2 AS MATERIALIZED (SELECT k, w FROM (SELECT p.k + q.k AS k, p.w + q.w AS w FROM w p JOIN w q ON p.j = 1 AND q.j = 2), o WHERE o.x - k BETWEEN 0 AND n3 AND CASE WHEN o.x - k BETWEEN 0 AND n3 THEN w + {_ln_ways('n3', 'o.x - k')} END > lo - 50),
  a3 AS MATERIALIZED (SELECT s, v.w, lo + 1e-7 - v.w AS room FROM (SELECT o.x - p.k - q.k AS s, p.w + q.w AS w FROM a2 p, o, w q WHERE q.j = 3) v, o WHERE s BETWEEN 0 AND n2 AND CASE WHEN s BETWEEN 0 AND n2 THEN v.w + {_ln_ways('n2', 's')} END > lo - 50),
  e AS MATERIALIZED (SELECT s, w, max(w) OVER (PARTITION BY s) AS top FROM (SELECT p.k + q.k AS s, p.w + q.w AS w FROM w p JOIN w q ON p.j = 4 AND q.j = 5) WHERE s <= (SELECT x FROM o)),
  f AS MATERIALIZED (SELECT s, w, top, sum(exp(w - top)) OVER (PARTITION BY s ORDER BY w) AS upto FROM e)"""


@query("stat_fisher_rxc_exact", sql(f"""SELECT round(least(sum(exp(a3.w + f.top - {_ln_ways('o.n', 'o.x')}) * upto), 1), 6) AS p_value, 'exact' AS method
  FROM a3 ASOF JOIN f ON a3.s = f.s AND a3.room >= f.w, o""", "infection", "history", extra=INF + _FIVE))
def stat_fisher_rxc_exact(v):
    """Infection by all five exposure states."""
    out = stats.fisher_exact(stats.contingency(exposed_infected(v), "infected", "state"), "infected", "state", digits=6)
    return out.select(F.round("p_value", 6).alias("p_value"), "method")


@query("stat_chi_square", sql(_tested("""SELECT sum((n - e) ** 2 / e) AS chi_square, (count(DISTINCT i) - 1) * (count(DISTINCT state) - 1) AS df, sum(n)::BIGINT AS n FROM (SELECT i, state, n,
  sum(n) OVER (PARTITION BY i) * sum(n) OVER (PARTITION BY state) / sum(n) OVER () AS e FROM (SELECT infection_date IS NOT NULL AS i, state, count(*) AS n FROM state GROUP BY 1, 2))""",
                                      _chi_tail("chi_square", "df"), "chi_square"), "infection", "history", extra=INF))
def stat_chi_square(v):
    df = stats.chi_square_independence(stats.contingency(exposed_infected(v), "infected", "state"), "infected", "state")
    return df.withColumns({c: F.round(c, 6) for c in ("chi_square", "p_value")})


@query("stat_chi_square_fit", _tested("""WITH o AS (SELECT l_returnflag AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), e AS (SELECT l_returnflag AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
  SELECT CASE WHEN count(*) FILTER (x IS NULL) = 0 THEN sum((coalesce(o.n, 0) - x) ** 2 / x) END AS chi_square, count(*) - 1 AS df FROM o FULL JOIN (SELECT k, n * (SELECT sum(n) FROM o) / (SELECT sum(n) FROM e) AS x FROM e) e USING (k)""",
                                      "CASE WHEN chi_square IS NOT NULL THEN " + _chi_tail("chi_square", "df") + " END", "chi_square"))
def stat_chi_square_fit(v):
    n = v.t("lineitem").groupBy("l_linestatus", F.col("l_returnflag").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    df = stats.chi_square_fit(n.where("l_linestatus = 'F'"), n.where("l_linestatus = 'O'"), "k")
    return df.withColumns({c: F.round(c, 6) for c in ("chi_square", "p_value")})


@query("stat_chi_square_features", _tested("""WITH x AS (SELECT unnest([{'f': 'priority', 'v': o_orderpriority}, {'f': 'month', 'v': strftime(o_orderdate, '%m')}]) AS u, o_orderstatus AS y FROM orders),
  c AS (SELECT u.f AS f, u.v AS v, y, count(*) AS n FROM x GROUP BY ALL), e AS (SELECT f, v, y, n, sum(n) OVER (PARTITION BY f, v) * sum(n) OVER (PARTITION BY f, y) / sum(n) OVER (PARTITION BY f) AS e FROM c)
  SELECT f AS feature, sum((n - e) ** 2 / e) AS chi_square, (count(DISTINCT v) - 1) * (count(DISTINCT y) - 1) AS df FROM e GROUP BY 1""", _chi_tail("chi_square", "df"), "chi_square"))
def stat_chi_square_features(v):
    df = v.t("orders").select(F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "MM").alias("month"), "o_orderstatus")
    return stats.chi_square_features(df, ["priority", "month"], "o_orderstatus").withColumns({c: F.round(c, 6) for c in ("chi_square", "p_value")})


# ---- samples -----------------------------------------------------------------------------------------------------


@query("stat_t_test", sql(_tested("""SELECT n1 AS n_1, n0 AS n_0, round(m1, 6) AS mean_1, round(m0, 6) AS mean_0, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1 / n1 + 1 / n0)) AS t, n1 + n0 - 2 AS df
  FROM (SELECT count(price) FILTER (i) AS n1, count(price) FILTER (NOT i) AS n0, avg(price) FILTER (i) AS m1, avg(price) FILTER (NOT i) AS m0, var_samp(price) FILTER (i) AS v1, var_samp(price) FILTER (NOT i) AS v0
  FROM (SELECT price, infection_date IS NOT NULL AS i FROM infection))""", _t_tail("t", "df"), "t"), "infection"))
def stat_t_test(v):
    df = infections(v).withColumn("g", F.col("infection_date").isNotNull().cast("int"))
    return stats.t_test(df, "g", F.col("price")).withColumns({c: F.round(c, 6) for c in ("mean_1", "mean_0", "t", "p_value")})


_RANK_SUMS = """SELECT {k}count(*) FILTER (i) AS n1, count(*) FILTER (NOT i) AS n0, coalesce(sum(r) FILTER (i), 0) - count(*) FILTER (i) * (count(*) FILTER (i) + 1) / 2 AS u, sum(CAST(t AS DOUBLE) * t - 1) AS tie
  FROM (SELECT {k}i, rank() OVER ({p} ORDER BY x) + (count(*) OVER ({p2} x) - 1) / 2 AS r, count(*) OVER ({p2} x) AS t FROM ranked_rows) {g}"""
_RANK_Z = "(u - n1 * n0 / 2 - sign(u - n1 * n0 / 2) * 0.5) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - tie / ((n1 + n0) * (n1 + n0 - 1))))"


@query("stat_mann_whitney", sql(_tested(f"""SELECT n1 AS n_1, n0 AS n_0, u, {_RANK_Z} AS z, CASE WHEN tie = 0 AND least(n1, n0) BETWEEN 1 AND 8 THEN 'exact' ELSE 'asymptotic' END AS method
  FROM ({_RANK_SUMS.format(k='', p='', p2='PARTITION BY', g='')})""", _chi_tail("(z * z)", "1"), "z"), "infection",
                                extra="ranked_rows AS (SELECT infection_date IS NOT NULL AS i, gest_days AS x FROM infection)"))
def stat_mann_whitney(v):
    df = infections(v).withColumn("g", F.col("infection_date").isNotNull().cast("int"))
    return stats.mann_whitney(df, "g", "gest_days").withColumns({c: F.round(c, 6) for c in ("z", "p_value")})


# Ways to deal ranks: with m more members in the first sample and n in the second, the largest rank goes to either one.
_WAYS = """ways AS (SELECT 0 AS m, 0 AS n, 0 AS u, 1.0::DOUBLE AS c
  UNION ALL SELECT m, n, u, sum(c) FROM (SELECT m + 1 AS m, n, u + n AS u, c FROM ways WHERE m < 8 AND m + n < 30 UNION ALL SELECT m, n + 1, u, c FROM ways WHERE m + n < 30) GROUP BY ALL)"""


@query("stat_mann_whitney_groups", _recursive(sql(f"""SELECT pat_id, n1 AS n_1, n0 AS n_0, u, round(z, 6) AS z, method, round(CASE WHEN method = 'exact' THEN least(2 * near / every, 1) WHEN z IS NOT NULL THEN {_chi_tail('(z * z)', '1')} END, 6) AS p_value FROM (
  SELECT *, (SELECT sum(c) FROM ways w WHERE w.m = least(s.n1, s.n0) AND w.n = greatest(s.n1, s.n0) AND w.u <= least(s.u, s.n1 * s.n0 - s.u)) AS near, (SELECT sum(c) FROM ways w WHERE w.m = least(s.n1, s.n0) AND w.n = greatest(s.n1, s.n0)) AS every,
    CASE WHEN tie = 0 AND least(n1, n0) BETWEEN 1 AND 8 THEN 'exact' ELSE 'asymptotic' END AS method,
    CASE WHEN n1 * n0 > 0 AND n1 + n0 + 1 > tie / ((n1 + n0) * (n1 + n0 - 1)) + 1e-9 THEN {_RANK_Z} END AS z FROM ({_RANK_SUMS.format(k='pat_id, ', p='PARTITION BY pat_id', p2='PARTITION BY pat_id,', g='GROUP BY pat_id')}) s)""",
    extra=f"{_WAYS}, ranked_rows AS (SELECT o_custkey AS pat_id, o_orderstatus = 'F' AS i, o_totalprice AS x FROM orders WHERE o_orderstatus IN ('F', 'O'))")))
def stat_mann_whitney_groups(v):
    """Closed against open orders' prices within every customer: samples of a few values, whose p-values are counted."""
    rows = v.t("orders").where("o_orderstatus IN ('F', 'O')").select(F.col("o_custkey").alias("pat_id"), (F.col("o_orderstatus") == "F").cast("int").alias("g"), "o_totalprice")
    return stats.mann_whitney(rows, "g", "o_totalprice", ["pat_id"]).withColumns({c: F.round(c, 6) for c in ("z", "p_value")})


_WILSON = "((p + z*z/(2*n) {0} z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n))"


@query("stat_wilson_ci", sql(f"""SELECT segment, n, n_events, round({_WILSON.format('-')}, 8) AS ci_low, round({_WILSON.format('+')}, 8) AS ci_high FROM (SELECT segment, count(*) AS n,
  count(death_date) AS n_events, count(death_date) / count(*) AS p, 1.959963984540054 AS z FROM person GROUP BY 1)""", "person"))
def stat_wilson_ci(v):
    n = v.person.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.count("death_date").alias("n_events"))
    low, high = stats.wilson(F.col("n_events"), F.col("n"))
    return n.select("segment", "n", "n_events", F.round(low, 8).alias("ci_low"), F.round(high, 8).alias("ci_high"))


@query("stat_protection_rate", sql(f"""SELECT state, n, n_protected, round(p, 8) AS rate, round({_WILSON.format('-')}, 8) AS ci_low, round({_WILSON.format('+')}, 8) AS ci_high FROM (SELECT state, count(*) AS n,
  count(*) FILTER (infection_date IS NULL) AS n_protected, count(*) FILTER (infection_date IS NULL) / count(*) AS p, 1.959963984540054 AS z FROM state GROUP BY 1)""", "infection", "history", extra=INF))
def stat_protection_rate(v):
    df = stats.protection_rate(exposed_infected(v), "state", F.col("infected") == 1)
    return df.withColumns({c: F.round(c, 8) for c in ("rate", "ci_low", "ci_high")})


_LN_WAYS = "-(lgamma({k} + 1) + lgamma(a + b - {k} + 1) + lgamma(a + c - {k} + 1) + lgamma(d - a + {k} + 1))"


@query("stat_protection_pairs", sql(f"""SELECT group_1, group_2, round(any_value(CAST(a * d AS DOUBLE) / nullif(b * c, 0)), 6) AS odds_ratio, round(least(sum(CASE WHEN lp <= lo + 1e-7 THEN exp(lp - lm) ELSE 0 END) / sum(exp(lp - lm)), 1), 6) AS p_value FROM (
  SELECT *, {_LN_WAYS.format(k='a')} AS lo, {_LN_WAYS.format(k='k')} AS lp, max({_LN_WAYS.format(k='k')}) OVER (PARTITION BY group_1, group_2) AS lm FROM (SELECT *, CAST(unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS DOUBLE) AS k FROM (
  SELECT x.state AS group_1, y.state AS group_2, x.p AS a, x.n - x.p AS b, y.p AS c, y.n - y.p AS d FROM r x JOIN r y ON x.state < y.state))) GROUP BY 1, 2""", "infection", "history",
                                    extra=INF + ", r AS (SELECT state, count(*) AS n, count(*) FILTER (infection_date IS NULL) AS p FROM state GROUP BY 1)"))
def stat_protection_pairs(v):
    rates = stats.protection_rate(exposed_infected(v), "state", F.col("infected") == 1)
    df = stats.pairwise_fisher(rates, "state")
    return df.withColumns({c: F.round(c, 6) for c in ("odds_ratio", "p_value")})


@query("stat_pearson", sql(_tested("SELECT c AS feature, corr(x, treated) AS r, regr_count(treated, x)::BIGINT AS n FROM people UNPIVOT (x FOR c IN (balance, age, n_episodes, nation)) GROUP BY 1",
                                   _t_tail("(r * sqrt((n - 2) / (1 - r * r)))", "(n - 2)"), "r", 8), "person", "episode", "dose", extra=PEOPLE))
def stat_pearson(v):
    return stats.pearson(people(v), COVARIATES, "treated").withColumns({"r": F.round("r", 8), "p_value": F.round("p_value", 6)})


@query("stat_vif", sql("""SELECT unnest(['balance', 'age', 'n_episodes']) AS feature, unnest([round((1 - c * c) / det, 6), round((1 - b * b) / det, 6), round((1 - a * a) / det, 6)]) AS vif FROM (
  SELECT a, b, c, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM (SELECT corr(balance, age) AS a, corr(balance, n_episodes) AS b, corr(age, n_episodes) AS c FROM people))""", "person", "episode", "dose", extra=PEOPLE))
def stat_vif(v):
    return stats.variance_inflation(people(v), ["balance", "age", "n_episodes"]).withColumn("vif", F.round("vif", 6))


@query("stat_anova_rm", _tested("""WITH x AS (SELECT s, c, coalesce(y, 0) AS y FROM (SELECT DISTINCT CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS s FROM orders) m CROSS JOIN (VALUES ('F'), ('O')) k(c)
  LEFT JOIN (SELECT CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS s, o_orderstatus AS c, 100.0 * count(*) FILTER (o_orderpriority = '1-URGENT') / count(*) AS y FROM orders GROUP BY 1, 2) USING (s, c)),
  g AS (SELECT avg(y) AS m FROM x), sc AS (SELECT sum(n * (a - m) ** 2) AS v FROM (SELECT c, avg(y) AS a, count(*) AS n FROM x GROUP BY 1), g), ss AS (SELECT sum(n * (a - m) ** 2) AS v FROM (SELECT s, avg(y) AS a, count(*) AS n FROM x GROUP BY 1), g),
  st AS (SELECT sum((y - m) ** 2) AS v FROM x, g), d AS (SELECT count(DISTINCT c) - 1 AS d1, (count(DISTINCT c) - 1) * (count(DISTINCT s) - 1) AS d2 FROM x)
  SELECT (sc.v / d1) / ((st.v - sc.v - ss.v) / d2) AS f, d1 AS df_1, d2 AS df_2 FROM sc, ss, st, d""", _t_tail("sqrt(f)", "df_2"), "f", 5))
def stat_anova_rm(v):
    """F between two monthly rate series, the month as the subject."""
    month = F.date_format("o_orderdate", "yyyyMM").cast("int").alias("s")
    wide = v.t("orders").groupBy(month).agg(*[F.coalesce(100.0 * F.count(F.when((F.col("o_orderstatus") == c) & (F.col("o_orderpriority") == "1-URGENT"), 1)) /
                                                         F.nullif(F.count(F.when(F.col("o_orderstatus") == c, 1)), F.lit(0)), F.lit(0.0)).alias(c) for c in ("F", "O")])
    long = wide.select("s", F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("y")) for c in ("F", "O")])))
    return stats.repeated_anova(long, "s", "c", "y").withColumns({"f": F.round("f", 5), "p_value": F.round("p_value", 6)})


_PROBS = [(i + 1) / 20 for i in range(19)]


@query("stat_qq_quantiles", "SELECT prob, round(normal, 8) AS normal, round(quantile_cont, 4) AS sample FROM (SELECT unnest([" + ", ".join(f"{p}::DOUBLE" for p in _PROBS) + "]) AS prob, unnest([" +
       ", ".join(f"{NormalDist().inv_cdf(p)}::DOUBLE" for p in _PROBS) + "]) AS normal, unnest((SELECT quantile_cont(o_totalprice, [" + ", ".join(map(str, _PROBS)) + "]) FROM orders)) AS quantile_cont)")
def stat_qq_quantiles(v):
    df = stats.qq_pairs(v.t("orders"), "o_totalprice", 19)
    return df.select("prob", F.round("normal", 8).alias("normal"), F.round("sample", 4).alias("sample"))


@query("stat_group_samples", sql("""SELECT state, infection_trimester, n, low, q1, median, q3, high FROM (SELECT state, CASE WHEN d <= 90 THEN '1st trimester' WHEN d <= 181 THEN '2nd trimester' ELSE '3rd trimester' END AS infection_trimester, count(*) AS n, CAST(min(gest_days) AS DOUBLE) AS low,
  quantile_cont(gest_days, 0.25) AS q1, median(gest_days) AS median, quantile_cont(gest_days, 0.75) AS q3, CAST(max(gest_days) AS DOUBLE) AS high FROM (SELECT *, date_diff('day', conception, infection_date) AS d FROM state WHERE infection_date IS NOT NULL)
  GROUP BY 1, 2) WHERE n > 9""", "infection", "history", extra=INF))
def stat_group_samples(v):
    df = exposed_infected(v).where("infected = 1")
    return stats.group_samples(df, ["state", "infection_trimester"], "gest_days")


# ---- models ------------------------------------------------------------------------------------------------------


@query("ml_latest_row_training_set", """WITH m AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS y, max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS ever FROM orders)
  SELECT o_custkey, o_orderkey, y, o_totalprice, CASE WHEN y = 1 THEN 0.99 ELSE 0.01 END::DOUBLE AS class_weight FROM m WHERE y = 1 OR ever = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""")
def ml_latest_row_training_set(v):
    df = v.t("orders").withColumn("y", (F.col("o_orderstatus") == "P").cast("int"))
    return models.latest_training_rows(df, "o_custkey", "y", "o_orderkey", ["o_totalprice"])


def split(v):
    """Training and test part of the people: a fifth is held out, by a hash of the person."""
    df = models.split_by_hash(people(v), "pat_id")
    return df.where("not is_test").drop("is_test"), df.where("is_test").drop("is_test")


def fitted_scores(v):
    """Test people with the probability from a weighted logistic model of the training part."""
    train, test = split(v)
    model = models.logistic(train.withColumn("w", F.when(F.col("treated") == 1, 0.4).otherwise(0.6)), COVARIATES, "treated", "w")
    scored = model.transform(test)
    return scored.select("pat_id", models.score_of(scored).alias("s"), F.col("treated").alias("y"))


@query("ml_logistic", _recursive(sql("SELECT unnest(['balance', 'age', 'n_episodes', 'nation']) AS feature, unnest([round(c, 5) FOR c IN b[2:5]]) AS coefficient FROM fit", *_PEOPLE_VIEWS, extra=_TRAINED)))
def ml_logistic(v):
    train, _ = split(v)
    weighted = train.withColumn("w", F.when(F.col("treated") == 1, 0.4).otherwise(0.6))
    df = models.coefficient_table(v.spark, models.logistic(weighted, COVARIATES, "treated", "w"), COVARIATES)
    return df.withColumn("coefficient", F.round("coefficient", 5))


_FOLD = "CAST(CAST('0x' || substr(md5('0:' || pat_id), 1, 8) AS BIGINT) % 10 AS INTEGER)"


@query("ml_cross_validate", _recursive(sql(f"""SELECT g AS fold, round(avg(CASE WHEN ({_margin('')} > 0) = (treated = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM z JOIN fit USING (g)
  WHERE {_FOLD} = g GROUP BY g""", *_PEOPLE_VIEWS, extra=PEOPLE + ", " + _logistic_ctes(
    f"SELECT CAST(k AS INTEGER) AS g, p.*, 1.0 AS w FROM people p, range(10) f(k) WHERE {_TRAIN} AND {_FOLD} <> k", f"(SELECT * FROM people WHERE {_TRAIN})", 400))))
def ml_cross_validate(v):
    """Ten folds of the training part; the test part stays unseen."""
    return models.cross_validate(split(v)[0], "pat_id", COVARIATES, "treated", folds=10).withColumn("accuracy", F.round("accuracy", 6))


@query("ml_boosted_classifier")
def ml_boosted_classifier(v):
    return models.importance_table(v.spark, models.boosted_classifier(models.spread(split(v)[0]), COVARIATES, "treated"), COVARIATES)


@query("ml_random_forest")
def ml_random_forest(v):
    return models.importance_table(v.spark, models.random_forest(models.spread(split(v)[0]), COVARIATES, "treated"), COVARIATES)


@query("ml_gbt_regressor")
def ml_gbt_regressor(v):
    return models.importance_table(v.spark, models.boosted_regressor(models.spread(split(v)[0]), COVARIATES, "treated"), COVARIATES)


_SCORE = f"x AS MATERIALIZED (SELECT 1 / (1 + exp(-{_margin('')})) AS s, treated AS y FROM z JOIN fit USING (g))"


@query("ml_metrics", _recursive(sql("""SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc, (SELECT round(sum(p * tp / k) / sum(p), 6) FROM c) AS average_precision,
  round(avg((y - s) ** 2), 6) AS mse, round(sqrt(avg((y - s) ** 2)), 6) AS rmse, round(avg(abs(y - s)), 6) AS mae, round(1 - avg((y - s) ** 2) / var_pop(y), 6) AS r2 FROM r""", *_PEOPLE_VIEWS,
    extra=f"""{_TRAINED}, {_SCORE}, r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM x), t AS (SELECT s, sum(y) AS p, count(*) AS n FROM x GROUP BY 1),
  c AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS k FROM t)""")))
def ml_metrics(v):
    """Scores of the fitted logistic model on the test part."""
    out = models.ranking_metrics(fitted_scores(v), "s", "y")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("ml_roc_points", _recursive(sql("SELECT round(s, 4) AS s, sum(p) OVER (ORDER BY s DESC)::BIGINT AS tp, sum(n) OVER (ORDER BY s DESC)::BIGINT AS fp FROM t", *_PEOPLE_VIEWS,
    extra=f"{_TRAINED}, {_SCORE}, t AS (SELECT s, sum(y) AS p, count(*) - sum(y) AS n FROM x GROUP BY 1)")))
def ml_roc_points(v):
    return models.score_thresholds(fitted_scores(v), "s", "y").select(F.round("s", 4).alias("s"), "tp", "fp")


@query("ml_precision_recall", _recursive(sql("""SELECT round(s, 4) AS s, round(tp / k, 8) AS precision, round(tp / sum(p) OVER (), 8) AS recall FROM
  (SELECT s, p, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS k FROM t)""", *_PEOPLE_VIEWS, extra=f"{_TRAINED}, {_SCORE}, t AS (SELECT s, sum(y) AS p, count(*) AS n FROM x GROUP BY 1)")))
def ml_precision_recall(v):
    """Precision and recall of the fitted model at every distinct score of the test part."""
    df = models.precision_recall(fitted_scores(v), "s", "y")
    return df.select(F.round("s", 4).alias("s"), F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))


@query("ml_model_evaluation")
def ml_model_evaluation(v):
    """Tree models fitted on the training part: scores on the test part, the regressor also with its three most important covariates alone."""
    train, test = split(v)
    return models.evaluate(train, test, COVARIATES, "treated", top=3)
