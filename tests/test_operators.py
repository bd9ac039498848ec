"""Operators against plain Python on small data, with few rows per partition and a hot key."""

import datetime as dt
import math
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from cohortspark.functions import dates, sqlrules, strings
from cohortspark.operators import aggregate as agg
from cohortspark.operators import cohorts, concepts, encoders, features, joins, models, ranks, timeline
from cohortspark.session import durable
from cohortspark.sources import registry, tables

D0 = dt.date(2020, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def calendar(spark):
    rng = random.Random(1)
    key = lambda: 1 if rng.random() < 0.5 else rng.randint(2, 6)
    probes = [(key(), i, day(rng.randint(0, 60))) for i in range(80)] + [(9, 99, day(5)), (1, 100, None)]
    events = [(key(), day(rng.randint(0, 60)), rng.randint(1, 9)) for _ in range(70)]
    return probes, events, spark.createDataFrame(probes, "k int, id int, p date"), spark.createDataFrame(events, "k int, e date, v int")


def test_nearest_events(calendar):
    probes, events, p, e = calendar
    per_day = timeline.daily(e, ["k"], "e", {"v": F.max("v")})
    after = {r["id"]: (r["next_e"], r["first"]) for r in timeline.next_event(p, per_day, ["k"], "p", "e", first_before="first").collect()}
    last = {r["id"]: (r["last_e"], r["last_v"]) for r in timeline.last_event(p, per_day, ["k"], "p", "e", ["v"]).collect()}
    assert len(after) == len(last) == len(probes)
    for k, i, d in probes:
        mine = [(x, v) for q, x, v in events if q == k and d is not None]
        assert after[i] == (min((x for x, _ in mine if x > d), default=None), min((x for x, _ in mine if x < d), default=None))
        best = max((x for x, _ in mine if x <= d), default=None)
        assert last[i] == (best, max((v for x, v in mine if x == best), default=None))


def test_window_reduce_and_counts(calendar):
    probes, events, p, e = calendar
    per_day = timeline.daily(e, ["k"], "e", {"n": F.count(F.lit(1))})
    got = {r["id"]: r["n_near"] for r in timeline.window_reduce(p, per_day, ["k"], "p", "e", -10, 3, {"n_near": F.sum("n")}).collect()}
    span = p.withColumn("s", F.date_sub("p", 10)).withColumn("t", F.date_add("p", 3))
    counted = {r["id"]: r["n_events"] for r in timeline.count_between(span, e, ["k"], "s", "t", "e").collect()}
    for k, i, d in probes:
        want = sum(1 for q, x, _ in events if d and q == k and -10 <= (x - d).days <= 3)
        assert (got[i] or 0) == want == counted[i]


def test_running_totals_and_quantiles(spark):
    rng = random.Random(2)
    rows = [(("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])), float(rng.randint(0, 20)), i) for i in range(200)] + [("a", None, 999)]
    df = spark.createDataFrame(rows, "g string, x double, id int")
    got = ranks.ranked(df.where("x is not null"), ["g"], ["x", "id"], "r", partitions=7).collect()
    for g in ("hot", "a", "b", None):
        mine = sorted((r["x"], r["id"]) for r in got if r["g"] == g)
        assert [r["r"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: (r["x"], r["id"]))] == list(range(1, len(mine) + 1))
    q = {r["g"]: (r["q1"], r["m"], r["n"]) for r in ranks.exact_quantiles(df, ["g"], "x", {"q1": 0.25, "m": 0.5}, "n", partitions=7).collect()}
    for g, found in q.items():
        xs = sorted(x for h, x, _ in rows if h == g and x is not None)
        want = statistics.quantiles(xs, n=4, method="inclusive")
        assert found == pytest.approx((want[0], want[1], len(xs)))


def test_aggregate_semantics(spark):
    rows = [(1, 1, "b", True, 2), (1, 2, None, False, 4), (1, 3, "a", True, 9), (None, 1, "z", None, 1), (None, 2, "y", True, None)]
    df = spark.createDataFrame(rows, "k int, o int, s string, f boolean, n int")
    spec = {"s": ["collect_list", "collect_set", "concat_ws", "first", "last"], "f": ["sum", "avg"], "n": ["median", "count"]}
    got = {r["k"]: r for r in agg.aggregate(df, "k", spec, "o").collect()}
    assert (got[1]["s_collect_list"], got[1]["s_collect_set"], got[1]["s_concat_ws"]) == (["b", "a"], ["a", "b"], "b;a")
    assert (got[1]["s_first"], got[1]["s_last"], got[1]["f_sum"], got[1]["n_median"], got[1]["n_count"]) == ("b", "a", 2, 4.0, 3)
    assert (got[None]["s_concat_ws"], got[None]["f_sum"], got[None]["n_median"]) == ("z;y", 1, 1.0)
    rows_form = sorted((r["position"], r["value"]) for r in agg.ordered_elements(df.where("k = 1"), "k", "s", "o").collect())
    assert rows_form == [(1, "b"), (2, "a")]
    with pytest.raises(ValueError):
        agg.aggregate(df, "k", {"s": "mode"})
    with pytest.raises(ValueError):
        agg.aggregate(df, "nope", {"s": "min"})


def test_wide_and_long_index_hold_the_same(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 7), (1, None, 1), (2, 1, 3), (2, None, 9), (3, None, 4), (3, 6, 2)], "k int, i int, n int")
    wide = agg.aggregate_by_index(df, "k", "i", {"n": "sum"}, None, ["pre"], wide=[0, 1])
    assert wide.columns == ["k", "n_sum_pre", "n_sum_1", "n_sum_other"]
    assert {tuple(r) for r in wide.collect()} == {(1, 5, 7, 1), (2, None, 3, 9), (3, None, None, 6)}
    # The columns do not follow the rows.
    assert agg.aggregate_by_index(df.limit(0), "k", "i", {"n": "sum"}, None, ["pre"], wide=[0, 1]).columns == wide.columns
    long = {(r["k"], r["i"], r["i_label"]): r["n_sum"] for r in agg.aggregate_by_index(df, "k", "i", {"n": "sum"}, None, ["pre"]).collect()}
    assert long == {(1, 0, "pre"): 5, (1, 1, "1"): 7, (1, None, None): 1, (2, 1, "1"): 3, (2, None, None): 9, (3, None, None): 4, (3, 6, "6"): 2}


def test_weekly_rate_and_histogram(spark):
    rows = [(day(i % 21), i % 4 == 0) for i in range(210)]
    df = spark.createDataFrame(rows, "d date, e boolean")
    got = sorted((r["week"], r["n"], round(r["rate"], 3)) for r in agg.weekly_rate(df, "d", F.col("e"), "2020-01-01", 4).collect())
    for w, n, rate in got:
        mine = [e for d, e in rows if (d - D0).days // 7 == w]
        assert n == len(mine) and rate == (round(100 * sum(mine) / n, 3) if n > 9 else 0)
    literal = {r["week"]: r["n"] for r in agg.weekly_rate(df, "d", F.col("e"), "2020-01-01", 4, offset=6).collect()}
    assert literal[0] == sum(1 for d, _ in rows if d == D0)


def test_no_row_leaves_the_histogram_or_the_weeks(spark):
    df = spark.createDataFrame([(x,) for x in (-5.0, 0.0, 1.5, 9.99, 10.0, 12.0, None)], "x double")
    got = {r["bin"]: (r["bin_start"], r["n"]) for r in agg.histogram(df, F.col("x"), 0, 10, 2).collect()}
    assert got == {-1: (None, 1), 0: (0.0, 2), 1: (5.0, 1), 2: (10.0, 2)}
    whole = {r["bin"]: r["n"] for r in agg.histogram(df, F.col("x"), bins=17).collect()}
    assert sum(whole.values()) == 6 and whole[0] == 1 and whole[16] == 1 and len(whole) == 17
    assert [r["n"] for r in agg.histogram(df.where("x = 12"), F.col("x"), bins=1).collect()] == [1]
    assert sum(r["n"] for r in agg.histogram(df.limit(0), F.col("x"), bins=3).collect()) == 0
    days = spark.createDataFrame([(day(-8), True), (day(0), False), (day(40), True)], "d date, e boolean")
    weeks = {r["week"]: r["n"] for r in agg.weekly_rate(days, "d", F.col("e"), "2020-01-01", 2).collect()}
    assert weeks == {w: int(w in (-2, 0, 5)) for w in range(-2, 6)}


def test_median_without_keys(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, None)], "k int, x double")
    assert agg.aggregate(df, [], {"x": ["median", "sum"]}).collect() == [(3.0, 6.0)]
    assert agg.aggregate(df, [], {"x": "median"}).collect() == [(3.0,)]


def test_fan_out_is_a_left_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, x string")
    right = spark.createDataFrame([(1, 5), (1, 6), (3, None)], "k int, y int")
    as_set = lambda df: sorted(map(tuple, df.select("k", "x", "y").collect()), key=repr)
    assert as_set(joins.fan_out(left, right, ["k"])) == as_set(left.join(right, "k", "left"))


def test_spine_keeps_null_keys(spark):
    a = spark.createDataFrame([(1, None, 5), (1, "d", 6)], "k int, d string, a int")
    b = spark.createDataFrame([(1, None, 7), (2, "d", 8)], "k int, d string, b int")
    got = sorted(map(tuple, joins.spine_join([a, b], ["k", "d"]).collect()), key=repr)
    assert got == sorted([(1, None, 5, 7), (1, "d", 6, None), (2, "d", None, 8)], key=repr)


def test_geo_keys(spark):
    df = spark.createDataFrame([("530330001001", "98101-1", "WA"), ("060330001001", "90001", "CA")], "b string, z string, s string")
    key = lambda level: [r[0] for r in df.select(joins.geo_key(F.col("b"), F.col("z"), F.col("s"), level)).collect()]
    assert key("tract") == ["53033000100", "6033000100"]
    assert key("county_short") == ["53033", "6033"] and key("county") == ["53033", "06033"] and key("zip") == ["98101", "90001"]


def test_concepts_null_safe(spark):
    df = spark.createDataFrame([(None, "x", 1), ("Red Cap", None, 2), ("red cap", "wool", 3)], "a string, b string, v int")
    got = [r["hit"] for r in concepts.add_string_values(df, "v", {"hit": {"a": ["red"], "b": ["wool", "silk"]}}).orderBy("v").collect()]
    assert got == [None, None, 3]
    wide = spark.createDataFrame([(True, None)], "SNOMED_1 boolean, SNOMED_2 boolean")
    assert tuple(concepts.flags_from_wide(wide, {"p": ["1", "2"], "q": ["2"], "r": ["9"]}).select("p", "q", "r").first()) == (True, False, False)
    with pytest.raises(ValueError):
        registry.check_version("2019-1-1")


def test_exposure_states(spark):
    doses = [(1, 10, "MODERNA"), (1, 10, "MODERNA"), (1, 40, "MODERNA"), (1, 300, "MODERNA BIVALENT"), (2, 10, "JANSSEN"), (3, 10, "JANSSEN"), (3, 400, "PFIZER"),
             (4, 10, "PFIZER"), (4, 40, "MODERNA"), (5, 500, "PFIZER"), (7, 10, "PFIZER"), (7, 97, "PFIZER")]
    d = spark.createDataFrame([(p, 1, day(n), x) for p, n, x in doses], "pat_id int, instance int, dose_date date, product string")
    e = spark.createDataFrame([(p, 1, day(0), day(at)) for p, at in ((1, 350), (2, 100), (3, 100), (4, 100), (5, 100), (6, 100), (7, 100))],
                              "pat_id int, instance int, conception date, delivery date")
    got = {r["pat_id"]: (r["state"], r["full_date"]) for r in cohorts.exposure_state(e, cohorts.exposure_history(d)).collect()}
    assert got == {1: ("boosted", day(54)), 2: ("full", day(24)), 3: ("full", day(24)), 4: ("partial", None), 5: ("later", None), 6: ("never", None), 7: ("partial", None)}


def test_growth_percentile_edges(spark):
    chart = spark.createDataFrame([(s, w, p, 100.0 * w + p) for s in ("male", "unknown") for w in range(14, 41) for p in (10.0, 50.0, 90.0)],
                                  "sex string, week int, percentile double, grams double")
    rows = [(1, 3030.0, 210, "Male"), (2, 100.0, 210, "male"), (3, 9999.0, 210, "Male"), (4, 4330.0, 301, "Other"), (5, 3080.0, 213, None), (6, None, 210, "Male")]
    df = spark.createDataFrame(rows, "id int, w double, g int, s string")
    got = {r["id"]: r["growth_percentile"] for r in features.growth_percentile(df, chart, F.col("w"), F.col("g"), F.col("s"), ["id"]).collect()}
    assert got[1] == pytest.approx(30.0) and got[2] == 10.0 and got[3] == 90.0
    assert got[4] == pytest.approx(30.0) and got[5] == pytest.approx(3080 - 100 * 213 / 7) and 6 not in got


def test_tables(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    name = "stage_for_test"
    tables.drop_table(spark, name)
    assert not tables.append_table(a, name)
    assert tables.write_table(a, name) and not tables.write_table(a, name)
    assert tables.append_table(a.select("s", "n"), name) and spark.table(name).count() == 2
    assert tables.write_table(a, name, replace=True) and spark.table(name).count() == 1
    assert name in tables.list_tables(spark) and tables.drop_table(spark, name) and not tables.drop_table(spark, name)


def failing(spark, n):
    """Rows of which the last ones cannot be computed."""
    return spark.range(0, n, 1, 4).select(F.col("id").alias("n"), F.when(F.col("id") < n - 2, F.lit("new")).otherwise(F.raise_error(F.lit("broken"))).cast("string").alias("s"))


@pytest.mark.parametrize("at_path", [False, True])
def test_a_failed_replacement_keeps_the_old_table(spark, tmp_path, at_path):
    name = f"stage_replace_{at_path}".lower()
    tables.drop_table(spark, name)
    put = (lambda df, **k: tables.write_path_table(df, name, str(tmp_path / "t"), **k)) if at_path else (lambda df, **k: tables.write_table(df, name, **k))
    first = spark.createDataFrame([(1, "a"), (2, "b")], "n long, s string")
    assert put(first) and not put(first)
    was = tables.location(spark, name)
    with pytest.raises(Exception, match="broken"):
        put(failing(spark, 4000), replace=True)
    assert sorted(spark.table(name).collect()) == [(1, "a"), (2, "b")] and tables.location(spark, name) == was
    assert put(first.where("n = 2"), replace=True)
    assert spark.table(name).collect() == [(2, "b")] and tables.location(spark, name) != was
    # The old version is gone, and a version with other columns can follow.
    assert not os.path.exists(was.removeprefix("file:"))
    assert tables.append_table(first, name) and spark.table(name).count() == 3
    assert put(spark.createDataFrame([(1.5,)], "x double"), replace=True) and spark.table(name).collect() == [(1.5,)]
    assert put(spark.table(name).selectExpr("x + 1 AS x"), replace=True) and spark.table(name).collect() == [(2.5,)]
    assert tables.drop_table(spark, name)


def test_sql_rules_say_what_the_column_rules_say(spark):
    assert set(sqlrules.register(spark)) == set(sqlrules.RULES) and sqlrules.register(spark)
    texts = [" Not  Detected. ", "DETECTED", None, "a-b (c)\t", "negative:", "12", "1234567"]
    df = spark.createDataFrame([(t, "LOINC#X12-3" if i % 2 else None, D0 + dt.timedelta(days=400 * i)) for i, t in enumerate(texts)], "t string, c string, d date")
    pairs = {
        "clean_text(t)": strings.clean_text(F.col("t")), "zero_pad_front(t, 4)": strings.pad_front(F.col("t"), 4),
        "code_of(c)": strings.split_code(F.col("c"))["code"], "vocabulary_of(c)": strings.split_code(F.col("c"))["vocabulary"],
        "lab_code(code_of(c), 'X9')": strings.lab_code(strings.split_code(F.col("c"))["code"], F.lit("X9")),
        "age_years(date'2020-01-01', d)": dates.age_years(F.lit("2020-01-01").cast("date"), F.col("d")),
        "gestation_days(d, date'2020-05-05')": dates.gestation_days(F.col("d"), F.lit("2020-05-05").cast("date")),
        "is_positive_result(t)": strings.clean_text(F.col("t")).isin(strings.POSITIVE_RESULTS),
        "is_negative_result(t)": strings.clean_text(F.col("t")).isin(strings.NEGATIVE_RESULTS)}
    rows = df.select(*[F.expr(f"{q}").alias(f"s{i}") for i, q in enumerate(pairs)], *[c.alias(f"c{i}") for i, c in enumerate(pairs.values())]).collect()
    for i, q in enumerate(pairs):
        assert [r[f"s{i}"] for r in rows] == [r[f"c{i}"] for r in rows], q


def test_folds_are_fitted_together(spark):
    rng = random.Random(6)
    rows = [(i, rng.gauss(0, 1), rng.gauss(5, 100), 3.0) for i in range(900)]
    rows = [(*r, int(rng.random() < 1 / (1 + math.exp(-1.5 * r[1] + r[2] / 100)))) for r in rows]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int")
    got = {r["fold"]: (r["accuracy"], r["n"]) for r in models.cross_validate(df, "id", ["a", "b", "c"], "y", folds=4).collect()}
    marked = df.withColumn("fold", models._fold_of(F.col("id"), 4, 0))
    for k in range(4):
        seen = models.logistic(marked.where(F.col("fold") != k), ["a", "b"], "y").transform(marked.where(F.col("fold") == k))
        want = seen.agg(F.avg((F.col("prediction") == F.col("y")).cast("double")), F.count(F.lit(1))).first()
        assert got[k] == (pytest.approx(want[0], abs=1e-9), want[1])
    held = durable(marked.select("fold", F.array("a").alias("x"), F.col("y").cast("double").alias("y")))
    b, scans = models.fold_models(held, 2, 4)
    assert scans <= 12 and all(0.5 < g[1] < 3 for g in b)
    # Rows a line can part have no largest likelihood; the models still part them.
    parted = spark.createDataFrame([(i, float(i - 50), int(i >= 50)) for i in range(100)], "id long, a double, y int")
    assert all(r["accuracy"] > 0.9 for r in models.cross_validate(parted, "id", ["a"], "y", folds=3).collect())


def test_stored_encoders_meet_new_values(spark, tmp_path):
    train = spark.createDataFrame([("a b", 1), ("a b", 2), ("c", 2), (None, None), ("d", 2)], "x string, y int")
    encoders.save(encoders.fit(train, ["x", "y"]), str(tmp_path / "e"))
    e = encoders.load(spark, str(tmp_path / "e"))
    assert encoders.values_of(e) == {"x": ["a b", "c", "d"], "y": ["2", "1"]}
    new = spark.createDataFrame([(1, "c", 1), (2, "z", 2), (3, None, 9), (4, "a b", None)], "id int, x string, y int")
    hot = encoders.one_hot(new, e, ["x", "y"])
    assert hot.columns == ["id", "x_a_b", "x_c", "x_d", "x_unseen", "x_missing", "y_2", "y_1", "y_unseen", "y_missing"]
    assert sorted(tuple(r) for r in hot.collect()) == [(1, 0, 1, 0, 0, 0, 0, 1, 0, 0), (2, 0, 0, 0, 1, 0, 1, 0, 0, 0), (3, 0, 0, 0, 0, 1, 0, 0, 1, 0), (4, 1, 0, 0, 0, 0, 0, 0, 0, 1)]
    assert encoders.one_hot(new, e, ["y"], reference=True).columns == ["id", "x", "y_1", "y_unseen", "y_missing"]
    assert sorted(tuple(r) for r in encoders.codes(new, e, ["x", "y"]).collect()) == [(1, 1, 1), (2, -1, 0), (3, None, -1), (4, 0, None)]
    assert encoders.fit(train, ["x"], least=2).count() == 1 and encoders.fit(train.limit(0), ["x"]).count() == 0
    for wrong in (lambda: encoders.one_hot(new, e, ["id"]), lambda: encoders.values_of(e, most=2),
                  lambda: encoders.one_hot(new, encoders.fit(spark.createDataFrame([("a-b",), ("a b",)], "x string"), ["x"]), ["x"])):
        with pytest.raises(ValueError):
            wrong()


def test_category_counts_keep_every_row(spark):
    df = spark.createDataFrame([(1, "a"), (1, "z"), (1, None), (2, "b"), (None, "a")], "g int, c string")
    got = agg.category_counts(df, {"m": (F.col("c"), ["a", "b"])}, ["g"]).collect()
    assert {(r["g"], r["category"]): r["n"] for r in got} == {
        (1, "a"): 1, (1, "b"): 0, (1, agg.REST): 2, (2, "a"): 0, (2, "b"): 1, (2, agg.REST): 0,
        (None, "a"): 1, (None, "b"): 0, (None, agg.REST): 0}


def test_worst_encounter(spark):
    people = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "pat_id int, instance int")
    rows = spark.createDataFrame([(1, 1, 5, 1.0, 10), (1, 1, 5, 4.0, 11), (1, 1, 2, 9.0, 12), (2, 1, None, None, 13)],
                                 "pat_id int, instance int, score int, duration double, visit int")
    got = features.worst_encounter(people, rows, ["pat_id", "instance"], ["visit"]).collect()
    assert sorted((r["pat_id"], r["score"], r["duration"], r["visit"]) for r in got) == [(1, 5, 4.0, 11), (2, 3, None, 13), (3, 2, None, None)]


def test_metrics_without_positive_rows_are_null(spark):
    df = spark.createDataFrame([(0.2, 0), (0.7, 0)], "s double, y int")
    r = models.ranking_metrics(df, "s", "y").first()
    assert r["auc"] is None and r["r2"] is None and abs(r["mae"] - 0.45) < 1e-12


def test_trees_are_fitted_on_even_tasks(spark, monkeypatch):
    df = spark.range(20_000, numPartitions=1).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 11 AS DOUBLE) AS b", "CAST(id % 7 > 3 AS INT) AS y")
    tasks = []

    def fit(train, features, label):
        tasks.append(train.rdd.glom().map(len).collect())
        return models.boosted_regressor(train, features, label, trees=2)

    monkeypatch.setattr(models, "MODELS", {"boosted_regressor": fit})
    monkeypatch.setattr(models, "TASK_ROWS", 1000, raising=False)
    got = models.evaluate(df, df.where("id < 100"), ["a", "b"], "y", top=1).collect()
    assert [(r["n_features"], r["n_test"]) for r in got] == [(2, 100), (1, 100)]
    assert all(len(t) == 8 and sum(t) == 20_000 and max(t) - min(t) <= 8 for t in tasks), tasks
    monkeypatch.setattr(models, "TASK_ROWS", 10_001)
    small = models.spread(df)
    assert small.rdd.getNumPartitions() == 1 and small.count() == 20_000
    assert models.spread(df.limit(0)).collect() == []


def test_forest_in_lots_of_trees(spark, monkeypatch):
    df = spark.range(400).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 11 AS DOUBLE) AS b", "CAST(id % 13 AS DOUBLE) AS c", "CAST(id % 7 > 3 OR id % 11 = 1 AS INT) AS y").coalesce(2)
    one = models.random_forest(df, ["a", "b", "c"], "y", trees=12)
    monkeypatch.setattr(models, "FOREST_COUNTS", 400 * 12 - 1, raising=False)
    monkeypatch.setattr(models, "LOT_TREES", 5, raising=False)
    lots = models.random_forest(df, ["a", "b", "c"], "y", trees=12)
    forests = [s for s in lots.stages if hasattr(s, "getNumTrees")]
    assert [s.getNumTrees for s in forests] == [5, 5, 2] and one.stages[-1].getNumTrees == 12
    assert len({t.toDebugString.split("\n", 1)[1] for s in forests for t in s.trees}) > 6
    seen = lots.transform(df).collect()
    assert len(seen) == 400
    for r in seen[:40]:
        assert r["prediction"] == pytest.approx(sum(t.predict(r["_x"]) for s in forests for t in s.trees) / 12, abs=1e-12)
    a, b = models.importances(one), models.importances(lots)
    assert a.sum() == pytest.approx(1) and b.sum() == pytest.approx(1) and a.argmax() == b.argmax() == 0
    table = models.importance_table(spark, lots, ["a", "b", "c"]).collect()
    assert [r["importance"] for r in table] == pytest.approx(sorted(b, reverse=True))
