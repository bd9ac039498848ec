"""Statistics against closed forms, enumeration and printed tables."""

import math
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import models, stats, survival


def test_tails_match_printed_tables():
    assert stats.chi2_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-7)
    assert stats.t_tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert stats.f_tail(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert stats.normal_tail(1.959963984540054) == pytest.approx(0.05, abs=1e-12)


def test_ln_factorial(spark):
    rows = [(n,) for n in (0, 1, 5, 20, 21, 50, 1000, 10**6)]
    got = [r[0] for r in spark.createDataFrame(rows, "n bigint").select(stats.ln_factorial(F.col("n"))).collect()]
    assert got == pytest.approx([math.lgamma(n + 1) for n, in rows], rel=1e-12)


def test_fisher_equals_enumeration(spark):
    cases = [(3, 1, 1, 3), (10, 2, 3, 15), (0, 5, 4, 1), (7, 7, 7, 7)]
    got = {r["test"]: r["p_value"] for r in stats.fisher_tables(spark, cases).collect()}
    for i, (a, b, c, d) in enumerate(cases):
        r, k, n = a + b, a + c, a + b + c + d
        p = {x: comb(k, x) * comb(n - k, r - x) / comb(n, r) for x in range(max(0, r + k - n), min(r, k) + 1)}
        assert got[i] == pytest.approx(sum(v for v in p.values() if v <= p[a] * (1 + 1e-7)))


def test_fisher_two_by_c(spark):
    table = {(0, "a"): 3, (0, "b"): 8, (0, "c"): 2, (1, "a"): 9, (1, "b"): 4, (1, "c"): 5}
    counts = spark.createDataFrame([(g, c, n) for (g, c), n in table.items()], "g int, c string, n bigint")
    cols, r = [12, 12, 7], 13
    prob = {}
    for x in range(13):
        for y in range(13):
            if 0 <= r - x - y <= 7:
                prob[x, y] = comb(12, x) * comb(12, y) * comb(7, r - x - y) / comb(31, r)
    want = sum(v for v in prob.values() if v <= prob[3, 8] * (1 + 1e-7))
    exact = stats.fisher_exact(counts, "g", "c").first()
    assert exact["method"] == "exact" and exact["p_value"] == pytest.approx(want)
    drawn = stats.fisher_simulated(counts, "g", "c", 3000).first()
    assert drawn["p_value"] == pytest.approx(want, abs=5 * drawn["std_error"])
    again = stats.fisher_simulated(counts.repartition(3), "g", "c", 3000).first()
    assert again["p_value"] == drawn["p_value"]
    assert len(cols) == 3


def _counts(spark, table):
    return spark.createDataFrame([(i, j, n) for i, r in enumerate(table) for j, n in enumerate(r)], "g int, c int, n bigint")


def test_simulated_fisher_counts_ties(spark):
    exact = stats.fisher_exact(_counts(spark, [[3, 1], [1, 3]]), "g", "c").first()["p_value"]
    assert exact == pytest.approx(34 / 70)
    drawn = stats.fisher_simulated(_counts(spark, [[3, 1], [1, 3]]), "g", "c", 2000).first()
    assert drawn["p_value"] == pytest.approx(exact, abs=4 * drawn["std_error"])


def test_fisher_three_by_three_equals_enumeration(spark):
    table = [[3, 1, 2], [0, 4, 1], [2, 2, 5]]
    rows, cols = [sum(r) for r in table], [sum(c) for c in zip(*table)]
    weight = lambda t: 1 / math.prod(math.factorial(x) for r in t for x in r)
    seen, low = 0.0, 0.0
    for a in range(rows[0] + 1):
        for b in range(rows[0] + 1 - a):
            for d in range(rows[1] + 1):
                for e in range(rows[1] + 1 - d):
                    t = [[a, b, rows[0] - a - b], [d, e, rows[1] - d - e]]
                    t.append([c - x - y for c, x, y in zip(cols, *t)])
                    if min(t[2]) >= 0:
                        seen += weight(t)
                        low += weight(t) if weight(t) <= weight(table) * (1 + 1e-7) else 0
    for shown in (table, [list(c) for c in zip(*table)]):
        got = stats.fisher_exact(_counts(spark, shown), "g", "c").first()
        assert got["p_value"] == pytest.approx(low / seen) and got["method"] == "exact"
    assert stats.fisher_exact(_counts(spark, [[3, 4, 5]]), "g", "c").first()["p_value"] == 1.0


def test_chi_square_fit_keeps_one_sided_categories(spark):
    side = lambda d: spark.createDataFrame(list(d.items()), "k string, n bigint")
    unseen = stats.chi_square_fit(side({"a": 10, "b": 20, "z": 70}), side({"a": 50, "b": 50, "y": 5}), "k").first()
    assert unseen["chi_square"] is None and unseen["df"] == 3
    got = stats.chi_square_fit(side({"a": 10, "b": 20}), side({"a": 50, "b": 50, "y": 20}), "k").first()
    assert got["chi_square"] == pytest.approx((10 - 12.5) ** 2 / 12.5 + (20 - 12.5) ** 2 / 12.5 + 5) and got["df"] == 2


def test_mann_whitney_with_ties(spark):
    a, b = [1, 2, 2, 3, 5], [2, 3, 4, 5, 5, 6]
    df = spark.createDataFrame([(1, x) for x in a] + [(0, x) for x in b], "g int, x int")
    got = stats.mann_whitney(df, "g", "x").first()
    assert got["u"] == sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def test_t_and_wilson(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 7.0), (1, 9.0), (0, 1.0), (0, 2.0), (0, 3.0), (0, None)], "g int, x double")
    got = stats.with_p(stats.t_test(df, "g", F.col("x")), stats.t_tail, "t", "df").first()
    assert got["t"] == pytest.approx(5 / math.sqrt(2.5 * 2 / 3)) and got["df"] == 4 and 0 < got["p_value"] < 0.05
    low, high = stats.wilson(F.lit(8), F.lit(10))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert (r["l"], r["h"]) == pytest.approx((0.4901625, 0.9433178), abs=1e-6)


def test_kaplan_meier_and_logrank(spark):
    rows = [("a", t, e) for t, e in ((1, 1), (2, 1), (2, 0), (3, 0), (5, 1))] + [("b", t, e) for t, e in ((2, 0), (4, 1), (6, 0))]
    df = spark.createDataFrame(rows, "g string, time int, event int")
    km = {(r["g"], r["time"]): r["survival"] for r in survival.kaplan_meier(df, "g").collect()}
    assert km["a", 1] == pytest.approx(0.8) and km["a", 2] == pytest.approx(0.6) and km["a", 3] == pytest.approx(0.6) and km["a", 5] == 0
    for g in "ab":
        curve = [s for (h, _), s in sorted(km.items()) if h == g]
        assert curve == sorted(curve, reverse=True) and max(curve) <= 1
    lr = survival.logrank(df.withColumn("k", (F.col("g") == "a").cast("int")), "k").first()
    assert lr["observed"] == 3 and lr["chi_square"] == pytest.approx((3 - lr["expected"]) ** 2 / lr["variance"])


def test_auc_is_the_pair_share(spark):
    rows = [(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.2, 0), (0.1, 1)]
    got = models.ranking_metrics(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert got["auc"] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))


def test_rank_sums_of_small_samples_are_counted(spark):
    from itertools import combinations
    for a, b in (([1, 2, 3], [4, 5, 6]), ([1, 5, 9, 10], [2, 3, 4, 6, 7]), ([3.5], [1, 2, 4]), ([2, 4, 6, 8, 10, 12, 14, 16], list(range(1, 24, 2)))):
        got = stats.mann_whitney(spark.createDataFrame([(1, float(x)) for x in a] + [(0, float(x)) for x in b], "g int, x double"), "g", "x").first()
        every, m, n = sorted(a + b), len(a), len(b)
        ranks = [sum(every.index(x) + 1 for x in c) - m * (m + 1) / 2 for c in combinations(every, m)]
        far = max(got["u"], m * n - got["u"])
        assert got["method"] == "exact" and got["p_value"] == pytest.approx(min(1, 2 * sum(r >= far for r in ranks) / len(ranks)))
    assert stats.rank_sum_exact(0, 3, 3) == pytest.approx(0.1)
    # Against whole numbers, one sample far larger.
    row = [1]
    for i in range(1, 9):
        row = [x - (row[k - 600 - i] if k >= 600 + i else 0) for k, x in enumerate(row + [0] * (600 * i + 1 - len(row)))]
        for k in range(i, len(row)):
            row[k] += row[k - i]
    assert stats.rank_sum_exact(1500, 600, 8) == pytest.approx(2 * sum(row[:1501]) / sum(row), rel=1e-9)


def test_rank_sums_per_key(spark):
    rows = [("a", 1, 1.0), ("a", 0, 2.0), ("a", 0, 3.0), ("b", 1, 1.0), ("b", 0, 1.0), ("c", 1, 4.0), ("d", 0, None), ("d", None, 2.0), ("d", 1, 2.0), ("d", 0, 2.0), ("d", 0, 3.0)]
    got = {r["k"]: r for r in stats.mann_whitney(spark.createDataFrame(rows, "k string, g int, x double"), "g", "x", ["k"]).collect()}
    assert (got["a"]["method"], got["a"]["p_value"]) == ("exact", pytest.approx(2 / 3))
    assert got["b"]["z"] is None and got["b"]["p_value"] is None and got["c"]["p_value"] is None and got["c"]["n_0"] == 0
    assert (got["d"]["n_1"], got["d"]["n_0"], got["d"]["method"]) == (1, 2, "asymptotic")


def test_degenerate_samples_give_nulls(spark):
    two = lambda rows: spark.createDataFrame(rows, "g int, x double")
    constant, one_group, empty = two([(1, 2.0), (1, 2.0), (0, 2.0)]), two([(1, 1.0), (1, 3.0)]), two([])
    for df in (constant, one_group, empty):
        t, u = stats.t_test(df, "g", F.col("x")).first(), stats.mann_whitney(df, "g", "x").first()
        assert t["t"] is None and t["p_value"] is None and u["z"] is None and u["p_value"] is None
        assert u["n_1"] + u["n_0"] == df.count()
    lone = stats.t_test(two([(1, 9.0), (0, 1.0), (0, 2.0), (0, 3.0)]), "g", F.col("x")).first()
    assert lone["t"] == pytest.approx(7 / math.sqrt(1 * (1 + 1 / 3))) and lone["df"] == 2
    v = spark.createDataFrame([(float(i), 2.0 * i + 1, 5.0, float(i * i % 7)) for i in range(9)], "a double, b double, c double, d double")
    vif = {r["feature"]: r["vif"] for r in stats.variance_inflation(v, ["a", "b", "c", "d"]).collect()}
    assert vif["a"] == vif["b"] == math.inf and vif["c"] is None and vif["d"] >= 1
    assert {r["vif"] for r in stats.variance_inflation(v.limit(0), ["a", "b"]).collect()} == {None}
    r = {x["feature"]: x for x in stats.pearson(v, ["a", "c"], "b").collect()}
    assert r["a"]["r"] == pytest.approx(1) and r["c"]["r"] is None and r["c"]["p_value"] is None and r["c"]["n"] == 9
    long = lambda rows: spark.createDataFrame(rows, "s int, c string, y double")
    for rows in ([(1, "p", 1.0), (2, "p", 3.0)], [(1, "p", 1.0), (1, "q", 2.0)], [(i, c, 4.0) for i in range(3) for c in "pq"], []):
        assert stats.repeated_anova(long(rows), "s", "c", "y").first()["f"] is None
    side = lambda d: spark.createDataFrame(list(d.items()), "k string, n bigint")
    for seen, model in (({}, {"a": 3}), ({}, {}), ({"a": 0}, {"a": 2})):
        assert stats.chi_square_fit(side(seen), side(model), "k").first()["chi_square"] is None
    none = spark.createDataFrame([], "g int, c string, n bigint")
    assert stats.chi_square_independence(none, "g", "c").first()["chi_square"] is None
    assert stats.fisher_exact(none, "g", "c").first()["p_value"] == stats.fisher_simulated(none, "g", "c").first()["p_value"] == 1.0
    assert stats.fisher_2x2(two([]), "g", "x").first()["p_value"] == 1.0
    low, high = stats.wilson(F.lit(0), F.lit(0))
    assert spark.range(1).select(low, high).first() == (None, None)


def test_survival_bands(spark):
    rows = [("a", t, e) for t, e in ((1, 0), (2, 1), (2, 1), (3, 0), (5, 1), (6, 0))] + [("b", 4, 1)] + [("c", 7, 0)]
    got = {(r["g"], r["time"]): r for r in survival.kaplan_meier(spark.createDataFrame(rows, "g string, time int, event int"), "g").collect()}
    v, s = 2 / (5 * 3), 3 / 5
    r = got["a", 2]
    assert r["survival"] == pytest.approx(s) and r["std_error"] == pytest.approx(s * math.sqrt(v))
    width = 1.959963984540054 * math.sqrt(v) / abs(math.log(s))
    assert (r["ci_low"], r["ci_high"]) == pytest.approx((s ** math.exp(width), s ** math.exp(-width)))
    v, s = v + 1 / (2 * 1), s / 2
    assert got["a", 6]["ci_low"] == pytest.approx(s ** math.exp(1.959963984540054 * math.sqrt(v) / -math.log(s)))
    for key, end in ((("a", 1), 1.0), (("b", 4), 0.0), (("c", 7), 1.0)):
        assert (got[key]["survival"], got[key]["std_error"], got[key]["ci_low"], got[key]["ci_high"]) == (end, 0.0, end, end)


def plain_fisher(table):
    """All tables with the margins, one by one, in whole numbers."""
    rows, cols = [sum(r) for r in table], [sum(c) for c in zip(*table)]
    weights = []

    def fill(left, at, weight):
        if at == len(cols):
            weights.append(weight)
            return

        def column(i, open_, taken, w):
            if i == len(left):
                if not open_:
                    fill([a - b for a, b in zip(left, taken)], at + 1, w)
                return
            for k in range(min(left[i], open_) + 1):
                column(i + 1, open_ - k, [*taken, k], w * math.comb(left[i], k))

        column(0, cols[at], [], weight)

    fill(rows, 0, 1)
    seen = math.prod(math.comb(sum(r[j:]), r[j]) for r in table for j in range(len(r)))
    assert sum(weights) == math.prod(math.comb(sum(cols[j:]), c) for j, c in enumerate(cols))
    return sum(w for w in weights if w <= seen * (1 + 1e-9)) / sum(weights), len(weights)


@pytest.mark.parametrize("table", [[[3, 9, 4, 1, 7], [8, 2, 6, 12, 5]], [[0, 5, 5], [5, 0, 5], [4, 4, 0]], [[40, 3], [2, 30]], [[2, 1], [0, 3], [4, 0], [1, 1]], [[9, 8, 9], [7, 9, 8]], [[0, 4], [0, 6]]])
def test_fisher_network_equals_full_enumeration(spark, table):
    want, n = plain_fisher(table)
    got = stats.fisher_exact(_counts(spark, table), "g", "c").first()
    assert got["p_value"] == pytest.approx(want, rel=1e-7) and 0 <= got["states"] <= 2 * n + 2


def test_fisher_bounds_hold_and_settle(spark):
    rng = np.random.default_rng(4)
    for _ in range(60):
        m, j = rng.integers(2, 4), rng.integers(2, 4)
        k = rng.integers(0, 9, (m, j))
        most, least = stats._longest_shortest(k.sum(axis=1)[None].astype(float), k.sum(axis=0).astype(float))
        value = -sum(math.lgamma(x + 1) for x in k.ravel())
        assert least[0] - 1e-9 <= value <= most[0]
    # Of the tables of these margins a small part is looked at.
    got = stats.fisher_exact(_counts(spark, [[60, 75, 90, 110], [640, 700, 820, 900]]), "g", "c").first()
    assert got["states"] < 150_000 < 701 * 776 * 336 / 1000 and 0 < got["p_value"] < 1


def test_simulated_fisher_agrees_with_the_exact_one(spark):
    counts = _counts(spark, [[12, 5, 9], [6, 14, 11]])
    exact, drawn = stats.fisher_exact(counts, "g", "c").first(), stats.fisher_simulated(counts, "g", "c", 4000).first()
    assert abs(exact["p_value"] - drawn["p_value"]) <= 4 * drawn["std_error"]


def test_fisher_to_some_digits(spark, monkeypatch):
    # A table far from chance has a p-value of 0 to six decimals, however many tables its margins allow.
    far = stats.fisher_exact(_counts(spark, [[1366, 14083, 27044, 29981, 32009], [8396, 99455, 225472, 232135, 230059]]), "g", "c", digits=6).first()
    assert 0 <= far["p_value"] < 1e-9 and far["states"] < 1000
    monkeypatch.setattr(stats, "LOT", 7)
    for table in ([[5, 1, 4, 9], [6, 9, 3, 2]], [[3, 1, 2], [0, 4, 1], [2, 2, 5]], [[3, 15, 2], [6, 9, 8]]):
        plain, short = (stats.fisher_exact(_counts(spark, table), "g", "c", digits=d).first() for d in (None, 6))
        assert short["p_value"] == pytest.approx(plain["p_value"], abs=1e-9) and short["states"] <= plain["states"]
        assert plain["p_value"] == pytest.approx(plain_fisher(table)[0], rel=1e-7)
