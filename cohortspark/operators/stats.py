"""Statistics over grouped counts and moments. Rows are aggregated on the cluster; tails are taken on results."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.operators.ranks import exact_quantiles, one_row, running_totals
from cohortspark.session import durable

Z95 = 1.959963984540054


# ---- tails -------------------------------------------------------------------------------------------------------

def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
            d = 1 / d
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    b, c = x + 1 - a, 1e300
    d = 1 / b
    out = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2
        d, c = 1 / (num * d + b), b + num / c
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out * scale


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_tail(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def r_tail(r: float, n: float) -> float:
    """Tail of a correlation of n pairs; two pairs or fewer say nothing."""
    if n <= 2:
        return 1.0
    return t_tail(r * math.sqrt((n - 2) / (1 - r * r)), n - 2) if r * r < 1 else 0.0


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_tail(x: float, df: float) -> float:
    """1 without degrees of freedom: a table of one row or column cannot differ."""
    return gamma_upper(df / 2, x / 2) if df > 0 else 1.0


def one_degree_tail(x: float) -> float:
    return chi2_tail(x, 1)


# Fixed value: samples up to this size, without ties, have their rank sums counted instead of approximated.
EXACT_RANKS = 8


def rank_sum_exact(u: float, n1: float, n0: float) -> float:
    """Two-sided tail of U among all ways to deal untied ranks to samples of the given sizes.

    The number of ways with each U are the coefficients of a product of (1 - q^(n+i)) / (1 - q^i), one factor per member of the
    smaller sample; they are symmetric, so only those up to the nearer end are worked out.
    """
    m, n = int(min(n1, n0)), int(max(n1, n0))
    near = round(min(u, m * n - u))
    ways = np.zeros(near + 1)
    ways[0] = 1.0
    for i in range(1, m + 1):
        if n + i <= near:
            ways[n + i:] -= ways[:near + 1 - n - i].copy()
        for first in range(min(i, near + 1)):
            ways[first::i] = np.cumsum(ways[first::i])
    return min(1.0, 2 * math.exp(math.log(ways.sum()) - math.lgamma(m + n + 1) + math.lgamma(m + 1) + math.lgamma(n + 1)))


def rank_sum_tail(z: float, u: float, n1: float, n0: float, exact: float) -> float:
    return rank_sum_exact(u, n1, n0) if exact else normal_tail(z)


def with_p(df: DataFrame, tail, *inputs: str, out: str = "p_value") -> DataFrame:
    """Adds a two-sided tail to a result frame (one row per test, so plain values in Arrow batches suffice)."""
    @F.pandas_udf(T.DoubleType())
    def p(*cols: pd.Series) -> pd.Series:
        return pd.Series([tail(*map(float, v)) if all(x is not None and x == x for x in v) else None for v in zip(*cols)],
                         dtype="float64")

    return df.withColumn(out, p(*[F.col(c).cast("double") for c in inputs]))


def ln_factorial(n: Column) -> Column:
    """ln(n!) as an expression: exact values up to 20, Stirling's series above (error under 1e-12)."""
    small = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(21)])
    x = F.greatest(n, F.lit(20)).cast("double")
    series = ((x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
              + 1 / (1260 * F.pow(x, F.lit(5.0))))
    return F.when(n <= 20, F.get(small, n.cast("int"))).otherwise(series)


# ---- contingency tables ------------------------------------------------------------------------------------------

def contingency(df: DataFrame, group: str, category: str) -> DataFrame:
    return df.where(F.col(category).isNotNull()).groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))


def fisher_2x2(df: DataFrame, group: str, flag: str) -> DataFrame:
    """Exact two-sided test of a 0/1 flag between groups 1 and 0, and the sample odds ratio."""
    g, f = F.col(group).cast("int"), F.col(flag).cast("int")
    cell = lambda i, j: F.coalesce(F.sum(((g == i) & (f == j)).cast("bigint")), F.lit(0))
    row = df.agg(cell(1, 1).alias("a"), cell(1, 0).alias("b"), cell(0, 1).alias("c"), cell(0, 0).alias("d")).first()
    return fisher_tables(df.sparkSession, [tuple(row)]).drop("test")


def fisher_tables(spark, tables: Sequence[tuple[int, int, int, int]]) -> DataFrame:
    """The test for a handful of 2 x 2 tables (a, b, c, d): total probability of the tables no likelier than the observed one.

    The supports of all tests lie one after the other on one range, which is spread over the cluster.
    """
    specs, start = [], 0
    for a, b, c, d in tables:
        r1, c1, n = a + b, a + c, a + b + c + d
        low, high = max(0, c1 - (n - r1)), min(r1, c1)
        mode = max(low, min(high, (r1 + 1) * (c1 + 1) // (n + 2)))
        specs.append((start, low, r1, c1, n - r1 - c1, a, mode))
        start += high - low + 1
    rows = spark.range(start)
    test = F.lit(0)
    for i, spec in enumerate(specs[1:], 1):
        test = F.when(F.col("id") >= spec[0], F.lit(i)).otherwise(test)
    rows = rows.withColumn("test", test)
    part = lambda j: F.get(F.array(*[F.lit(s[j]).cast("bigint") for s in specs]), F.col("test"))
    k = F.col("id") - part(0) + part(1)

    def ln_p(x: Column) -> Column:
        return -(ln_factorial(x) + ln_factorial(part(2) - x) + ln_factorial(part(3) - x) + ln_factorial(part(4) + x))

    # Probabilities are taken relative to the mode, so neither end of a long support overflows.
    rel = rows.select("test", F.exp(ln_p(k) - ln_p(part(6))).alias("p"), (ln_p(k) <= ln_p(part(5)) + 1e-7).alias("counted"))
    found = rel.groupBy("test").agg(F.least(F.sum(F.when(F.col("counted"), F.col("p")).otherwise(0.0)) / F.sum("p"), F.lit(1.0)).alias("p_value"))
    counts = [(i, a, b, c, d, a * d / (b * c) if b * c else None) for i, (a, b, c, d) in enumerate(tables)]
    names, types = ("a", "b", "c", "d", "odds_ratio"), ("bigint",) * 4 + ("double",)
    of = lambda j, t: F.get(F.array(*[F.lit(r[j + 1]).cast(t) for r in counts]), F.col("test"))
    return found.select("test", *[of(j, t).alias(x) for j, (x, t) in enumerate(zip(names, types))], "p_value")


def _table(counts: DataFrame, group: str, category: str) -> np.ndarray:
    """Contingency counts as a matrix. One number per cell: bounded by groups x categories, never rows."""
    rows = counts.select(group, category, "n").collect()
    gs, cs = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    out = np.zeros((len(gs), len(cs)), dtype=np.int64)
    for g, c, n in rows:
        out[gs.index(g), cs.index(c)] = n
    return out


def fisher_simulated(counts: DataFrame, group: str, category: str, replicates: int = 2000, seed: int = 31415) -> DataFrame:
    """r x c test with a simulated p-value: replicates are drawn on the executors with both margins fixed.

    Every replicate is seeded by its id, so the answer does not depend on partitioning.
    """
    spark, table = counts.sparkSession, _table(counts, group, category)
    if min(table.shape, default=0) < 2:
        return spark.range(1).select(F.lit(1.0).alias("p_value"), F.lit(0.0).alias("std_error"), F.lit("simulated").alias("method"))
    rows, cols = table.sum(axis=1), table.sum(axis=0)
    lgam = np.vectorize(math.lgamma)
    observed = -lgam(table + 1.0).sum()

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = []
            for i in batch["id"]:
                rng, left, stat = np.random.default_rng([seed, int(i)]), cols.copy(), 0.0
                for r in rows[:-1]:
                    take = rng.multivariate_hypergeometric(left, r, method="marginals")
                    left = left - take
                    stat -= lgam(take + 1.0).sum()
                stat -= lgam(left + 1.0).sum()
                hits.append(int(stat <= observed + 1e-7 * abs(observed)))
            yield pd.DataFrame({"hit": hits})

    drawn = spark.range(replicates).mapInPandas(draw, "hit int")
    p = (F.sum("hit") + 1) / F.lit(replicates + 1)
    return drawn.agg(p.alias("p_value")).withColumn("std_error", F.sqrt(F.col("p_value") * (1 - F.col("p_value")) / replicates)).withColumn(
        "method", F.lit("simulated"))


def _ln_factorials(x: np.ndarray) -> np.ndarray:
    """ln of x! for real x from 0 on: Stirling's series nine steps up."""
    z, below = x + 9.0, np.ones_like(x, dtype=float)
    for i in range(1, 9):
        below = below * (x + i)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) - np.log(below)


def _digammas(x: np.ndarray) -> np.ndarray:
    """Slope of ln x! for real x from 0 on."""
    z = x + 9.0
    out = np.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6)
    for i in range(1, 9):
        out = out - 1 / (x + i)
    return out


def _longest_shortest(left: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds from above and below for the sum of -ln k! over all ways to fill the remaining columns; ``left`` has a row of
    remaining row margins per state.

    The sum is concave, so it lies below its tangent at the proportional table. There the tangent's slope is a row part, a column
    part, both fixed by the margins, and a rest of about -1 / 2k, which is bounded by its best cell of each column or row. From
    below: the cells of a column or row together never have a larger product of factorials than one cell with their sum.
    """
    if len(cols) == 1:
        only = -_ln_factorials(left).sum(axis=1)
        return only, only
    total = left.sum(axis=1)
    even = left[:, :, None] * cols / np.maximum(total, 1.0)[:, None, None]
    held = even > 0
    rest = np.where(held, np.log(np.where(held, even, 1.0)) - _digammas(even), -np.inf)
    by_col = np.where(cols > 0, np.where(np.isfinite(best := rest.max(axis=1)), best, 0.0) * cols, 0.0).sum(axis=1)
    by_row = np.where(left > 0, np.where(np.isfinite(best := rest.max(axis=2)), best, 0.0) * left, 0.0).sum(axis=1)
    most = -_ln_factorials(even).sum(axis=(1, 2)) - np.where(held, np.where(held, rest, 0.0) * even, 0.0).sum(axis=(1, 2)) + np.minimum(by_col, by_row)
    least = np.maximum(-_ln_factorials(cols).sum(), -_ln_factorials(left).sum(axis=1))
    return most + 1e-9, least


# A child whose tables together weigh less than e^-50 of the observed one is left out; the p-value is at least the latter's weight.
NEGLIGIBLE = 50.0
# With ``digits``, all that is left out together weighs less than this part of the last digit; states go on in lots of LOT rows.
SPARE, LOT = 1e-4, 20_000


def _ln_fillings(left: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """ln of a number that the ways to fill all columns ``cols`` cannot exceed, per line of remaining row margins ``left``: every
    column but the last has at most margin + 1 choices for each row but one."""
    return sum((np.log1p(np.minimum(left[:, :-1], c)).sum(axis=1) for c in cols[:-1]), np.zeros(len(left)))


def _column_choices(left: np.ndarray, column: int, weigh, floor: float) -> Iterator[np.ndarray]:
    """All ways to fill a column from the remaining row margins, as matrices of one way per line, without those ``weigh`` puts under
    ``floor``. All rows but the last two are gone through one by one; the last two share what is left, by one vector."""
    def heads(i: int, open_: int) -> Iterator[list[int]]:
        if i == len(left) - 2:
            yield []
            return
        for k in range(max(0, open_ - int(left[i + 1:].sum())), min(int(left[i]), open_) + 1):
            for more in heads(i + 1, open_ - k):
                yield [k, *more]

    x, y = int(left[-2]), int(left[-1])
    for head in heads(0, column):
        open_ = column - sum(head)
        low, high = max(0, open_ - y), min(x, open_)
        of = lambda k: np.column_stack([*[np.full(len(k), h) for h in head], k, open_ - k])  # noqa: B023, E731
        mean = open_ * x / max(x + y, 1)
        spread = math.sqrt(mean * y / max(x + y, 1)) + 1
        reach = 8 * spread
        while True:
            # The weight falls on both sides of its peak, so what lies behind an end under the floor is under it too.
            a, b = max(low, math.floor(mean - reach)), min(high, math.ceil(mean + reach))
            ends = weigh(of(np.array([a, b])))
            if (a == low or ends[0] < floor) and (b == high or ends[1] < floor):
                break
            reach *= 2
        yield of(np.arange(a, b + 1))


def fisher_exact(counts: DataFrame, group: str, category: str, digits: int | None = None) -> DataFrame:
    """Exact r x c test: ``p_value, std_error, method, states``, over all tables with the observed margins.

    Tables are built one column at a time. A state is what is left of the row margins with the log weight so far; states that
    agree are merged with their number of ways. What the columns still to come can add at most and at least (the longest and
    shortest path through the network of states) settles most states at once: if even the likeliest completion is no likelier
    than the observed table, all completions count, with a weight in closed form; if even the least likely one is likelier, none
    does. Only the states between are carried on. ``states`` is the number of states looked at.

    Without ``digits`` even the smallest p-value has all its digits. With it the p-value is found to that many decimals: the tables
    that count have the observed one's weight at most, so their number, bounded by the margins, bounds what a state can add; states
    are left out that all together cannot add SPARE of the last decimal. There is no size limit;
    ``fisher_simulated`` is the choice for tables too rich even so.
    """
    spark, table = counts.sparkSession, _table(counts, group, category)
    if min(table.shape, default=0) < 2:
        return spark.range(1).select(F.lit(1.0).alias("p_value"), F.lit(0.0).alias("std_error"), F.lit("exact").alias("method"), F.lit(0).cast("bigint").alias("states"))
    table = table if table.shape[0] <= table.shape[1] else table.T
    rows, cols = np.sort(table.sum(axis=1)), np.sort(table.sum(axis=0))
    ln_all = float(_ln_factorials(np.array([rows.sum()], float))[0] - _ln_factorials(rows.astype(float)).sum() - _ln_factorials(cols.astype(float)).sum())
    ln_seen = float(-_ln_factorials(table.astype(float)).sum())
    # What one way to a state may be left out with: the spare part, shared among the steps and all the ways there can be.
    spare = -math.inf if digits is None else math.log(SPARE) - digits * math.log(10) - math.log(len(cols))
    whole = rows[None].astype(float)
    settled = float(_ln_fillings(whole, cols.astype(float))[0]) + ln_seen + 1e-7 - ln_all <= spare

    def step(at: int):
        column, rest = int(cols[at]), cols[at + 1:].astype(float)
        share = ln_all + spare - float(_ln_fillings(whole, cols[:at + 2].astype(float))[0])
        floor = max(ln_seen - NEGLIGIBLE, share)
        ln_rest = _ln_factorials(np.array([rest.sum()]))[0] - _ln_factorials(rest).sum()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                inside, seen, kept = 0.0, 0, []
                for left, lp, ways in zip(batch["r"], batch["lp"], batch["ways"]):
                    left = np.asarray(left, dtype=np.int64)
                    path = lambda k: lp - _ln_factorials(k.astype(float)).sum(axis=1)  # noqa: B023, E731
                    mass = lambda k: path(k) + ln_rest - _ln_factorials((left - k).astype(float)).sum(axis=1)  # noqa: B023, E731
                    for k in _column_choices(left, column, mass, floor):
                        after = left - k
                        most, least = _longest_shortest(after.astype(float), rest)
                        so_far = path(k)
                        all_in = so_far + most <= ln_seen + 1e-7
                        inside += ways * float(np.exp(mass(k[all_in]) - ln_all).sum())
                        seen += len(k)
                        adds = _ln_fillings(after.astype(float), rest) + ln_seen + 1e-7 > share
                        for i in np.flatnonzero(~all_in & adds & (so_far + least <= ln_seen + 1e-7)):
                            kept.append((after[i].tolist(), float(so_far[i]), ways, None, None))
                        if len(kept) >= LOT:
                            yield pd.DataFrame(kept, columns=["r", "lp", "ways", "inside", "seen"])
                            kept = []
                yield pd.DataFrame([*kept, (None, None, None, inside, seen)], columns=["r", "lp", "ways", "inside", "seen"])

        return run

    schema, total, seen = "r array<bigint>, lp double, ways double, inside double, seen bigint", 0.0, 0
    states = spark.createDataFrame([([int(x) for x in rows], 0.0, 1.0)], "r array<bigint>, lp double, ways double")
    for at in range(0 if settled else len(cols) - 1):
        # Few rows can be much work, so they are spread by number and not by size.
        spread = states.repartition(4 * spark.sparkContext.defaultParallelism, "r", "lp")
        found = durable(spread.mapInPandas(step(at), schema))
        part = found.agg(F.sum("inside"), F.sum("seen")).first()
        total, seen = total + (part[0] or 0.0), seen + (part[1] or 0)
        states = found.where("r IS NOT NULL").groupBy("r", F.round("lp", 9).alias("lp")).agg(F.sum("ways").alias("ways"))
    return spark.range(1).select(F.lit(min(total, 1.0)).alias("p_value"), F.lit(0.0).alias("std_error"), F.lit("exact").alias("method"), F.lit(seen).cast("bigint").alias("states"))


def chi_square_independence(counts: DataFrame, group: str, category: str) -> DataFrame:
    """Statistic, degrees of freedom and p-value of a table given as counts, zero cells included."""
    # Sum of (o - e)^2 / e over all cells equals N * (sum of o^2 / (row * column) - 1), which needs occupied cells only.
    row, col = F.sum("n").over(Window.partitionBy(group)), F.sum("n").over(Window.partitionBy(category))
    part = counts.select(group, category, "n", (F.col("n") * F.col("n") / (row * col)).alias("_q")).agg(
        F.sum("_q").alias("_q"), F.sum("n").alias("n"), F.count_distinct(group).alias("_r"), F.count_distinct(category).alias("_k"))
    return with_p(part.select((F.col("n") * (F.col("_q") - 1)).alias("chi_square"),
                              (F.greatest(F.col("_r") - 1, F.lit(0)) * F.greatest(F.col("_k") - 1, F.lit(0))).alias("df"), "n"), chi2_tail, "chi_square", "df")


def chi_square_fit(observed: DataFrame, expected: DataFrame, category: str) -> DataFrame:
    """Goodness of fit of observed counts to another group's counts scaled to the same total.

    Every category of either side counts. The statistic is null where one was observed that is not expected at all, and
    where nothing was observed.
    """
    sides = observed.select(category, F.col("n").alias("o"), F.lit(0).alias("e")).unionByName(
        expected.select(category, F.lit(0).alias("o"), F.col("n").alias("e")))
    both = sides.groupBy(category).agg(F.sum("o").alias("o"), F.sum("e").alias("e")).where("o > 0 OR e > 0")
    t = both.agg(F.sum("o").alias("_o"), F.sum("e").alias("_e"), F.sum(F.when(F.col("e") > 0, F.col("o") * F.col("o") / F.col("e"))).alias("_q"),
                 F.count(F.lit(1)).alias("_k"), F.coalesce(F.bool_or((F.col("e") == 0) & (F.col("o") > 0)), F.lit(False)).alias("_new"))
    # With e scaled by _o/_e: sum (o - e')^2 / e' = _q * _e / _o - _o.
    fit = t.select(F.when(~F.col("_new"), F.try_divide(F.col("_q") * F.col("_e"), F.col("_o")) - F.col("_o")).alias("chi_square"), F.greatest(F.col("_k") - 1, F.lit(0)).alias("df"))
    return with_p(fit, chi2_tail, "chi_square", "df")


def chi_square_features(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Chi-square of every categorical feature against the label from one pass over the rows."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])
    long = df.select(F.col(label).cast("string").alias("label"), F.inline(cells))
    n = long.groupBy("feature", "value", "label").agg(F.count(F.lit(1)).alias("n"))
    by_v, by_l = (F.sum("n").over(Window.partitionBy("feature", c)) for c in ("value", "label"))
    q = n.select("feature", "value", "label", "n", (F.col("n") * F.col("n") / (by_v * by_l)).alias("_q")).groupBy("feature").agg(
        F.sum("_q").alias("_q"), F.sum("n").alias("_n"), F.count_distinct("value").alias("_k"), F.count_distinct("label").alias("_m"))
    out = q.select("feature", (F.col("_n") * (F.col("_q") - 1)).alias("chi_square"), ((F.col("_k") - 1) * (F.col("_m") - 1)).alias("df"))
    return with_p(out, chi2_tail, "chi_square", "df")


# ---- two-sample tests --------------------------------------------------------------------------------------------

def t_test(df: DataFrame, group: str, value: Column) -> DataFrame:
    """Pooled two-sample t from moments; null values are dropped. Null where both groups are constant or one has no value."""
    v = value.cast("double")
    side = lambda f, k: f(F.when(F.col(group) == k, v))
    m = df.agg(side(F.count, 1).alias("n_1"), side(F.count, 0).alias("n_0"), side(F.avg, 1).alias("mean_1"), side(F.avg, 0).alias("mean_0"),
               side(F.var_samp, 1).alias("_v1"), side(F.var_samp, 0).alias("_v0"))
    dof = F.col("n_1") + F.col("n_0") - 2
    # A group of one value has no variance of its own and adds nothing to the pooled one.
    spread = lambda k: (F.col(f"n_{k}") - 1) * F.coalesce(F.col(f"_v{k}"), F.lit(0.0))
    pooled = F.try_divide(spread(1) + spread(0), dof)
    t = F.try_divide(F.col("mean_1") - F.col("mean_0"), F.sqrt(pooled * (F.try_divide(F.lit(1.0), "n_1") + F.try_divide(F.lit(1.0), "n_0"))))
    return with_p(m.select("n_1", "n_0", "mean_1", "mean_0", t.alias("t"), dof.alias("df")), t_tail, "t", "df")


def mann_whitney(df: DataFrame, group: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank-sum test of groups 1 and 0, one row (or one per ``keys``): ``n_1, n_0, u, z, method, p_value``.

    ``method`` is exact for samples without ties of which one has ``EXACT_RANKS`` values or fewer: U is counted among all ways to
    deal the ranks. Else the normal tail is taken, with tie and continuity correction. z and p_value are null for the latter
    where one group is empty or all values are equal. Null values and groups take no part.

    Rows are counted per distinct value and group first; mid-ranks come from running totals over the values.
    """
    g, keys = F.col(group).cast("int"), list(keys)
    counts = df.where(F.col(value).isNotNull() & g.isin(0, 1)).groupBy(*keys, value).agg(
        F.sum((g == 1).cast("bigint")).alias("_c1"), F.sum((g == 0).cast("bigint")).alias("_c0"))
    run = running_totals(counts, keys, [value], {"_upto": F.col("_c1") + F.col("_c0")})
    t = (F.col("_c1") + F.col("_c0")).cast("double")
    mid = F.col("_upto") - t / 2 + 0.5
    total = lambda c: F.coalesce(F.sum(c).cast("double"), F.lit(0.0))
    s = run.groupBy(*keys).agg(total("_c1").alias("n_1"), total("_c0").alias("n_0"), total(F.col("_c1") * mid).alias("_r1"), total(t * t * t - t).alias("_tie"))
    n = F.col("n_1") + F.col("n_0")
    u = F.col("_r1") - F.col("n_1") * (F.col("n_1") + 1) / 2
    mean = F.col("n_1") * F.col("n_0") / 2
    var = F.col("n_1") * F.col("n_0") / 12 * ((n + 1) - F.try_divide(F.col("_tie"), n * (n - 1)))
    z = F.try_divide(u - mean - F.signum(u - mean) * 0.5, F.sqrt(F.when(var > 1e-9, var)))
    exact = (F.col("_tie") == 0) & F.least("n_1", "n_0").between(1, EXACT_RANKS)
    out = s.select(*keys, F.col("n_1").cast("bigint").alias("n_1"), F.col("n_0").cast("bigint").alias("n_0"), u.alias("u"), z.alias("z"),
                   F.when(exact, "exact").otherwise("asymptotic").alias("method"))
    return with_p(out.withColumn("_exact", (F.col("method") == "exact").cast("int")), rank_sum_tail, "z", "u", "n_1", "n_0", "_exact").drop("_exact")


# ---- proportions and association ---------------------------------------------------------------------------------

def wilson(events: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval of a proportion; ``total`` is the number of observations. Null without any."""
    n = F.nullif(total.cast("double"), F.lit(0.0))
    p = events / n
    centre, half = (p + z * z / (2 * n)), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return (centre - half) / scale, (centre + half) / scale


def protection_rate(df: DataFrame, group: str, infected: Column) -> DataFrame:
    """Share without infection per group with its interval."""
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(infected, 0).otherwise(1)).cast("bigint").alias("n_protected"))
    low, high = wilson(F.col("n_protected"), F.col("n"))
    return n.withColumn("rate", F.col("n_protected") / F.col("n")).withColumn("ci_low", low).withColumn("ci_high", high)


def pairwise_fisher(rates: DataFrame, group: str) -> DataFrame:
    """Exact tests between all groups of a protection table (one row per group, a handful of groups)."""
    rows = sorted(rates.select(group, "n", "n_protected").collect())
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[i + 1:]]
    tests = fisher_tables(rates.sparkSession, [(a[2], a[1] - a[2], b[2], b[1] - b[2]) for a, b in pairs])
    name = lambda j: F.get(F.array(*[F.lit(p[j][0]) for p in pairs]), F.col("test"))
    return tests.select(name(0).alias("group_1"), name(1).alias("group_2"), "odds_ratio", "p_value")


def _correlation(x: Column, y: Column) -> Column:
    """Correlation over the rows that have both; null where one of them is constant."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.var_pop(F.when(both, x)) * F.var_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.when(spread > 0, spread)))


def pearson(df: DataFrame, columns: Sequence[str], outcome: str) -> DataFrame:
    """Correlation of every column with the outcome, number of pairs and p-value, in one aggregate. Null for constant columns."""
    x, y = [F.col(c).cast("double") for c in columns], F.col(outcome).cast("double")
    row = df.agg(*[_correlation(c, y).alias(f"_r{i}") for i, c in enumerate(x)],
                 *[F.count(F.when(c.isNotNull() & y.isNotNull(), 1)).alias(f"_n{i}") for i, c in enumerate(x)])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_r{i}").alias("r"), F.col(f"_n{i}").alias("n")) for i, c in enumerate(columns)])
    return with_p(row.select(F.inline(cells)), r_tail, "r", "n")


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """1 / (1 - R2) of each column on the others, from the p x p correlation matrix, which is built on the cluster.

    Infinite for a column that the others make up exactly; null for a constant one, which takes no part for the others either.
    """
    cols = list(columns)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1)]
    row = df.agg(*[_correlation(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")).alias(f"_{i}_{j}") for i, j in pairs]).first()
    used = [i for i in range(len(cols)) if row[f"_{i}_{i}"] is not None]
    m = np.array([[row[f"_{max(i, j)}_{min(i, j)}"] or 0.0 for j in used] for i in used]).reshape(len(used), len(used))
    found = dict.fromkeys(range(len(cols)))
    for at, i in enumerate(used):
        others = np.delete(np.arange(len(used)), at)
        r = m[at, others]
        left = 1 - float(r @ np.linalg.pinv(m[np.ix_(others, others)], rcond=1e-10) @ r)
        found[i] = 1 / left if left > 1e-10 else math.inf
    return df.sparkSession.createDataFrame([(c, found[i]) for i, c in enumerate(cols)], "feature string, vif double")


def repeated_anova(df: DataFrame, subject: str, condition: str, value: str) -> DataFrame:
    """One-way repeated-measures F from sums of squares (one value per subject and condition). Null where there is one
    condition or one subject, or where nothing is left over after both."""
    per_s = df.groupBy(subject).agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_k"))
    per_c = df.groupBy(condition).agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_nk"), F.avg(value).alias("_g"), F.var_pop(value).alias("_v"))
    s = per_s.agg((F.sum(F.col("_k") * F.col("_m") * F.col("_m"))).alias("_ss"), F.count(F.lit(1)).alias("_s"))
    c = per_c.agg((F.sum(F.col("_n") * F.col("_m") * F.col("_m"))).alias("_cc"), F.count(F.lit(1)).alias("_c"))
    t = one_row(total, s, c)
    grand = F.col("_nk") * F.col("_g") * F.col("_g")
    ss_total, ss_s, ss_c = F.col("_nk") * F.col("_v"), F.col("_ss") - grand, F.col("_cc") - grand
    df1, df2 = F.col("_c") - 1, (F.col("_c") - 1) * (F.col("_s") - 1)
    rest = ss_total - ss_s - ss_c
    f = F.try_divide(F.try_divide(ss_c, df1), F.try_divide(F.when(rest > 1e-12 * ss_total, rest), df2))
    return with_p(t.select(f.alias("f"), df1.alias("df_1"), df2.alias("df_2")), f_tail, "f", "df_1", "df_2")


# ---- distributions -----------------------------------------------------------------------------------------------

def qq_pairs(df: DataFrame, value: str, points: int = 19) -> DataFrame:
    """Sample quantiles against normal quantiles at evenly spaced probabilities."""
    probs = {f"q{i}": (i + 1) / (points + 1) for i in range(points)}
    row = exact_quantiles(df, [], value, probs)
    cells = F.array(*[F.struct(F.lit(p).alias("prob"), F.lit(NormalDist().inv_cdf(p)).alias("normal"), F.col(n).alias("sample"))
                      for n, p in probs.items()])
    return row.select(F.inline(cells))


def group_samples(df: DataFrame, keys: Sequence[str], value: str, min_rows: int = 10) -> DataFrame:
    """Box summary per group; groups under ``min_rows`` values are left out, as in the charts they feed."""
    probs = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    return exact_quantiles(df, keys, value, probs, "n").where(F.col("n") >= min_rows)
