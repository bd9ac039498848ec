"""Time-to-event frames, Kaplan-Meier curves and the log-rank test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.stats import Z95, one_degree_tail, with_p
from cohortspark.operators.timeline import daily, next_event

HORIZON_DAYS = 182


def censor_frame(df: DataFrame, positives: DataFrame, keys: Sequence[str], start: str, horizon: int = HORIZON_DAYS,
                 cutoff: str | None = None) -> DataFrame:
    """Adds time (days to the first positive after ``start``, at most ``horizon``) and the event flag.

    With ``cutoff`` also the days since the start date at the data cut-off; gestational age at the start when
    the rows carry a conception date.
    """
    per_day = daily(positives, keys, "test_date", {"_n": F.count(F.lit(1))}).drop("_n")
    found = next_event(df, per_day, keys, start, "test_date", inclusive=False, prefix="after_")
    days = F.datediff("after_test_date", start)
    event = F.coalesce(days < horizon, F.lit(False))
    out = found.withColumn("event", event.cast("int")).withColumn("time", F.when(event, days).otherwise(horizon))
    if cutoff:
        out = out.withColumn("days_since_start", F.datediff(F.to_date(F.lit(cutoff)), start))
    if "conception" in df.columns:
        out = out.withColumn("gest_age_at_start", F.datediff(start, "conception"))
    return out.drop("after_test_date")


def _by_time(df: DataFrame, group: str, time: str, event: str) -> DataFrame:
    """Events, leavers and numbers at risk per group and time; at most ``horizon + 1`` rows per group."""
    per = df.groupBy(group, time).agg(F.sum(event).alias("d"), F.count(F.lit(1)).alias("n_here"))
    later = Window.partitionBy(group).orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.withColumn("at_risk", F.sum("n_here").over(later))


def kaplan_meier(df: DataFrame, group: str, time: str = "time", event: str = "event", z: float = Z95) -> DataFrame:
    """Survival after each observed time, the running product of (1 - d / at risk), with ``std_error`` and a confidence band.

    The standard error is Greenwood's, from the running sum of d / (n (n - d)); the band has its limits on the log(-log) scale,
    so it stays inside 0 and 1. Where nobody has had an event (survival 1) and where nobody is left (0) the band is the
    curve itself and the error 0.
    """
    w = Window.partitionBy(group).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, d, s = F.col("at_risk"), F.col("d"), F.col("survival")
    curve = _by_time(df, group, time, event).withColumn("survival", F.product(1 - d / n).over(w)).withColumn(
        "_v", F.sum(F.coalesce(F.try_divide(d.cast("double"), n * (n - d)), F.lit(0.0))).over(w))
    inside = (s > 0) & (s < 1)
    width = F.when(inside, z * F.sqrt("_v") / F.abs(F.ln(s)))
    limit = lambda sign: F.when(inside, F.pow(s, F.exp(sign * width))).otherwise(s)
    return curve.select(group, time, "at_risk", "d", "survival", F.when(inside, s * F.sqrt("_v")).otherwise(0.0).alias("std_error"),
                        limit(1).alias("ci_low"), limit(-1).alias("ci_high"))


def logrank(df: DataFrame, group: str, time: str = "time", event: str = "event") -> DataFrame:
    """Two-group test: observed, expected and variance summed over event times, chi-square on 1 degree.

    ``group`` is 1 for the first group and 0 for the second.
    """
    per = df.groupBy(time).agg(
        F.sum(event).alias("d"), F.sum(F.col(event) * F.col(group)).alias("d1"),
        F.count(F.lit(1)).alias("n_here"), F.sum(group).alias("n1_here"))
    later = Window.orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = per.withColumn("n", F.sum("n_here").over(later).cast("double")).withColumn("n1", F.sum("n1_here").over(later).cast("double"))
    expected = F.col("d") * F.col("n1") / F.col("n")
    variance = F.when(F.col("n") > 1, F.col("d") * (F.col("n1") / F.col("n")) * (1 - F.col("n1") / F.col("n")) *
                      (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    total = at.agg(F.sum("d1").alias("observed"), F.sum(expected).alias("expected"), F.sum(variance).alias("variance"))
    gap = F.col("observed") - F.col("expected")
    tested = total.withColumn("chi_square", F.when(F.col("variance") > 0, gap * gap / F.col("variance")))
    return with_p(tested, one_degree_tail, "chi_square")
