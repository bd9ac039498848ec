"""Look-ups along a person's calendar without pairing rows.

Events are first reduced to one row per (key, day) and probes to distinct (key, day). A key therefore
holds at most two rows per calendar day in any window, however many records it owns, and the answers
go back to the probe rows by an equi-join on (key, day), which spreads a hot key over its days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily(events: DataFrame, keys: Sequence[str], day: str, aggs: dict[str, Column]) -> DataFrame:
    """One row per key and day (partial aggregation runs before the shuffle)."""
    return events.where(F.col(day).isNotNull()).groupBy(*keys, day).agg(*[c.alias(n) for n, c in aggs.items()])


def _grid(probes: DataFrame, per_day: DataFrame, keys: Sequence[str], probe_day: str, day: str,
          payload: Sequence[str]) -> DataFrame:
    marks = (
        probes.where(F.col(probe_day).isNotNull())
        .select(*keys, F.col(probe_day).alias("_day"))
        .distinct()
        .withColumn("_probe", F.lit(1))
    )
    seen = per_day.select(*keys, F.col(day).alias("_day"), F.struct(F.col(day).alias("_at"), *payload).alias("_event"))
    return marks.unionByName(seen.withColumn("_probe", F.lit(0)), allowMissingColumns=True)


def _nearest(probes, per_day, keys, probe_day, day, payload, inclusive, forward, prefix, first_before=None):
    payload = list(payload)
    grid = _grid(probes, per_day, keys, probe_day, day, payload)
    along = F.col("_day").desc() if forward else F.col("_day").asc()
    same_day = F.col("_probe").asc() if inclusive else F.col("_probe").desc()
    w = Window.partitionBy(*keys).orderBy(along, same_day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grid = grid.withColumn("_hit", F.last("_event", ignorenulls=True).over(w))
    extra = []
    if first_before:
        earlier = Window.partitionBy(*keys).orderBy(F.col("_day"), F.col("_probe").desc()).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        grid = grid.withColumn("_first", F.min("_event._at").over(earlier))
        extra = [F.col("_first").alias(first_before)]
    found = grid.where("_probe = 1").select(
        *keys, F.col("_day").alias(probe_day), F.col("_hit._at").alias(prefix + day),
        *[F.col(f"_hit.{p}").alias(prefix + p) for p in payload], *extra)
    return probes.join(found, [*keys, probe_day], "left")


def next_event(probes: DataFrame, per_day: DataFrame, keys: Sequence[str], probe_day: str, day: str,
               payload: Sequence[str] = (), inclusive: bool = False, prefix: str = "next_",
               first_before: str | None = None) -> DataFrame:
    """Adds the first event after (or on, when inclusive) the probe day; null when there is none.

    ``first_before`` names a column for the key's earliest event before the probe day, found in the same pass.
    """
    return _nearest(probes, per_day, keys, probe_day, day, payload, inclusive, True, prefix, first_before)


def last_event(probes: DataFrame, per_day: DataFrame, keys: Sequence[str], probe_day: str, day: str,
               payload: Sequence[str] = (), inclusive: bool = True, prefix: str = "last_") -> DataFrame:
    """Adds the last event before (or on, when inclusive) the probe day: an as-of join."""
    return _nearest(probes, per_day, keys, probe_day, day, payload, inclusive, False, prefix)


def window_reduce(probes: DataFrame, per_day: DataFrame, keys: Sequence[str], probe_day: str, day: str,
                  low: int, high: int, reduce: dict[str, Column]) -> DataFrame:
    """Aggregates daily values over [probe + low, probe + high] days, without producing pairs.

    ``reduce`` maps an output name to an aggregate over the per-day columns.
    """
    values = [c for c in per_day.columns if c not in [*keys, day]]
    marks = probes.where(F.col(probe_day).isNotNull()).select(*keys, F.col(probe_day).alias("_day")).distinct()
    grid = marks.withColumn("_probe", F.lit(1)).unionByName(
        per_day.select(*keys, F.col(day).alias("_day"), *values).withColumn("_probe", F.lit(0)),
        allowMissingColumns=True,
    ).withColumn("_n", F.unix_date("_day"))
    w = Window.partitionBy(*keys).orderBy("_n").rangeBetween(low, high)
    found = (
        grid.select("*", *[c.over(w).alias(n) for n, c in reduce.items()])
        .where("_probe = 1")
        .select(*keys, F.col("_day").alias(probe_day), *reduce)
    )
    return probes.join(found, [*keys, probe_day], "left")


def count_between(probes: DataFrame, events: DataFrame, keys: Sequence[str], start: str, end: str, day: str,
                  out: str = "n_events") -> DataFrame:
    """Events with start <= day <= end per probe row: the running count at ``end`` minus that of the day before ``start``.

    Both ends are looked up in one running count per key and calendar day.
    """
    keys = list(keys)
    per_day = daily(events, keys, day, {"_c": F.count(F.lit(1))}).withColumnRenamed(day, "_day")
    ends = F.explode(F.array(F.col(end), F.date_sub(start, 1))).alias("_day")
    marks = probes.select(*keys, ends).where("_day is not null").distinct().withColumn("_c", F.lit(0).cast("bigint"))
    both = per_day.withColumn("_probe", F.lit(0)).unionByName(marks.withColumn("_probe", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy("_day", "_probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = both.withColumn("_cum", F.sum("_c").over(w)).where("_probe = 1").select(*keys, "_day", "_cum")
    at_end = running.withColumnsRenamed({"_day": end, "_cum": "_hi"})
    at_start = running.withColumnsRenamed({"_day": "_from", "_cum": "_lo"})
    found = probes.withColumn("_from", F.date_sub(start, 1)).join(at_end, [*keys, end], "left").join(at_start, [*keys, "_from"], "left")
    n = F.greatest(F.coalesce("_hi", F.lit(0)) - F.coalesce("_lo", F.lit(0)), F.lit(0))
    return found.select(*probes.columns, n.alias(out))
