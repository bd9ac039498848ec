"""Date expressions (Column -> Column)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM_DAYS = 280
INDEX_KINDS = ("year", "month", "day", "12-hour", "6-hour", "hour")


def age_years(birth: Column, at: Column) -> Column:
    return F.round(F.datediff(at, birth) / F.lit(365.25), 1)


def gestation_days(delivery: Column, due: Column) -> Column:
    return F.lit(TERM_DAYS) + F.datediff(delivery, due)


def pregnancy_start(delivery: Column, days: Column) -> Column:
    return F.date_sub(delivery, days)


def duration_days(start: Column, end: Column) -> Column:
    seconds = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return F.round(seconds / F.lit(86400), 2)


def time_index(ts: Column, kind: str) -> Column:
    """Text index of the calendar block a timestamp falls in ('2024', '2024-01', ..., '2024-01-05-02').

    The last field of the 12- and 6-hour kinds is the block number of the day, from 00.
    """
    if kind not in INDEX_KINDS:
        raise ValueError(f"kind must be one of {INDEX_KINDS}")
    if kind == "year":
        return F.date_format(ts, "yyyy")
    if kind == "month":
        return F.date_format(ts, "yyyy-MM")
    day = F.date_format(ts, "yyyy-MM-dd")
    if kind == "day":
        return day
    width = {"12-hour": 12, "6-hour": 6, "hour": 1}[kind]
    block = F.lpad(F.floor(F.hour(ts) / width).cast("string"), 2, "0")
    return F.when(ts.isNotNull(), F.concat_ws("-", day, block))


def defined_index(event: Column, reference: Column, bounds: Sequence[int] = (0,)) -> Column:
    """Number of (sorted) day bounds at or below ``event - reference``; null when either date is null."""
    diff = F.datediff(event, reference)
    bounds = sorted(bounds) or [0]
    total = F.lit(0)
    for b in bounds:
        total = total + F.when(diff >= b, 1).otherwise(0)
    return F.when(diff.isNotNull(), total)


def gestational_day(gest_days: Column, delivery: Column, event: Column) -> Column:
    return gest_days - F.datediff(delivery, event)


def days_from(start: Column | str, event: Column) -> Column:
    start = F.to_date(F.lit(start)) if isinstance(start, str) else start
    return F.datediff(event, start)


def delivery_or_estimate(delivery: Column, due: Column, lmp: Column, gest_days: Column) -> Column:
    """Delivery date, else due date, else last period plus gestation (280 days when unknown)."""
    days = F.when(gest_days > 0, gest_days).otherwise(TERM_DAYS)
    return F.coalesce(delivery, due, F.date_add(lmp, days))


def strictly_between(day: Column, start: Column, end: Column) -> Column:
    return F.coalesce((start < day) & (day < end), F.lit(False))


def before(day: Column, start: Column) -> Column:
    return F.coalesce(day < start, F.lit(False))
