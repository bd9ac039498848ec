"""Array expressions. Past-the-end access gives null instead of an ANSI error."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def nth_distinct(arr: Column, n: int) -> Column:
    """n-th (from 1) distinct element, in first-seen order."""
    return F.get(F.array_distinct(arr), F.lit(n - 1))


def count_distinct_elements(arr: Column) -> Column:
    return F.size(F.array_distinct(arr))


def first_where(arr: Column, cond: Callable[[Column], Column]) -> Column:
    """First element that satisfies ``cond``, else null."""
    return F.get(F.filter(arr, cond), F.lit(0))


def first_match(dates: Column, results: Column, wanted: str, low: Column, high: Column) -> Column:
    """First date in [low, high] whose parallel result equals ``wanted``."""
    pairs = F.zip_with(dates, results, lambda d, r: F.struct(d.alias("d"), r.alias("r")))
    hit = first_where(pairs, lambda p: (p["r"] == wanted) & (p["d"] >= low) & (p["d"] <= high))
    return hit["d"]


def any_covers(dates: Column, day: Column, months: int = 6) -> Column:
    """Some date d has d < day < d + months."""
    return F.coalesce(F.exists(dates, lambda d: (d < day) & (day < F.add_months(d, months))), F.lit(False))


def overlaps(arr: Column, codes: Sequence[str]) -> Column:
    """Any element is one of ``codes``; null arrays do not match."""
    return F.coalesce(F.arrays_overlap(arr, F.array(*[F.lit(c) for c in codes])), F.lit(False))


def results_category(results: Column) -> Column:
    return (
        F.when(F.array_contains(results, "positive"), ">= 1 positive")
        .when(F.array_contains(results, "negative"), ">= 1 negative (no positive)")
        .otherwise("inconclusive or unknown")
    )


def coverage_of_results(n_positive: Column, n_negative: Column) -> Column:
    """The same category from counts, so no list of results has to be gathered."""
    return (
        F.when(n_positive > 0, ">= 1 positive")
        .when(n_negative > 0, ">= 1 negative (no positive)")
        .otherwise("inconclusive or unknown")
    )
