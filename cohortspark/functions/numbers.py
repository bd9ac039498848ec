"""Numeric expressions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_bmi(bmi: Column) -> Column:
    """One decimal, kept when 12 <= x < 100, else null (NaN included)."""
    value = F.round(bmi.try_cast("double"), 1)
    return F.when(~F.isnan(value) & (value >= 12) & (value < 100), value)


def bmi_from(weight_oz: Column, height_in: Column) -> Column:
    """Body-mass index from ounces and inches."""
    kg, m = weight_oz / F.lit(35.274), height_in / F.lit(39.37)
    return F.when(m > 0, kg / (m * m))


def quintile_value(col: Column) -> Column:
    """Index in [0, 1], else null; text that is not a number is null too."""
    value = col.try_cast("double")
    return F.when(~F.isnan(value) & (value >= 0) & (value <= 1), value)


def grams(weight: Column) -> Column:
    """Weights under 500 are taken as ounces."""
    value = weight.cast("double")
    return F.when(value < 500, value * F.lit(28.3495)).otherwise(value)


def safe_ratio(num: Column, den: Column, min_den: int = 1) -> Column:
    return F.when(den >= min_den, num / den)
