"""Category encoders that are fitted once, stored, and applied to other frames.

A fitted encoder is a small table: ``column, value, code, n``, the codes numbering a column's values from 0, the most frequent first.
Applying it never looks at the data, so the columns that come out follow from the encoder alone; values it has not seen and
missing ones have places of their own.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNSEEN, MISSING = "unseen", "missing"
SCHEMA = "column string, value string, code int, n bigint"


def fit(df: DataFrame, columns: Sequence[str], least: int = 1) -> DataFrame:
    """The encoder of the given columns: every value that occurs in at least ``least`` rows; ties in text order. Nulls are no value."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counted = df.select(F.inline(cells)).where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    return counted.withColumn("code", (F.row_number().over(order) - 1).cast("int")).select("column", "value", "code", "n")


def save(encoder: DataFrame, path: str) -> None:
    encoder.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def values_of(encoder: DataFrame, most: int = 1000) -> dict[str, list[str]]:
    """Every column's values in the order of their codes. A column with more than ``most`` of them is no category: an error."""
    per = encoder.groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()
    wide = sorted(r["column"] for r in per if r["k"] > most)
    if wide:
        raise ValueError(f"more than {most} categories: {wide}")
    out: dict[str, list[str]] = {}
    for r in sorted(encoder.select("column", "code", "value").collect()):
        out.setdefault(r["column"], []).append(r["value"])
    return out


def slug(value: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", value.lower()).strip("_")


def _checked(columns: Sequence[str], values: dict[str, list[str]]) -> None:
    lacking = [c for c in columns if c not in values]
    if lacking:
        raise ValueError(f"the encoder has no values of {lacking}")


def one_hot(df: DataFrame, encoder: DataFrame, columns: Sequence[str], reference: bool = False, most: int = 1000) -> DataFrame:
    """``df`` with 0/1 columns ``<column>_<value>`` in place of each encoded one, and ``<column>_unseen`` and ``<column>_missing``.

    With ``reference`` the most frequent value gets no column, so that models with an intercept stay identified.
    """
    values = values_of(encoder, most)
    _checked(columns, values)
    out: list[Column] = [F.col(c) for c in df.columns if c not in columns]
    for c in columns:
        text = F.col(c).cast("string")
        named = [(f"{c}_{slug(v)}", text == v) for v in values[c][int(reference):]]
        named += [(f"{c}_{UNSEEN}", text.isNotNull() & ~text.isin(values[c])), (f"{c}_{MISSING}", text.isNull())]
        if len({n for n, _ in named}) < len(named):
            raise ValueError(f"values of {c} that differ in signs only: {values[c]}")
        out += [F.coalesce(on, F.lit(False)).cast("int").alias(n) for n, on in named]
    return df.select(*out)


def codes(df: DataFrame, encoder: DataFrame, columns: Sequence[str], most: int = 1000) -> DataFrame:
    """``df`` with each encoded column's value replaced by its code; -1 for an unseen value, null for a missing one."""
    values = values_of(encoder, most)
    _checked(columns, values)
    changed = {}
    for c in columns:
        text = F.col(c).cast("string")
        found = F.array_position(F.array(*[F.lit(v) for v in values[c]]), text) - 1
        changed[c] = F.when(text.isNotNull(), found.cast("int"))
    return df.withColumns(changed)
