"""Join shapes that recur in cohort work."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.ranks import same_keys
from cohortspark.session import broadcast_if_small


def with_flag(df: DataFrame, members: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """1 when the key is in ``members``, else 0: replaces a split into two halves and their union."""
    marked = members.select(*keys).distinct().withColumn(out, F.lit(1))
    return df.join(marked, list(keys), "left").withColumn(out, F.coalesce(out, F.lit(0)))


def fan_out(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to a table with many rows per key; the left side is read once, and adaptive execution splits its hot keys."""
    return left.join(right, list(keys), "left")


def left_with_condition(left: DataFrame, right: DataFrame, keys: Sequence[str], residual: Column) -> DataFrame:
    """Left outer join whose extra condition is part of ON, so unmatched left rows stay.

    ``residual`` refers to columns of either side; key columns come from the left.
    """
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_r_{k}") for k in keys]) & residual
    return left.join(renamed, on, "left").drop(*[f"_r_{k}" for k in keys])


def spine_join(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of tables that have one row per key (null is a key): their union, folded by one aggregate."""
    values = [c for s in sources for c in s.columns if c not in keys]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    return stacked.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in values])


def parent_child(df: DataFrame, type_col: str, parent_type: str, child_type: str, key: str, parent_ref: str,
                 child_columns: Sequence[str]) -> DataFrame:
    """Splits one table by type and hangs the child rows under their parents (parents without one stay)."""
    parents = df.where(F.col(type_col) == parent_type).drop(parent_ref)
    children = df.where(F.col(type_col) == child_type).select(
        F.col(parent_ref).alias(key), F.col(key).alias(f"child_{key}"), *[F.col(c).alias(f"child_{c}") for c in child_columns])
    return parents.join(children, key, "left")


def coverage_chain(people: DataFrame, person_account: DataFrame, account: DataFrame, account_coverage: DataFrame,
                   coverage: DataFrame, account_type: str | None = "Personal/Family") -> DataFrame:
    """person -> account -> coverage: two inner joins, then two left joins; null relationships are dropped."""
    chain = people.join(person_account.where("relationship is not null"), ["pat_id", "instance"])
    kept = account.where("type is not null and financial_class is not null")
    if account_type is not None:
        kept = kept.where(F.col("type") == account_type)
    return (
        chain.join(kept, ["account_id", "instance"])
        .join(account_coverage, ["account_id", "instance"], "left")
        .join(coverage, ["coverage_id", "instance"], "left")
    )


def geo_key(block_group: Column, zip_code: Column, state: Column, level: str) -> Column:
    """Join key of a geography table, cut from a census block group or a ZIP.

    Two-digit state codes that start with 0 are stored without it in some tables, which is what the
    state-dependent variants undo.
    """
    n = F.length(block_group)
    if level == "tract":
        return F.when(state.isin("CA", "AK"), block_group.substr(F.lit(2), n - 2)).otherwise(
            block_group.substr(F.lit(1), n - 1))
    if level == "tract_full":
        return block_group.substr(F.lit(1), n - 1)
    if level == "county_short":
        return F.when(state == "CA", block_group.substr(2, 4)).otherwise(block_group.substr(1, 5))
    if level == "county":
        return block_group.substr(1, 5)
    if level == "zip":
        return zip_code.substr(1, 5)
    raise ValueError(f"unknown geography level {level!r}")


def add_geography(cohort: DataFrame, addresses: DataFrame, geo: DataFrame, geo_column: str, level: str,
                  keys: Sequence[str] = ("pat_id", "instance"), missing: str = "-999.0") -> DataFrame:
    """Left-joins geography features by the person's address; the missing-value sentinel becomes null."""
    key = geo_key(F.col("block_group"), F.col("zip"), F.col("state"), level)
    keyed = geo.withColumn("_geo", F.col(geo_column).cast("string"))
    keyed = keyed.drop(geo_column)
    found = addresses.select(*keys, key.alias("_geo")).join(broadcast_if_small(keyed), "_geo").drop("_geo")
    text = [f.name for f in found.schema if f.dataType.simpleString() == "string" and f.name not in keys]
    found = found.withColumns({c: F.nullif(F.col(c), F.lit(missing)) for c in text}) if text else found
    return cohort.join(found, list(keys), "left")
