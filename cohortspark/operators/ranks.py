"""Running totals, ranks and exact quantiles over groups of any size.

A window partitioned by a group sorts the whole group in one task. Here the rows are range-partitioned
by (group, order) and stored once, so one hot group spans many partitions; each partition's totals form
a small table (one row per partition and group) whose running sum gives every partition its offset.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.session import durable


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the left frame's key columns are kept."""
    if not keys:
        raise ValueError("at least one key is needed")
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], totals: dict[str, Column],
                   partitions: int | None = None, grand: str | None = None) -> DataFrame:
    """Adds inclusive running sums of ``totals`` along ``order`` within ``keys``. ``order`` must be total.

    With ``grand`` also every total's sum over the group, in a column of that prefix plus the total's name. Without
    ``partitions`` adaptive execution joins small neighbouring ranges; the stored copy fixes what each range holds.
    """
    keys = list(keys) or ["_all"]
    base = df if keys[0] in df.columns else df.withColumn("_all", F.lit(0))
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    stored = durable(
        base.repartitionByRange(*([partitions] if partitions else []), *[F.col(k).asc() for k in keys], *order)
        .withColumn("_part", F.spark_partition_id())
    )
    sums = stored.groupBy("_part", *keys).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()])
    up_to = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    all_of = [F.sum(f"_t_{n}").over(whole).alias(f"{grand}{n}") for n in totals] if grand else []
    offsets = sums.select("_part", *keys, *all_of, *[
        F.coalesce(F.sum(f"_t_{n}").over(up_to), F.lit(0)).alias(f"_o_{n}") for n in totals])
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = stored.select("*", *[F.sum(c).over(within).alias(n) for n, c in totals.items()])
    joined = same_keys(local, offsets, ["_part", *keys])
    return joined.select(*df.columns, *[f"{grand}{n}" for n in totals if grand], *[(F.col(n) + F.col(f"_o_{n}")).alias(n) for n in totals])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str = "rank",
           partitions: int | None = None) -> DataFrame:
    """Adds row numbers from 1 along a total ``order`` within ``keys``."""
    return running_totals(df, keys, order, {out: F.lit(1).cast("bigint")}, partitions)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    count: str | None = None, partitions: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles per group; nulls are ignored. One row per group with a value.

    Equal values are counted together before anything is ordered.
    """
    grand = not keys
    keys = list(keys) or ["_all"]
    df = df.withColumn("_all", F.lit(0)) if grand else df
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(counts, keys, [F.col(value).asc()], {"_hi": F.col("_n")}, partitions, "_all_of")
    size, out = F.col("_all_of_hi"), []
    for name, p in probs.items():
        pos = (size - 1) * F.lit(float(p))
        low, high = F.floor(pos), F.ceil(pos)
        first = F.col("_hi") - F.col("_n")
        at = lambda r: F.max(F.when((first <= r) & (r < F.col("_hi")), F.col(value).cast("double")))
        lo, hi, frac = at(low), at(high), F.max(pos - low)
        out.append((lo + (hi - lo) * frac).alias(name))
    if count:
        out.append(F.max(size).alias(count))
    found = placed.groupBy(*keys).agg(*out)
    return found.drop("_all") if grand else found


def one_row(*frames: DataFrame) -> DataFrame:
    """Puts one-row results side by side (a union folded into one row, so no join without keys is needed)."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
