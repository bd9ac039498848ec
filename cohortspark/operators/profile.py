"""Table profiles: value counts and per-column details in one pass over each table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.ranks import ranked


def value_counts(tables: dict[str, DataFrame], fields: dict[str, Sequence[str | tuple[str, str]]]) -> DataFrame:
    """(table, field, value, value_2, instance, n, row_id): counts of each field, or pair of fields, of each table.

    A table is scanned once: its fields are stacked into rows and counted together. Row ids number the
    counted values inside (table, field).
    """
    def one(name: str, df: DataFrame) -> DataFrame:
        cells = []
        for f in fields[name]:
            a, b = (f, None) if isinstance(f, str) else f
            second = F.col(b).cast("string") if b else F.lit(None).cast("string")
            cells.append(F.struct(F.lit(a if b is None else f"{a},{b}").alias("field"), F.col(a).cast("string").alias("value"),
                                  second.alias("value_2")))
        inst = F.col("instance") if "instance" in df.columns else F.lit(None).cast("int")
        stacked = df.select(inst.alias("instance"), F.inline(F.array(*cells)))
        return stacked.groupBy("field", "value", "value_2", "instance").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "table", F.lit(name))

    counted = reduce(DataFrame.unionByName, [one(n, d) for n, d in tables.items()])
    order = [F.col(c).asc_nulls_first() for c in ("value", "value_2", "instance")]
    return ranked(counted, ["table", "field"], order, "row_id").select(
        "table", "field", "value", "value_2", "instance", "n", "row_id")


def table_details(df: DataFrame, instance: str | None = "instance", approximate: bool = False) -> DataFrame:
    """(column, type, n_rows, n_distinct, n_distinct_with_instance, n_null), one row per column.

    Exact distinct counts come from two grouping steps over stacked (column, value, instance) cells, so a
    value repeated in a third of the rows is combined before it is shuffled.
    """
    cols = [c for c in df.columns if c != instance]
    inst = F.col(instance) if instance and instance in df.columns else F.lit(0)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])
    stacked = df.select(inst.alias("_i"), F.inline(cells))
    if approximate:
        found = stacked.groupBy("column").agg(
            F.count(F.lit(1)).alias("n_rows"), F.approx_count_distinct("v").alias("n_distinct"),
            F.approx_count_distinct(F.when(F.col("v").isNotNull(), F.struct("v", "_i"))).alias("n_distinct_with_instance"),
            F.sum(F.col("v").isNull().cast("bigint")).alias("n_null"))
    else:
        pairs = stacked.groupBy("column", "v", "_i").agg(F.count(F.lit(1)).alias("_n"))
        values = pairs.groupBy("column", "v").agg(F.count(F.lit(1)).alias("_pairs"), F.sum("_n").alias("_n"))
        real = F.col("v").isNotNull()
        found = values.groupBy("column").agg(
            F.sum("_n").alias("n_rows"), F.sum(real.cast("bigint")).alias("n_distinct"),
            F.sum(F.when(real, F.col("_pairs")).otherwise(0)).alias("n_distinct_with_instance"),
            F.sum(F.when(~real, F.col("_n")).otherwise(0)).alias("n_null"))
    types = dict(df.dtypes)
    type_of = F.create_map(*[F.lit(x) for c in cols for x in (c, types[c])])
    return found.withColumn("type", F.try_element_at(type_of, F.col("column"))).select(
        "column", "type", "n_rows", "n_distinct", "n_distinct_with_instance", "n_null")
