"""Code registries and inline mappings as frames. The code lists themselves are input data."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEASURE_MAP_SCHEMA = T.StructType([
    T.StructField("flo_meas_id", T.StringType()), T.StructField("instance", T.IntegerType()),
    T.StructField("code", T.StringType()), T.StructField("code_system", T.StringType()),
    T.StructField("description", T.StringType()),
])


def mapping_from_text(spark: SparkSession, text: str, schema: T.StructType = MEASURE_MAP_SCHEMA) -> DataFrame:
    """Typed frame from tab-separated text with a header line. Short texts only; use mapping_from_file for the rest."""
    lines = [ln.split("\t") for ln in text.strip("\n").split("\n")]
    at = {name.strip(): i for i, name in enumerate(lines[0])}
    absent = [f.name for f in schema if f.name not in at]
    if absent:
        raise ValueError(f"columns not in the header: {absent}")
    rows = [tuple(r[at[f.name]].strip() or None for f in schema) for r in lines[1:]]
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    return spark.createDataFrame(rows, texts).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def mapping_from_file(spark: SparkSession, path: str, schema: T.StructType = MEASURE_MAP_SCHEMA) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def registry_frame(spark: SparkSession, registry: Mapping[str, Sequence[str]]) -> DataFrame:
    """label -> codes as rows (label, code)."""
    rows = [(label, str(code)) for label, codes in registry.items() for code in codes]
    return spark.createDataFrame(rows, "label string, code string")


def codes_of(registry: DataFrame, label: str) -> DataFrame:
    return registry.where(F.col("label") == label).select("code").distinct()


def check_version(version: str) -> str:
    """Vocabulary snapshots are named by date, 20yy-mm-dd."""
    if not re.fullmatch(r"20\d{2}-[01]\d-[0-3]\d", version):
        raise ValueError("version must look like 20yy-mm-dd")
    return version
