"""Column rules under names that SQL text can call, such as the filter strings of the record getters.

Each rule is a temporary SQL function, so its body is an expression that the optimizer sees through; nothing runs in Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from cohortspark.functions.strings import DROPPED_CHARACTERS, NEGATIVE_RESULTS, POSITIVE_RESULTS


def _listed(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_CLEAN = f"regexp_replace(lower(btrim(translate(coalesce(text, ''), '{DROPPED_CHARACTERS}', ''), concat(' ', chr(9), chr(10), chr(13), chr(11), chr(12)))), ' +', ' ')"

# Name -> parameters, result type, body. The bodies say what the functions of this package say to columns.
RULES: dict[str, tuple[str, str, str]] = {
    "zero_pad_front": ("value STRING, width INT", "STRING", "right(concat(repeat('0', width), value), width)"),
    "clean_text": ("text STRING", "STRING", _CLEAN),
    "is_positive_result": ("text STRING", "BOOLEAN", f"{_CLEAN} IN ({_listed(POSITIVE_RESULTS)})"),
    "is_negative_result": ("text STRING", "BOOLEAN", f"{_CLEAN} IN ({_listed(NEGATIVE_RESULTS)})"),
    "code_of": ("coded STRING", "STRING", "get(split(coded, '#'), 1)"),
    "vocabulary_of": ("coded STRING", "STRING", "get(split(coded, '#'), 0)"),
    "lab_code": ("code STRING, default_code STRING", "STRING", "regexp_replace(coalesce(code, default_code), '^X', '')"),
    "age_years": ("birth DATE, at DATE", "DOUBLE", "round(CAST(datediff(at, birth) AS DOUBLE) / 365.25D, 1)"),
    "gestation_days": ("delivery DATE, due DATE", "INT", "280 + datediff(delivery, due)"),
}


def register(spark: SparkSession) -> list[str]:
    """Defines all rules for the session, again if need be; returns their names."""
    for name, (parameters, result, body) in RULES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(RULES)
