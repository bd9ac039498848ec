"""Register of queries: key -> (Spark plan over the record views, SQL used to check it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortspark.sources.views import Views

PLANS: dict[str, Callable[[Views], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Registers a plan under ``key``; ``oracle`` is SQL with the same columns over the same tables."""
    def register(fn: Callable[[Views], DataFrame]):
        if key in PLANS:
            raise ValueError(f"duplicate key {key}")
        PLANS[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return register


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, folder, f=f: f(Views(spark, folder))) for k, f in PLANS.items()}
