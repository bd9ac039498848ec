"""Registered queries, one module per family."""

from cohortspark.plans import aggregates, analysis, clinical, relational, scalars, scans  # noqa: F401
from cohortspark.plans.registry import ORACLES, PLANS, callables  # noqa: F401
