"""All queries of this subpackage."""

from cohortspark.llm import chat, decontaminate, importance, infill, mixing, neighbours, privacy, secrets, simhash, tokens, toxicity, urls, warc  # noqa: F401
from cohortspark.llm.registry import ORACLES, QUERIES  # noqa: F401
