"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import comparables, contracts, texts, valuation

FLAGSHIP = "robust_valuation_by_area"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for module in (valuation, comparables, texts, contracts):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
