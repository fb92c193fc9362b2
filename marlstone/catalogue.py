"""Named queries of the engine and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import fields, joins, ordered, summaries, values  # noqa: F401  they register their queries
from .plans.registry import ORACLES, QUERIES

FLAGSHIP = "hist_suppressed"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
