"""All queries over the given tables that are not part of the optional subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glimt.plans import q_metrics, q_search, q_state

_MODULES = (q_search, q_metrics, q_state)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_search.red_operations(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.ORACLE.items()}
