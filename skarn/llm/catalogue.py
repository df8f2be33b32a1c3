"""All queries of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skarn.llm import boilerplate_queries, lookalike_queries, mixing_queries, neardup_queries, packing_queries, splitting_queries

_MODULES = [neardup_queries, splitting_queries, boilerplate_queries, packing_queries, mixing_queries, lookalike_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
