"""All queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skarn.plans import corpus_queries, evaluation_queries, maintenance_queries, pipeline_queries, reference_queries, retrieval_queries, streaming_queries

_MODULES = [reference_queries, retrieval_queries, corpus_queries, evaluation_queries, pipeline_queries, maintenance_queries, streaming_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_queries.hybrid_search(spark, sf_dir)
