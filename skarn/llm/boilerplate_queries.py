"""Problem 4: lines repeated across the documents of one source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.boilerplate import cleaned_sections, line_clusters, repeated_lines
from skarn.plans.tables import spread, table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a line that stands in ten or more paths of one source."""
    return repeated_lines(spread(table(spark, sf_dir, "parents"), "parent_id"), table(spark, sf_dir, "files"))


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section's text without the lines of frequent clusters."""
    return cleaned_sections(spread(table(spark, sf_dir, "parents"), "parent_id"), table(spark, sf_dir, "files"))


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent clusters of lines of each source."""
    clusters, _ = line_clusters(spread(table(spark, sf_dir, "parents"), "parent_id"), table(spark, sf_dir, "files"))
    return clusters.groupBy("source", "cluster").agg(F.count(F.lit(1)).alias("n_lines"), F.max("n_paths").alias("n_paths"))


QUERIES = {"p4_found": p4_found, "p4_clean": p4_clean, "p4_clusters": p4_clusters}
SQL: dict[str, str] = {}
