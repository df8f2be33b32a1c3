"""Problem 5: packing the documents into containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.packing import packed
from skarn.plans.tables import table


def _limits(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    """The limits are settings: a few rows."""
    return [(r[0], r[1]) for r in table(spark, sf_dir, "pack_limits").select("pack_name", "capacity_tokens").collect()]


def p5_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document or piece, for each limit."""
    return packed(table(spark, sf_dir, "documents", "doc_id", "source", "text"), _limits(spark, sf_dir))


def p5_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, items and unused room for each limit."""
    sizes = spark.createDataFrame(_limits(spark, sf_dir), "pack_name string, capacity long")
    boxes = p5_containers(spark, sf_dir).where(F.col("container_id").isNotNull()).groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("items"))
    totals = boxes.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("items").alias("n_items"), F.sum("n").alias("n_tokens"))
    return totals.join(sizes, "pack_name").select("pack_name", "n_containers", "n_items", "n_tokens", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 4).alias("unused"))


QUERIES = {"p5_containers": p5_containers, "p5_fill": p5_fill}
SQL: dict[str, str] = {}
