"""Repeatable samples and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _draw(key: str, seed: int) -> Column:
    """A repeatable random order of keys that any engine can compute."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 20260804) -> DataFrame:
    """``n`` rows without replacement, the same for the same seed; fewer if there aren't as many. Null keys are left out."""
    return rows.where(F.col(key).isNotNull()).orderBy(_draw(key, seed), key).limit(n)


def needed_first(rows: DataFrame, key: str, needed: DataFrame, n: int, seed: int = 20260804) -> DataFrame:
    """All rows whose key is in ``needed`` (key), then seeded ones up to ``n`` in all. Adds ``is_needed``."""
    marked = rows.where(F.col(key).isNotNull()).join(needed.select(key).distinct().withColumn("_n", F.lit(True)), key, "left").withColumn("is_needed", F.coalesce("_n", F.lit(False))).drop("_n")
    return marked.orderBy(F.desc("is_needed"), _draw(key, seed), key).limit(n)


def per_group_sample(rows: DataFrame, group: str, key: str, n: int, seed: int = 20260804) -> DataFrame:
    """Up to ``n`` seeded rows of each group; ranks above n are dropped before the sort by Spark's window group limit."""
    order = Window.partitionBy(group).orderBy(_draw(key, seed), key)
    return rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def length_batches(rows: DataFrame, text: str) -> DataFrame:
    """Rows sorted by text length within each partition: what a model-backed encoder should get, so that batches hold texts of like length. No shuffle."""
    return rows.sortWithinPartitions(F.length(text))
