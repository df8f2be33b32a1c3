"""Salting of keys that hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one hot key that go to one salt.
ROWS_PER_SALT = 100_000
#: A hot key holds more than one in so many rows, so there are never more hot keys than this, and their list may be broadcast at any input size.
MOST_HOT_KEYS = 20_000


def hot_keys(rows: DataFrame, keys: list[str], rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Every key with more than ``rows_per_salt`` rows, and more than one in MOST_HOT_KEYS of all rows, with its number of salts.

    The count is combined before the shuffle. Keys that are not listed hold at most one in MOST_HOT_KEYS of all rows.
    """
    least = max(rows_per_salt, -(-rows.count() // MOST_HOT_KEYS))
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > least)
    return counted.select(*keys, F.ceil(F.col("n_rows") / least).cast("int").alias("n_salts"))


def salted(rows: DataFrame, hot: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """Rows with a column ``salt``: 0 for normal keys, spread over the key's salts for hot ones."""
    return (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("salt", F.when(F.col("n_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("n_salts")).cast("int")))
        .drop("n_salts")
    )


def replicated(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Rows once for each salt of their key."""
    return (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("n_salts"), F.lit(1)) - 1)))
        .drop("n_salts")
    )
