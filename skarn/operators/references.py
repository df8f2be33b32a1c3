"""References to records that do not exist: missing, deleted or late targets.

References and target keys are hash-partitioned on the key, sorted, and merged
in one pass over both streams (Spark's sort-merge join). Each target key enters
the merge once, as the interval in which it is valid. Keys that hold a large
part of all references are spread over salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skarn.plans.skew import ROWS_PER_SALT, hot_keys, replicated, salted

MISSING, DELETED, LATE = "missing", "deleted", "late"


def references_of(rows: DataFrame, table: str, fields: dict[str, tuple[str, str]], key: str, time: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """The references of a table's columns: (table_name, field_name, target, record_key, ref_key, ref_time).

    ``fields`` gives, by name, the target and the column; a column holds a string or an array of strings. Null and
    empty values are no references. Copied rows of one record count once (they are combined before the shuffle, for all
    columns together), and the record's time is the earliest of its copies (null only if all are null). Rows without
    a key are taken as one record with a null key. Further columns are ignored. Rows of records with very many rows, and
    those without a key, get their time from a small broadcast list instead of meeting in one task.
    """
    values = {f"_{name}": (name, target, column) for name, (target, column) in fields.items()}
    picked = rows.select(F.col(key).cast("string").alias("record_key"), F.col(time).alias("ref_time"), *(F.col(c).alias(v) for v, (_, _, c) in values.items()))
    once = picked.groupBy("record_key", *values).agg(F.min("ref_time").alias("ref_time"))
    hot = hot_keys(picked.where(F.col("record_key").isNotNull()).select("record_key"), ["record_key"], rows_per_salt).select("record_key")
    crowded = hot.unionByName(rows.sparkSession.createDataFrame([(None,)], "record_key string")).select(F.col("record_key").alias("_key"), F.lit(True).alias("_crowded"))
    marked = once.join(F.broadcast(crowded), F.col("record_key").eqNullSafe(F.col("_key")), "left").drop("_key")
    usual = marked.where(F.col("_crowded").isNull()).drop("_crowded").withColumn("ref_time", F.min("ref_time").over(Window.partitionBy("record_key")))
    many = marked.where(F.col("_crowded")).drop("_crowded")
    firsts = many.groupBy(F.col("record_key").alias("_key")).agg(F.min("ref_time").alias("_first"))
    listed = many.join(F.broadcast(firsts), F.col("record_key").eqNullSafe(F.col("_key"))).withColumn("ref_time", F.col("_first")).drop("_key", "_first")
    dated = usual.unionByName(listed)
    return _listed(dated, fields, "_").select(F.lit(table).alias("table_name"), "field_name", "target", "record_key", "ref_key", "ref_time")


def reference_keys(rows: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(target, ref_key) of each reference, copied rows too: enough to find the keys that many rows hold, without the shuffle that ``references_of`` needs."""
    named = rows.select(*(F.col(c).alias(f"_{name}") for name, (_, c) in fields.items()))
    return _listed(named, fields, "_").select("target", "ref_key")


def _listed(rows: DataFrame, fields: dict[str, tuple[str, str]], prefix: str) -> DataFrame:
    """One row per reference, with field_name, target and ref_key."""

    def each(name: str, target: str) -> Column:
        value = prefix + name
        many = isinstance(rows.schema[value].dataType, T.ArrayType)
        keys = F.coalesce(F.array_distinct(value), F.array().cast("array<string>")) if many else F.array(value)
        return F.transform(keys, lambda k: F.struct(F.lit(name).alias("field_name"), F.lit(target).alias("target"), k.alias("ref_key")))

    rest = [c for c in rows.columns if c not in {prefix + name for name in fields}]
    found = rows.select(*rest, F.inline(F.concat(*(each(name, target) for name, (target, _) in fields.items()))))
    return found.where(F.col("ref_key").isNotNull() & (F.col("ref_key") != ""))


def references(rows: DataFrame, table: str, field: str, target: str, key: str, value: str, time: str) -> DataFrame:
    """The references of one column; see ``references_of``."""
    return references_of(rows, table, {field: (target, value)}, key, time)


def target_intervals(rows: DataFrame, target: str, key: str, time: str, deleted: DataFrame | None = None, deleted_key: str = "", deleted_time: Column | None = None) -> DataFrame:
    """One row per key: (target, ref_key, valid_from, valid_to, present).

    ``valid_from`` is the earliest time of the key's rows, and a key among them is valid from then on (present, no
    ``valid_to``), whatever else is queued. ``deleted`` holds keys queued for deletion: one that is only found there was
    removed (present = false) and valid up to the latest of its times there, as far as that is known.
    """
    live = rows.select(F.col(key).alias("ref_key"), F.col(time).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(True).alias("present"))
    if deleted is not None:
        at = deleted_time if deleted_time is not None else F.lit(None).cast("timestamp")
        live = live.unionByName(deleted.select(F.col(deleted_key).alias("ref_key"), F.lit(None).cast("timestamp").alias("valid_from"), at.alias("valid_to"), F.lit(False).alias("present")))
    return live.where(F.col("ref_key").isNotNull()).groupBy("ref_key").agg(F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to"), F.max("present").alias("present")).select(F.lit(target).alias("target"), "ref_key", "valid_from", F.when(~F.col("present"), F.col("valid_to")).alias("valid_to"), "present")


def dangling_references(refs: DataFrame, targets: DataFrame, grace_hours: float = 24.0, rows_per_salt: int = ROWS_PER_SALT, counted: DataFrame | None = None) -> DataFrame:
    """References whose target is missing, deleted, or came more than ``grace_hours`` after the reference.

    Returns (table_name, field_name, record_key, ref_key, period, state, was_valid), no row twice. ``period`` is the month
    of the reference's time in UTC, null where that time is null. ``was_valid`` says of a deleted target whether the
    reference was made within its interval; null where a time is unknown. A null time on either side can't be late. Empty
    inputs give no rows; with no targets every reference is missing. ``counted`` may give the rows (target, ref_key)
    by which frequent keys are found, if they are cheaper to have than ``refs``.
    """
    keys = ["target", "ref_key"]
    hot = hot_keys((refs if counted is None else counted).select(*keys), keys, rows_per_salt)
    left = salted(refs, hot, keys, F.col("record_key"))
    right = replicated(targets, hot, keys).hint("merge")
    late = F.col("valid_from").isNotNull() & F.col("ref_time").isNotNull() & (F.col("valid_from") > F.col("ref_time") + F.expr(f"INTERVAL {int(grace_hours * 3600)} SECONDS"))
    state = F.when(F.col("present").isNull(), MISSING).when(~F.col("present"), DELETED).when(late, LATE)
    return (
        left.join(right, [*keys, "salt"], "left")
        .withColumn("state", state)
        .withColumn("was_valid", F.when(F.col("state") == DELETED, F.col("ref_time") <= F.col("valid_to")))
        .where(F.col("state").isNotNull())
        .select("table_name", "field_name", "record_key", "ref_key", F.date_format("ref_time", "yyyy-MM").alias("period"), "state", "was_valid")
        .distinct()
    )


def deleted_counts(cases: DataFrame) -> DataFrame:
    """References to deleted targets per table, field and month, by whether they were made while the target was valid."""
    return cases.where(F.col("state") == DELETED).groupBy("table_name", "field_name", "period", "was_valid").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("ref_key").alias("n_keys"))


def dangling_counts(cases: DataFrame) -> DataFrame:
    """Cases per table, field, month and state."""
    return cases.groupBy("table_name", "field_name", "period", "state").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("ref_key").alias("n_keys"))
