"""Incremental indexing as a stream: new files of documents are chunked and replace their old rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skarn.operators import chunking
from skarn.sources.readers import Snapshots

DOCUMENT_SCHEMA = "rel_path string, text string, recorded_at timestamp"


def index_batch(batch: DataFrame, store: Snapshots) -> None:
    """Chunk the latest version of each document of a batch and replace its rows in the store, kept by rel_path. Only the buckets of these documents are rewritten. Running a batch again gives the same table."""
    docs = batch.where(F.col("rel_path").isNotNull()).groupBy("rel_path").agg(F.max_by("text", "recorded_at").alias("text"))
    rows = chunking.children(chunking.sections(docs))
    store.replace(rows, docs.select("rel_path"))


def index_stream(spark: SparkSession, source: str, store: Snapshots, checkpoint: str, schema: str = DOCUMENT_SCHEMA) -> StreamingQuery:
    """Index whatever Parquet files came since the last run, then end."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "64").parquet(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: index_batch(batch, store)).start()


def change_counts(spark: SparkSession, source: str, schema: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """A streaming DataFrame of events per type and time window, late rows up to ``late`` counted."""
    events = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
