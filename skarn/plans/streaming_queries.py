"""The change feed as a stream: events counted per day and type by a stream that ends when all rows are read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skarn.plans.stage import stage_root
from skarn.streaming.index_stream import change_counts


def event_windows(spark, d):
    """Events per day and type, counted by a stream with a watermark into a table of changed windows."""
    path = f"{d}/events.parquet"
    name = f"{stage_root(spark)}/skarn/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    # a stream reads a folder; the pattern also fits a table of one file
    rows = change_counts(spark, f"{d}/events.parque[t]", schema, late="400 days")
    query = rows.writeStream.trigger(availableNow=True).outputMode("update").option("checkpointLocation", f"{name}/state").foreachBatch(lambda batch, n: batch.write.parquet(f"{name}/out/batch={n}")).start()
    query.awaitTermination()
    # a window is written again by each batch that changes it; the last one holds
    out = spark.read.parquet(f"{name}/out").groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("v")).select("window", "event_type", "v.n", "v.total")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {"event_windows": event_windows}
SQL = {"event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"}
