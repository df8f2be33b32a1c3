"""SparkSession factory."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", app: str = "skarn", shuffle_partitions: int = 8, memory: str = "12g", **extra: str) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster the session of spark-submit is used as it is."""
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (conf | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> None:
    """Make a session fit for the queries, whoever started it.

    Python workers get this package's folder on their path. Unions that keep their inputs' partitioning are turned
    off: under adaptive execution such inputs can end up with unequal numbers of partitions, which fails.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, known) if p)
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
