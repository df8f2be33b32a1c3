"""Tables written between the steps of a job.

A long plan is cut by writing a step's rows as Parquet into the folder that all
executors share (``spark.checkpoint.dir``). Lost executors then cost a re-read,
not a recomputation, and no row depends on one machine's disk.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[object, str]] = []


def stage_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one where the setting is unset and there is one machine only, as in tests. ValueError on a cluster without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="skarn-stages-")
        spark.conf.set("spark.checkpoint.dir", root)
        _WRITTEN.append((spark, root))
    return root.rstrip("/")


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and return it as read back from there."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/skarn/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stage = path
    return out


def discard(stage: DataFrame) -> None:
    """Delete a stage table that nothing reads any more."""
    _delete(stage.sparkSession, stage._stage)
    _WRITTEN[:] = [x for x in _WRITTEN if x[1] != stage._stage]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_stages() -> None:
    """Delete every stage table of this process; results that still read them must be written first."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already; the folder then belongs to the cluster's own cleaning
            pass


atexit.register(drop_stages)
