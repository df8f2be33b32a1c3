"""The pass that indexes pending files: chunk, encode, replace, mark, and record what failed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.operators import catalog, chunking, vector
from skarn.plans.stage import write_stage

ERRORS = "rel_path string, phase string, message string, ts string"
PHASE = "embed"


@dataclass(frozen=True)
class Passed:
    """Tables after a pass, and its counters."""

    points: DataFrame
    manifest: DataFrame
    errors: DataFrame
    n_files: int
    n_failed: int
    n_chunks: int


def is_status(name: str) -> Column:
    return F.lower(F.trim("status")) == name


def mark_indexed(manifest: DataFrame, counts: DataFrame, at: str) -> DataFrame:
    """The manifest with the files of counts (rel_path, n_chunks) indexed: their status, number of chunks and time. A file counted as 0 is indexed too; other rows stay."""
    done = counts.groupBy("rel_path").agg(F.max("n_chunks").alias("_n"))
    rows = manifest.join(done, "rel_path", "left")
    new = {"status": F.lit("indexed"), "chunk_count": F.col("_n").cast("int"), "indexed_at": F.lit(at)}
    return rows.select(*(F.when(F.col("_n").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in manifest.columns))


def append_errors(errors: DataFrame, failed: DataFrame, phase: str, at: str) -> DataFrame:
    """The error log with a row for each failed file (rel_path, message)."""
    return errors.select("rel_path", "phase", "message", "ts").unionByName(failed.select("rel_path", F.lit(phase).alias("phase"), "message", F.lit(at).alias("ts")))


def index_pass(manifest: DataFrame, corpus: DataFrame, points: DataFrame | None, errors: DataFrame, at: str, encode: Callable[[DataFrame, str, str], DataFrame] = vector.hashed_embedding, everything: bool = False) -> Passed:
    """Index the pending files of a manifest (rel_path, status, chunk_count, indexed_at, ...) from a corpus (rel_path, text).

    Each file's chunks replace its old ones in ``points`` (chunk_id, parent_id, rel_path, text, vector). A file that
    can't be read (no row, or no text) or chunked is recorded and stays pending; the others go on. A file without chunks
    is indexed with 0. ``everything`` starts anew: all files but skipped ones are pending and old points are dropped.
    """
    if everything:
        manifest = manifest.withColumn("status", F.when(is_status("skipped"), F.col("status")).otherwise("pending"))
        points = None
    texts = corpus.groupBy("rel_path").agg(F.max("text").alias("text"))
    todo = manifest.where(is_status("pending")).select("rel_path").distinct().join(texts, "rel_path", "left")
    cut = write_stage(chunking.sections_or_errors(todo.where(F.col("text").isNotNull())), "sections")
    unread = todo.where(F.col("text").isNull()).select("rel_path", F.lit("the file can't be read").alias("message"))
    failed = write_stage(unread.unionByName(cut.where(F.col("error").isNotNull()).select("rel_path", F.col("error").alias("message"))), "failed")
    good = todo.select("rel_path").join(failed.select("rel_path"), "rel_path", "left_anti")
    chunks = chunking.children(cut.where(F.col("error").isNull())).select("chunk_id", "parent_id", "rel_path", "text")
    fresh = write_stage(chunks.join(encode(chunks, "chunk_id", "text"), "chunk_id"), "points")
    counts = write_stage(good.join(fresh.groupBy("rel_path").agg(F.count(F.lit(1)).alias("n")), "rel_path", "left").select("rel_path", F.coalesce("n", F.lit(0)).alias("n_chunks")), "counts")
    n_files, n_chunks = counts.agg(F.count(F.lit(1)), F.sum("n_chunks")).first()
    kept = fresh if points is None else catalog.replace_files(points, fresh, good)
    return Passed(kept, mark_indexed(manifest, counts, at), append_errors(errors, failed, PHASE, at), n_files, failed.count(), n_chunks or 0)
