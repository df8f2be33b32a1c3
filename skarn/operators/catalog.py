"""The manifest of indexed files: classification, incremental change, outbox, drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Source class of each top-level folder; files at the root are personal.
SOURCE_BY_FOLDER = {
    "ServiceNowOfficialDocs": "official", "Notion": "personal", "wiki": "wiki", "raw": "personal", "Applications": "custom-app", "ClaudeAgents": "custom-app",
    "ClaudeSkills": "custom-app", "graphify": "code-graph", "Dashboards": "personal", "Clippings": "personal",
}
ROOT_SOURCE = "personal"
EXCLUDED_FOLDERS = (".git", ".obsidian", ".smart-env", ".claude")
SKIPPED_NAME = "index.md"


def source_of(rel_path: Column) -> Column:
    """Source class of a path; null for an unknown folder (``unknown_folders`` reports those)."""
    top = F.substring_index(rel_path, "/", 1)
    known = F.element_at(F.create_map(*(F.lit(x) for pair in SOURCE_BY_FOLDER.items() for x in pair)), top)
    return F.when(~F.contains(rel_path, F.lit("/")), ROOT_SOURCE).otherwise(known)


def unknown_folders(files: DataFrame) -> DataFrame:
    """Top folders without a class, with their number of files; a build should stop if there are any."""
    return files.where(source_of(F.col("rel_path")).isNull() & F.col("rel_path").isNotNull()).groupBy(F.substring_index("rel_path", "/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("n_files"))


def skip_status(rel_path: Column) -> Column:
    return F.when(F.substring_index(rel_path, "/", -1) == SKIPPED_NAME, "skipped").otherwise("pending")


def in_corpus(rel_path: Column) -> Column:
    """Whether a path is walked: Markdown, and no folder on it excluded. The file's own name is not tested."""
    folders = F.split(rel_path, "/")
    return rel_path.endswith(".md") & ~F.arrays_overlap(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), F.array(*(F.lit(x) for x in EXCLUDED_FOLDERS)))


def latest(files: DataFrame, key: str = "rel_path", time: str = "recorded_at") -> DataFrame:
    """One row per key: the latest, ties to the greater hash. Combined before the shuffle."""
    others = [c for c in files.columns if c not in (key, time)]
    best = F.max(F.struct(time, *sorted(others, key=lambda c: c != "sha256"))).alias("_v")
    return files.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "_v.*").select(*files.columns)


def manifest_diff(walk: DataFrame, manifest: DataFrame) -> DataFrame:
    """(rel_path, change, status): full outer join of the walked files (rel_path, sha256) with the manifest (rel_path, sha256, status).

    change is new, changed, unchanged, flipped (same hash, but it is skipped now or no longer) or deleted. A null hash on
    both sides is unchanged.
    """
    w = walk.select("rel_path", F.col("sha256").alias("new_hash"), skip_status(F.col("rel_path")).alias("new_status"), F.lit(True).alias("walked"))
    m = manifest.select("rel_path", F.col("sha256").alias("old_hash"), F.col("status").alias("old_status"), F.lit(True).alias("known"))
    same = F.col("new_hash").eqNullSafe(F.col("old_hash"))
    flip = (F.col("new_status") == "skipped") != (F.col("old_status") == "skipped")
    change = F.when(F.col("known").isNull(), "new").when(F.col("walked").isNull(), "deleted").when(~same, "changed").when(flip, "flipped").otherwise("unchanged")
    j = w.join(m, "rel_path", "full_outer").withColumn("change", change)
    status = F.when(F.col("change") == "deleted", F.lit(None).cast("string")).when(F.col("change") == "unchanged", F.col("old_status")).otherwise(F.col("new_status"))
    return j.select("rel_path", "change", status.alias("status"))


def deletions(diff: DataFrame, chunks: DataFrame) -> DataFrame:
    """Deleted paths that still have chunks: what goes to the outbox."""
    return diff.where(F.col("change") == "deleted").select("rel_path").join(chunks.select("rel_path").distinct(), "rel_path", "left_semi")


def next_manifest(diff: DataFrame, walk: DataFrame, manifest: DataFrame) -> DataFrame:
    """The manifest after a pass: new, changed and flipped files with their status, unchanged rows as they were, deleted ones gone."""
    kept = manifest.join(diff.where(F.col("change") == "unchanged").select("rel_path"), "rel_path", "left_semi").select("rel_path", "sha256", "status")
    fresh = walk.select("rel_path", "sha256").join(diff.where(F.col("change").isin("new", "changed", "flipped")).select("rel_path", "status"), "rel_path")
    return kept.unionByName(fresh)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key isn't among the new ones, and the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_files(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """Replace all rows of the given files (rel_path) by the new rows: a file without new rows loses its old ones."""
    return old.join(files.select("rel_path").distinct(), "rel_path", "left_anti").unionByName(new)


def drain(rows: DataFrame, outbox: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows without those of queued paths that are no longer in the manifest."""
    gone = outbox.select("rel_path").distinct().join(manifest.select("rel_path"), "rel_path", "left_anti")
    return rows.join(gone, "rel_path", "left_anti")


def drift(manifest: DataFrame, chunks: DataFrame, points: DataFrame) -> DataFrame:
    """One row: (chunk_sum, n_chunks, n_points, drift, consistent). Each side is one aggregate; they meet as three rows of one column set."""
    parts = [
        manifest.agg(F.coalesce(F.sum(F.when(F.lower(F.trim("status")) == "indexed", F.col("chunk_count"))), F.lit(0)).cast("long").alias("v")).select(F.lit("chunk_sum").alias("k"), "v"),
        chunks.agg(F.countDistinct("chunk_id").alias("v")).select(F.lit("n_chunks").alias("k"), "v"),
        points.agg(F.countDistinct("chunk_id").alias("v")).select(F.lit("n_points").alias("k"), "v"),
    ]
    rows = reduce(DataFrame.unionByName, parts)
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("v"))).alias(k)
    one = rows.agg(pick("chunk_sum"), pick("n_chunks"), pick("n_points"))
    return one.select("*", (F.col("n_points") - F.col("chunk_sum")).alias("drift"), ((F.col("n_points") == F.col("chunk_sum")) & (F.col("n_chunks") == F.col("chunk_sum"))).alias("consistent"))


def pending_order(manifest: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending files in path order, optionally the first ones only."""
    rows = manifest.where(F.lower(F.trim("status")) == "pending").select("rel_path", "source").orderBy("rel_path")
    return rows.limit(limit) if limit is not None else rows


def hash_order(manifest: DataFrame) -> DataFrame:
    """A repeatable shuffle: position of each file by the first 8 hex digits of its hash, then path."""
    return manifest.select("rel_path", "sha256").orderBy(F.substring("sha256", 1, 8), "rel_path")
