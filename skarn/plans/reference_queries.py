"""Problem 1: references that do not resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.operators.references import dangling_counts, dangling_references, deleted_counts, reference_keys, references_of, target_intervals
from skarn.plans.tables import table


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, golden = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "golden")
    of_chunks, of_golden = {"rel_path": ("files", "rel_path"), "parent_id": ("parents", "parent_id")}, {"expected_rel_paths": ("files", "expected_rel_paths")}
    refs = references_of(chunks, "chunks", of_chunks, "chunk_id", "recorded_at").unionByName(references_of(golden, "golden", of_golden, "id", "added_at"))
    keys = reference_keys(chunks, of_chunks).unionByName(reference_keys(golden, of_golden))
    targets = target_intervals(table(spark, sf_dir, "files"), "files", "rel_path", "recorded_at", table(spark, sf_dir, "pending_deletes"), "rel_path", F.try_to_timestamp("detected_at")).unionByName(
        target_intervals(table(spark, sf_dir, "parents"), "parents", "parent_id", "recorded_at")
    )
    return dangling_references(refs, targets, counted=keys)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dangling reference."""
    return _cases(spark, sf_dir).drop("state", "was_valid")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling references per table, field, month and state."""
    return dangling_counts(_cases(spark, sf_dir))


def p1_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to deleted targets, made while they were valid or after."""
    return deleted_counts(_cases(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p1_deleted": p1_deleted}

_CASES_SQL = """
WITH r AS (
  SELECT 'chunks' AS table_name, 'rel_path' AS field_name, 'files' AS target, chunk_id AS record_key, rel_path AS ref_key,
         min(recorded_at) OVER (PARTITION BY chunk_id) AS ref_time FROM chunks
  UNION ALL
  SELECT 'chunks', 'parent_id', 'parents', chunk_id, parent_id, min(recorded_at) OVER (PARTITION BY chunk_id) FROM chunks
  UNION ALL
  SELECT 'golden', 'expected_rel_paths', 'files', id, unnest(expected_rel_paths), first_at
  FROM (SELECT *, min(added_at) OVER (PARTITION BY id) AS first_at FROM golden) g
), t AS (
  SELECT 'files' AS target, rel_path AS ref_key, min(recorded_at) AS valid_from FROM files GROUP BY rel_path
  UNION ALL
  SELECT 'parents', parent_id, min(recorded_at) FROM parents GROUP BY parent_id
), d AS (SELECT rel_path, max(detected_at::TIMESTAMPTZ) AS valid_to FROM pending_deletes GROUP BY rel_path),
cases AS (
  SELECT DISTINCT r.table_name, r.field_name, r.record_key, r.ref_key, strftime(r.ref_time AT TIME ZONE 'UTC', '%Y-%m') AS period,
         CASE WHEN t.ref_key IS NULL AND d.rel_path IS NOT NULL THEN 'deleted' WHEN t.ref_key IS NULL THEN 'missing' ELSE 'late' END AS state,
         CASE WHEN t.ref_key IS NULL AND d.rel_path IS NOT NULL THEN r.ref_time <= d.valid_to END AS was_valid
  FROM r LEFT JOIN t ON r.target = t.target AND r.ref_key = t.ref_key
         LEFT JOIN d ON r.target = 'files' AND r.ref_key = d.rel_path
  WHERE r.ref_key IS NOT NULL AND r.ref_key <> '' AND (t.ref_key IS NULL OR t.valid_from > r.ref_time + INTERVAL 24 HOUR)
)
"""

SQL = {
    "p1_found": _CASES_SQL + "SELECT table_name, field_name, record_key, ref_key, period FROM cases",
    "p1_counts": _CASES_SQL + "SELECT table_name, field_name, period, state, count(*) AS n_refs, count(DISTINCT ref_key) AS n_keys FROM cases GROUP BY ALL",
    "p1_deleted": _CASES_SQL + "SELECT table_name, field_name, period, was_valid, count(*) AS n_refs, count(DISTINCT ref_key) AS n_keys FROM cases WHERE state = 'deleted' GROUP BY ALL",
}
