"""Problem 2: sections and paths that are nearly the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.neardup import class_members, expanded_pairs, groups, items_of, near_duplicates, sketch
from skarn.plans.tables import spread, table


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = spread(table(spark, sf_dir, "parents", "parent_id", "text"), "parent_id").withColumnRenamed("parent_id", "id")
    paths = table(spark, sf_dir, "files").select(F.col("rel_path").alias("id"))
    return texts, paths


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(*_tables(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sections and of paths that are nearly the same."""
    return expanded_pairs(*_near(spark, sf_dir))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of sections and of paths that are nearly the same: one row per member."""
    return groups(*_near(spark, sf_dir))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each section and path: the least id with the same shingles or string."""
    return class_members(sketch(items_of(*_tables(spark, sf_dir)))).select("kind", "id", F.col("rep").alias("class"))


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups, "p2_classes": p2_classes}
SQL = {
    "p2_found": """
WITH p AS (SELECT parent_id AS id, min(text) AS text FROM parents WHERE parent_id IS NOT NULL AND text IS NOT NULL GROUP BY parent_id),
w AS (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM p),
s AS (SELECT DISTINCT id, sh FROM (SELECT id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS sh FROM w WHERE len(w) > 2)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS key_a, b.id AS key_b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.id < b.id GROUP BY a.id, b.id),
f AS (SELECT DISTINCT rel_path AS id FROM files WHERE rel_path IS NOT NULL)
SELECT 'text' AS kind, key_a, key_b FROM c JOIN n na ON key_a = na.id JOIN n nb ON key_b = nb.id WHERE k * 10 >= 7 * (na.n + nb.n - k)
UNION ALL
SELECT 'path', a.id, b.id FROM f a JOIN f b ON a.id < b.id AND abs(length(a.id) - length(b.id)) * 100 <= 8 * greatest(length(a.id), length(b.id))
WHERE levenshtein(a.id, b.id) * 100 <= 8 * greatest(length(a.id), length(b.id))"""
}
