"""Problem 3: sections over the limit and wrongly cut pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.splitting import audit_pieces, one_row_per_key, oversized_sections, split_sections, with_pieces
from skarn.plans.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that the splitter cuts, and stored pieces that it finds wrong."""
    parents = table(spark, sf_dir, "parents")
    sections = oversized_sections(parents).select(F.lit("parents").alias("holder"), F.col("parent_id").alias("record_id"))
    wrong = audit_pieces(table(spark, sf_dir, "child_chunks"), parents).select(F.lit("child_chunks").alias("holder"), F.col("chunk_id").alias("record_id"))
    return sections.unionByName(wrong)


def p3_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each wrongly cut piece."""
    return audit_pieces(table(spark, sf_dir, "child_chunks"), table(spark, sf_dir, "parents"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New pieces of every section over the limit and of every section with a wrongly cut piece."""
    parents = table(spark, sf_dir, "parents")
    wrong = audit_pieces(table(spark, sf_dir, "child_chunks"), parents).select("parent_id").distinct()
    recut = one_row_per_key(parents.select("parent_id", "rel_path", "parent_idx", "text").join(wrong, "parent_id", "left_semi"), "parent_id", "rel_path", "parent_idx", "text")
    return split_sections(oversized_sections(parents).join(wrong, "parent_id", "left_anti").unionByName(with_pieces(recut)))


QUERIES = {"p3_found": p3_found, "p3_audit": p3_audit, "p3_pieces": p3_pieces}
SQL: dict[str, str] = {}
