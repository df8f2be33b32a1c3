"""Problem 6: mixing the documents of the target sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.mixing import mixed
from skarn.plans.tables import spread, table

#: The mix wants as many tokens as all target sources have, more than the small ones can give.
OF_AVAILABLE = 1.0


def _mixed(spark: SparkSession, sf_dir: str, of_available: float | None) -> tuple[DataFrame, DataFrame]:
    return mixed(spread(table(spark, sf_dir, "documents", "doc_id", "source", "text"), "doc_id"), table(spark, sf_dir, "mix_targets"), of_available=of_available)


def _rounded(shares: DataFrame) -> DataFrame:
    return shares.withColumns({c: F.round(c, 6) for c in ("actual_share", "epochs")})


def p6_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each record is used for a total of all that the sources have: small sources are clamped at their most repeats."""
    return _mixed(spark, sf_dir, OF_AVAILABLE)[0]


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that these uses reach."""
    return _rounded(_mixed(spark, sf_dir, OF_AVAILABLE)[1])


def p6_exact_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each record is used for the largest total at which all targets are met, where no source is clamped."""
    return _mixed(spark, sf_dir, None)[0]


def p6_exact_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that these uses reach."""
    return _rounded(_mixed(spark, sf_dir, None)[1])


QUERIES = {"p6_uses": p6_uses, "p6_shares": p6_shares, "p6_exact_uses": p6_exact_uses, "p6_exact_shares": p6_exact_shares}
SQL: dict[str, str] = {}
