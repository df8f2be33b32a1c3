"""Retrieval evaluation. Rankings are (query_id, doc_id, rank); expectations are (query_id, doc_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.plans.stage import write_stage


def first_ranks(queries: DataFrame, ranking: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, first_rank): rank of the first relevant hit of each query, null if none was found."""
    # joined by the query alone: rankings are partitioned by it already
    wanted = expected.groupBy("query_id").agg(F.collect_set("doc_id").alias("_wanted"))
    hits = ranking.join(wanted, "query_id").where(F.array_contains("_wanted", F.col("doc_id"))).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return queries.select("query_id").distinct().join(hits, "query_id", "left")


def recall_mrr(ranks: DataFrame, *by: str) -> DataFrame:
    """n, recall at 5 and 10, and mean reciprocal rank (0 where nothing was found), per group."""
    at = lambda k: F.avg(F.coalesce((F.col("first_rank") <= k).cast("double"), F.lit(0.0))).alias(f"recall_at_{k}")
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), at(5), at(10), F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("mrr"))


def ranked_values(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, r, n): each value's rank in its group from 1, and the group's size. Nulls are left out.

    Values are cut into ranges and ranked in each of them, and what stands in the ranges before is added, so that a
    group that holds most rows is not one task.
    """
    known = rows.where(F.col(value).isNotNull()).select(by, value)
    cut = write_stage(known.repartitionByRange(by, value).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each group and range
    offsets = sizes.select(F.col(by).alias("_by"), F.col("_range").alias("_at"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy(by)).alias("n"))
    local = cut.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_range").orderBy(value)))
    joined = local.join(offsets, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_at")))
    return joined.select(by, value, (F.col("_r") + F.col("_before")).alias("r"), "n")


def percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, p50, p95_eval, p95_planner, p90_rank): the median, and three rank-index percentiles.

    ``p95_eval`` is the value at rank int(0.95 n) if there are 20 values or more, else the greatest; ``p95_planner`` is
    always at rank max(1, int(0.95 n)); ``p90_rank`` at rank int(0.9 n) + 1. Nulls are left out.
    """
    ranked = ranked_values(rows, by, value)
    r95 = F.floor(F.col("n") * 95 / 100)
    pick = lambda r, name: F.max(F.when(F.col("r") == r, F.col(value))).alias(name)
    return ranked.groupBy(by).agg(
        F.max("n").alias("n"),
        ((pick(F.floor((F.col("n") + 1) / 2), "lo") + pick(F.floor(F.col("n") / 2) + 1, "hi")) / 2).alias("p50"),
        pick(F.when(F.col("n") >= 20, r95).otherwise(F.col("n")), "p95_eval"),
        pick(F.greatest(F.lit(1), r95), "p95_planner"),
        pick(F.least(F.floor(F.col("n") * 9 / 10) + 1, F.col("n")), "p90_rank"),
    )


def gate(ranks: DataFrame, least_cases: int = 20, least_recall: float = 0.85) -> DataFrame:
    """One row per profile: PASS, FAIL, or INCONCLUSIVE below ``least_cases`` cases."""
    m = recall_mrr(ranks, "profile")
    verdict = F.when(F.col("n") < least_cases, "INCONCLUSIVE").when(F.col("recall_at_10") >= least_recall, "PASS").otherwise("FAIL")
    return m.select("profile", "n", "recall_at_10", verdict.alias("verdict"))


def stage_loss(queries: DataFrame, retrieved: DataFrame, deduped: DataFrame, reranked: DataFrame, expected: DataFrame, cut: int) -> DataFrame:
    """(query_id, rank_retrieved, rank_deduped, rank_reranked, verdict): the first rank after each stage, null if it is not there, and where a case was lost: never retrieved, lost by rerank, rescued by rerank, ok, or below the cut in both."""
    names = {"rank_retrieved": retrieved, "rank_deduped": deduped, "rank_reranked": reranked}
    a, d, b = (first_ranks(queries, hits, expected).withColumnRenamed("first_rank", name) for name, hits in names.items())
    hit = lambda c: F.coalesce(F.col(c) <= cut, F.lit(False))
    verdict = F.when(F.col("rank_retrieved").isNull(), "never retrieved").when(hit("rank_retrieved") & ~hit("rank_reranked"), "lost by rerank").when(~hit("rank_retrieved") & hit("rank_reranked"), "rescued by rerank").when(hit("rank_reranked"), "ok").otherwise("below cut")
    return a.join(d, "query_id").join(b, "query_id").select("query_id", *names, verdict.alias("verdict"))


def disagreements(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, rank_a, rank_b) of the cases that two arms rank differently, null-safe."""
    j = a.select("query_id", F.col("first_rank").alias("rank_a")).join(b.select("query_id", F.col("first_rank").alias("rank_b")), "query_id")
    return j.where(~F.col("rank_a").eqNullSafe(F.col("rank_b")))


def unwinnable(expected: DataFrame, corpus: DataFrame, reachable: DataFrame | None = None) -> DataFrame:
    """Expectations (query_id, doc_id) whose document is not in the corpus, or is out of the profile's reach."""
    missing = expected.join(corpus.select("doc_id").distinct(), "doc_id", "left_anti").select("query_id", "doc_id", F.lit("missing").alias("reason"))
    if reachable is None:
        return missing
    there = expected.join(corpus.select("doc_id").distinct(), "doc_id", "left_semi")
    out = there.join(reachable.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", F.lit("out of reach").alias("reason"))
    return missing.unionByName(out)


def summary_with_total(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, n_failed, recall, routing, p50): per group and overall in one pass of grouping sets; the overall row is named ``all``."""
    rows.createOrReplaceTempView("_skarn_runs")
    return rows.sparkSession.sql(f"""
        SELECT CASE WHEN grouping({by}) = 1 THEN 'all' ELSE {by} END AS {by}, count(*) AS n, count_if(failed) AS n_failed,
               avg(CASE WHEN NOT failed THEN CAST(hit AS double) END) AS recall, avg(CASE WHEN NOT failed THEN CAST(routed AS double) END) AS routing,
               percentile(elapsed, 0.5) AS p50
        FROM _skarn_runs GROUP BY GROUPING SETS (({by}), ())""")
