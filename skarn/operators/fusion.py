"""Rank fusion, deduplication and ranking policy. All inputs are rankings (query_id, doc_id, rank, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rank constant of reciprocal rank fusion, and how many times the limit each arm is fetched to.
RRF_K, PREFETCH = 60, 4


def rrf(arms: list[DataFrame], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, rank, score): reciprocal rank fusion. Ties go to the lower doc_id."""
    rows = reduce(DataFrame.unionByName, (a.select("query_id", "doc_id", "rank") for a in arms))
    fused = rows.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_per_parent(hits: DataFrame, parent: str) -> DataFrame:
    """The best hit of each (query_id, parent), ties to the earlier rank; ranks are counted anew. A hit without a parent stands for itself."""
    group = Window.partitionBy("query_id", F.coalesce(F.col(parent).cast("string"), F.concat(F.lit("~"), F.col("doc_id").cast("string")))).orderBy(F.desc("score"), "rank")
    # one shuffle serves both orders
    kept = hits.repartition("query_id").withColumn("_n", F.row_number().over(group)).where(F.col("_n") == 1).drop("_n")
    return reranked(kept, F.desc("score"), F.col("rank"))


def reranked(hits: DataFrame, *order: Column, top: int | None = None) -> DataFrame:
    """Hits with ranks counted anew in the given order, the first ``top`` only."""
    out = hits.withColumn("_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    if top is not None:
        out = out.where(F.col("_rank") <= top)
    return out.drop("rank").withColumnRenamed("_rank", "rank")


def boosted(hits: DataFrame, favoured: Column) -> DataFrame:
    """Favoured hits first, order otherwise kept (a stable partition). A null condition is not favoured."""
    return reranked(hits, F.desc(F.coalesce(favoured, F.lit(False))), F.col("rank"))


def promoted(hits: DataFrame, paths: DataFrame, path: str = "rel_path") -> DataFrame:
    """Hits whose (query_id, path) was found lexically first, order otherwise kept."""
    found = paths.select("query_id", path).distinct().withColumn("_found", F.lit(True))
    return boosted(hits.join(found, ["query_id", path], "left"), F.col("_found")).drop("_found")


def overlap_rerank(hits: DataFrame, queries: DataFrame, docs: DataFrame | None, top: int) -> DataFrame:
    """Rerank by the share of the query's terms found in the text: the deterministic stand-in for a cross-encoder. The score is replaced; ties keep the order. Only texts of candidates are read, and none if the hits have their number of terms in the column ``matched``."""
    from skarn.functions.text import terms

    if "matched" in hits.columns:
        sizes = queries.select("query_id", F.size(F.array_distinct(terms(F.col("text")))).alias("_size"))
        share = hits.join(sizes, "query_id").withColumn("score", F.col("matched") / F.greatest(F.col("_size"), F.lit(1)))
        return reranked(share.drop("matched", "_size"), F.desc("score"), F.col("rank"), top=top)
    q = queries.select("query_id", F.array_distinct(terms(F.col("text"))).alias("_q"))
    d = docs.select("doc_id", "text").join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.array_distinct(terms(F.col("text"))).alias("_d"))
    scored = hits.join(q, "query_id").join(d, "doc_id").withColumn("score", F.size(F.array_intersect("_q", "_d")) / F.greatest(F.size("_q"), F.lit(1)))
    return reranked(scored.drop("_q", "_d"), F.desc("score"), F.col("rank"), top=top)


def running_cap(rows: DataFrame, partition: str, order: str, cost: Column, most: int, max_items: int | None = None) -> DataFrame:
    """The longest prefix of each group whose summed cost stays within ``most``; the first row is always kept. Adds ``running``."""
    window = Window.partitionBy(partition).orderBy(order)
    out = rows.withColumn("_cost", cost).withColumn("_n", F.row_number().over(window)).withColumn("running", F.sum("_cost").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    kept = (F.col("_n") == 1) | (F.col("running") <= most)
    if max_items is not None:
        kept = kept & (F.col("_n") <= max_items)
    return out.where(kept).drop("_cost", "_n")


def first_seen(evidence: DataFrame, key: str) -> DataFrame:
    """Evidence of ordered sub-queries (question_id, query_idx, rank, ...) without later repeats of a key; rows with a blank key are never dropped."""
    blank = F.coalesce(F.trim(F.col(key)), F.lit("")) == ""
    group = F.when(blank, F.concat_ws("~", F.lit(""), "query_idx", "rank")).otherwise(F.col(key))
    window = Window.partitionBy("question_id", group).orderBy("query_idx", "rank")
    # one shuffle serves this order and the next one within a question
    return evidence.repartition("question_id").withColumn("_n", F.row_number().over(window)).where(F.col("_n") == 1).drop("_n")


def judged(pool: DataFrame, verdict: Column, budget: int, free: int = 3, most_calls: int = 12) -> DataFrame:
    """The evidence a sequential judge would keep, by windows: ``free`` first ranks pass unjudged, later ones need a yes,
    judging ends once ``budget`` are kept or after ``most_calls``. Adds ``n_judged`` per question. Ranks start at 1.
    """
    window = Window.partitionBy("question_id").orderBy("rank")
    yes = (F.col("rank") > free) & F.coalesce(verdict, F.lit(False))
    before = F.least(F.lit(free), F.col("rank") - 1) + F.coalesce(F.sum(yes.cast("int")).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    calls = pool.where(F.col("rank") <= free + most_calls).withColumn("_before", before).withColumn("_yes", yes)
    reached = F.col("_before") < budget
    counted = calls.withColumn("n_judged", F.sum(((F.col("rank") > free) & reached).cast("int")).over(Window.partitionBy("question_id")))
    return counted.where(reached & ((F.col("rank") <= free) | F.col("_yes"))).drop("_before", "_yes")
