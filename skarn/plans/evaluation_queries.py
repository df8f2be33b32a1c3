"""Evaluation, diagnosis and research queries: golden questions over the sections of the files they expect."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.functions import text as X
from skarn.operators import evaluate, fusion, lexical, research
from skarn.plans.retrieval_queries import _BM25_PARTS, _ONCE, _ranked_sql, sections_with_source
from skarn.plans.stage import write_stage
from skarn.plans.tables import table


def _cases(spark, d):
    """One row per golden case that expects an answer: (query_id, text, profile, provenance, expected[])."""
    once = table(spark, d, "golden").groupBy("id").agg(F.min(F.struct("question", "profile", "provenance", "expected_rel_paths", F.coalesce("expect_no_answer", F.lit(False)).alias("no_answer"))).alias("v"))
    return once.where(~F.col("v.no_answer")).select(F.col("id").alias("query_id"), F.col("v.question").alias("text"), F.coalesce("v.profile", F.lit("none")).alias("profile"), F.coalesce("v.provenance", F.lit("none")).alias("provenance"), F.col("v.expected_rel_paths").alias("expected"))


def _expected(spark, d):
    rows = _cases(spark, d).select("query_id", F.explode("expected").alias("doc_id"))
    return rows.where(F.col("doc_id").isNotNull() & (F.col("doc_id") != "")).distinct()


def _scored(spark, d):
    """Cases with at least one usable expectation."""
    return _cases(spark, d).join(_expected(spark, d).select("query_id").distinct(), "query_id", "left_semi")


def _indexed(spark, d):
    """The scored questions, the sections, and the index both arms share."""
    q, s = _scored(spark, d).select("query_id", "text"), sections_with_source(spark, d)
    return q, s, lexical.matched_index(q, s)


def _files_ranked(q, s, index, idf=True, k=30):
    """Best section of each file, files ranked."""
    hits = lexical.sparse_topk(q, s, 2 * k, idf=idf, index=index)
    return fusion.best_per_parent(hits.join(s.select("doc_id", "rel_path"), "doc_id").withColumn("score", F.round("score", 9)), "rel_path").select("query_id", F.col("rel_path").alias("doc_id"), "rank", "score")


def _filed(spark, d):
    """The index, (n, rel_path, file) of its sections, and the expectations by number. A file's number is the least of its sections; a section without a file stands for itself."""
    _, s, index = _indexed(spark, d)
    named = index.docs.select("n", "doc_id").join(s.select("doc_id", "rel_path"), "doc_id")
    own = Window.partitionBy("rel_path", F.when(F.col("rel_path").isNull(), F.col("doc_id")))
    placed = write_stage(named.select("n", "rel_path", F.min("n").over(own).alias("file")), "placed")
    files = placed.where(F.col("n") == F.col("file")).select(F.col("rel_path").alias("doc_id"), "file")
    expected = _expected(spark, d).join(index.queries, "query_id").join(files, "doc_id")
    return index, placed, write_stage(expected.select(F.col("q").alias("query_id"), F.col("file").alias("doc_id")), "expected")


def _hits(index, placed, k, idf=True, matched=False):
    """Hits of the sections (query_id, doc_id, file, rank, score), all by number."""
    hits = lexical.sparse_numbers(index, k, idf, matched=matched).join(placed.select("n", "file"), "n")
    return hits.withColumnsRenamed({"q": "query_id", "n": "doc_id"})


def _named(spark, d, index, rows):
    """Rows by number of a query, for all scored cases by id; null for those that have none."""
    return _scored(spark, d).select("query_id").join(rows.withColumnRenamed("query_id", "q").join(index.queries, "q").drop("q"), "query_id", "left")


def _ranks(spark, d, idf=True, filed=None):
    index, placed, expected = filed or _filed(spark, d)
    files = fusion.best_per_parent(_hits(index, placed, 60, idf), "file").select("query_id", F.col("file").alias("doc_id"), "rank")
    return _named(spark, d, index, evaluate.first_ranks(index.queries.select(F.col("q").alias("query_id")), files, expected))


def first_rank(spark, d):
    return _ranks(spark, d)


def recall_mrr(spark, d):
    ranks = _ranks(spark, d).join(_scored(spark, d).select("query_id", "profile"), "query_id")
    return evaluate.recall_mrr(ranks, "profile").withColumns({c: F.round(c, 6) for c in ("recall_at_5", "recall_at_10", "mrr")})


def gate(spark, d):
    rows = _scored(spark, d).where(F.col("provenance") == "real").select("query_id", "profile")
    return evaluate.gate(_ranks(spark, d).join(rows, "query_id")).withColumn("recall_at_10", F.round("recall_at_10", 6))


def unwinnable(spark, d):
    files = table(spark, d, "files", "rel_path").withColumnRenamed("rel_path", "doc_id")
    return evaluate.unwinnable(_expected(spark, d), files)


def out_of_reach(spark, d):
    """Expectations that are missing, or whose file the case's profile doesn't reach."""
    files = table(spark, d, "files").groupBy("rel_path").agg(F.min("source").alias("source")).select(F.col("rel_path").alias("doc_id"), "source")
    cases = _cases(spark, d).select("query_id", "profile")
    reach = _expected(spark, d).join(files, "doc_id").join(cases, "query_id")
    inside = F.when(F.col("profile") == "servicenow", F.coalesce(F.col("source") == "official", F.lit(False))).when(F.col("profile") == "personal", F.coalesce(F.col("source").isin("personal", "wiki", "custom-app", "code-graph"), F.lit(False))).otherwise(True)
    return evaluate.unwinnable(_expected(spark, d), files.select("doc_id"), reach.where(inside).select("query_id", "doc_id"))


def arm_disagreement(spark, d):
    filed = _filed(spark, d)
    return evaluate.disagreements(_ranks(spark, d, filed=filed), _ranks(spark, d, False, filed))


def stage_loss(spark, d):
    index, placed, expected = _filed(spark, d)
    q = _scored(spark, d).join(index.queries, "query_id").select(F.col("q").alias("query_id"), "text")
    hits = write_stage(_hits(index, placed, 30, matched=True), "hits")
    by_file = lambda h: h.select("query_id", F.col("file").alias("doc_id"), "rank")
    deduped = fusion.best_per_parent(hits, "file")
    loss = evaluate.stage_loss(q, by_file(hits), by_file(deduped), by_file(fusion.overlap_rerank(hits, q, None, 8)), expected, 8)
    # a question without terms has no number
    return _named(spark, d, index, loss).select(*loss.columns[:-1], F.coalesce("verdict", F.lit("never retrieved")).alias("verdict"))


def loss_counts(spark, d):
    return stage_loss(spark, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def latency_percentiles(spark, d):
    return evaluate.percentiles(table(spark, d, "events", "event_type", "value"), "event_type", "value").withColumns({c: F.round(c, 6) for c in ("p50", "p95_eval", "p95_planner", "p90_rank")})


def golden_coverage(spark, d):
    once = table(spark, d, "golden").groupBy("id").agg(F.min(F.struct(F.coalesce("profile", F.lit("none")).alias("profile"), F.coalesce("provenance", F.lit("none")).alias("provenance"))).alias("v"))
    n = once.groupBy("v.profile", "v.provenance").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("gap", F.greatest(F.lit(20) - F.col("n"), F.lit(0)))


def token_savings(spark, d):
    """Tokens of reading the five best files whole against the five best sections, per case, with hits."""
    s = sections_with_source(spark, d)
    q = _scored(spark, d).select("query_id", "text")
    hits = write_stage(lexical.sparse_topk(q, s, 5), "hits")
    whole = s.withColumn("tokens", X.approx_tokens(F.col("text"))).groupBy("rel_path").agg(F.sum("tokens").alias("file_tokens"))
    rows = hits.join(s.select("doc_id", "rel_path", X.approx_tokens(F.col("text")).alias("tokens")), "doc_id").join(whole, "rel_path")
    files = rows.select("query_id", "rel_path", "file_tokens").distinct().groupBy("query_id").agg(F.sum("file_tokens").alias("naive_tokens"))
    found = rows.join(_expected(spark, d).withColumnRenamed("doc_id", "rel_path"), ["query_id", "rel_path"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(True))
    cost = rows.groupBy("query_id").agg(F.sum("tokens").alias("section_tokens")).join(files, "query_id").join(found, "query_id", "left")
    return cost.select("query_id", "naive_tokens", "section_tokens", F.round(F.col("naive_tokens") / F.col("section_tokens"), 4).alias("ratio"), F.coalesce("hit", F.lit(False)).alias("hit"))


def token_totals(spark, d):
    """Both ways of reading over all cases: tokens in sum and median, their ratio, and the share of cases whose file is among the hits."""
    rows = write_stage(token_savings(spark, d).withColumn("all", F.lit(1)), "costs")
    middle = [evaluate.percentiles(rows, "all", c).select("all", F.col("p50").alias(f"median_{c}")) for c in ("naive_tokens", "section_tokens", "ratio")]
    sums = rows.groupBy("all").agg(F.count(F.lit(1)).alias("n"), F.sum("naive_tokens").alias("naive_tokens"), F.sum("section_tokens").alias("section_tokens"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"))
    for m in middle:
        sums = sums.join(m, "all")
    return sums.withColumn("total_ratio", F.round(F.col("naive_tokens") / F.col("section_tokens"), 4)).drop("all")


def _pool(spark, d, budget):
    """(question_id, parent_id, rank): the pool of two sub-queries per case, the question by BM25 and without idf. Pooled by number; only what is in it gets its ids."""
    _, _, index = _indexed(spark, d)
    arm = lambda i, idf: lexical.sparse_numbers(index, 18, idf).withColumn("query_idx", F.lit(i))
    rows = arm(0, True).unionByName(arm(1, False)).withColumn("score", F.round("score", 6))
    pool = research.evidence_pool(rows.withColumnRenamed("q", "question_id").withColumn("parent_id", F.col("n").cast("string")), "parent_id", budget)
    named = pool.select(F.col("question_id").alias("q"), "n", "rank").join(index.queries, "q").join(index.docs.select("n", "doc_id"), "n")
    return named.select(F.col("query_id").alias("question_id"), F.col("doc_id").alias("parent_id"), "rank")


def evidence_pool(spark, d):
    return _pool(spark, d, 4)


def judged_brief(spark, d):
    """What a judge keeps that says yes to sections whose id is even in its last digit."""
    pool = _pool(spark, d, 6)
    return research.brief(pool, F.conv(F.right("parent_id", F.lit(1)), 16, 10).cast("int") % 2 == 0, 6).select("question_id", "parent_id", "rank", "n_judged")


QUERIES = {f.__name__: f for f in (first_rank, recall_mrr, gate, unwinnable, out_of_reach, arm_disagreement, stage_loss, loss_counts, latency_percentiles, golden_coverage, token_savings, token_totals, evidence_pool, judged_brief)}

_CASES = """once AS (SELECT id, min(struct_pack(question := question, profile := profile, provenance := provenance, expected := expected_rel_paths, no_answer := coalesce(expect_no_answer, false))) AS v FROM golden GROUP BY id),
cases AS (SELECT id AS query_id, v.question AS text, coalesce(v.profile, 'none') AS profile, coalesce(v.provenance, 'none') AS provenance, v.expected AS expected FROM once WHERE NOT v.no_answer),
expected AS (SELECT DISTINCT query_id, doc_id FROM (SELECT query_id, unnest(expected) AS doc_id FROM cases) WHERE doc_id IS NOT NULL AND doc_id <> ''),
scored AS (SELECT * FROM cases WHERE query_id IN (SELECT query_id FROM expected))"""
_PARTS = _BM25_PARTS.format(corpus="sec").replace("questions AS (SELECT id AS query_id, min(question) AS text FROM golden GROUP BY id)", "questions AS (SELECT query_id, text FROM scored)")


def _search(*arms: str) -> str:
    return f"WITH {_CASES}, {_ONCE}, {_PARTS}, " + ", ".join(arms)


def _files_sql(name: str, hits: str) -> str:
    return f"""{name} AS (SELECT query_id, rel_path AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM (
  SELECT query_id, rel_path, rank, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id, coalesce(rel_path, '~' || h.doc_id) ORDER BY round(score, 9) DESC, rank) AS n FROM {hits} h JOIN sec ON h.doc_id = sec.doc_id) WHERE n = 1),
{name}_first AS (SELECT s.query_id, min(f.rank) AS first_rank FROM scored s LEFT JOIN (SELECT * FROM {name} SEMI JOIN expected USING (query_id, doc_id)) f ON s.query_id = f.query_id GROUP BY s.query_id)"""


_A = _search(_ranked_sql("a", "sec", True, 60), _files_sql("fa", "a"))
_LOSS = _search(
    _ranked_sql("a", "sec", True, 30),
    "qs AS (SELECT query_id, list(term) AS q, count(*) AS nq FROM qt GROUP BY query_id), ts AS (SELECT doc_id, list(DISTINCT term) AS t FROM dt WHERE doc_id IN (SELECT doc_id FROM a) GROUP BY doc_id)",
    "o AS (SELECT a.query_id, a.doc_id, a.rank AS before, len(list_intersect(q, t)) / nq::DOUBLE AS score FROM a JOIN qs ON a.query_id = qs.query_id JOIN ts ON a.doc_id = ts.doc_id)",
    "r AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM o) WHERE rank <= 8)",
    "b AS (SELECT a.query_id, min(a.rank) AS v FROM a JOIN sec ON a.doc_id = sec.doc_id JOIN expected e ON a.query_id = e.query_id AND e.doc_id = sec.rel_path GROUP BY 1)",
    "c AS (SELECT r.query_id, min(r.rank) AS v FROM r JOIN sec ON r.doc_id = sec.doc_id JOIN expected e ON r.query_id = e.query_id AND e.doc_id = sec.rel_path GROUP BY 1)",
    "dd AS (SELECT u.query_id, min(u.r) AS v FROM (SELECT query_id, rel_path, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM (SELECT query_id, any_value(rel_path) AS rel_path, min(rank) AS rank FROM a JOIN sec ON a.doc_id = sec.doc_id GROUP BY query_id, coalesce(rel_path, '~' || a.doc_id))) u JOIN expected e ON u.query_id = e.query_id AND e.doc_id = u.rel_path GROUP BY 1)",
    "loss AS (SELECT s.query_id, b.v AS rank_retrieved, dd.v AS rank_deduped, c.v AS rank_reranked, CASE WHEN b.v IS NULL THEN 'never retrieved' WHEN b.v <= 8 AND NOT coalesce(c.v <= 8, false) THEN 'lost by rerank' WHEN b.v > 8 AND coalesce(c.v <= 8, false) THEN 'rescued by rerank' WHEN coalesce(c.v <= 8, false) THEN 'ok' ELSE 'below cut' END AS verdict FROM scored s LEFT JOIN b ON s.query_id = b.query_id LEFT JOIN dd ON s.query_id = dd.query_id LEFT JOIN c ON s.query_id = c.query_id)",
)


def _pool_sql(most: int) -> str:
    return _search(
        _ranked_sql("a", "sec", True, 18), _ranked_sql("b", "sec", False, 18),
        f"u AS (SELECT query_id, doc_id, rank, round(score, 6) AS score, 0 AS query_idx FROM a WHERE rank <= {most} UNION ALL SELECT query_id, doc_id, rank, round(score, 6), 1 FROM b WHERE rank <= {most})",
        "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY query_idx, rank) AS n FROM u) WHERE n = 1)",
        "pool AS (SELECT query_id AS question_id, doc_id AS parent_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, query_idx, rank) AS rank FROM f)",
    )


SQL = {
    "first_rank": _A + " SELECT query_id, first_rank FROM fa_first",
    "recall_mrr": _A + " SELECT profile, count(*) AS n, round(avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(CASE WHEN first_rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_10, round(avg(coalesce(1.0 / first_rank, 0.0)), 6) AS mrr FROM fa_first JOIN scored USING (query_id) GROUP BY profile",
    "gate": _A + " SELECT profile, count(*) AS n, round(avg(CASE WHEN first_rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_10, CASE WHEN count(*) < 20 THEN 'INCONCLUSIVE' WHEN avg(CASE WHEN first_rank <= 10 THEN 1.0 ELSE 0.0 END) >= 0.85 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM fa_first JOIN scored USING (query_id) WHERE provenance = 'real' GROUP BY profile",
    "unwinnable": f"WITH {_CASES} SELECT query_id, doc_id, 'missing' AS reason FROM expected WHERE doc_id NOT IN (SELECT rel_path FROM files)",
    "out_of_reach": f"WITH {_CASES}, f AS (SELECT rel_path, min(source) AS source FROM files GROUP BY rel_path) SELECT e.query_id, e.doc_id, CASE WHEN f.rel_path IS NULL THEN 'missing' ELSE 'out of reach' END AS reason FROM expected e JOIN cases c ON e.query_id = c.query_id LEFT JOIN f ON e.doc_id = f.rel_path WHERE f.rel_path IS NULL OR (c.profile = 'servicenow' AND coalesce(source <> 'official', true)) OR (c.profile = 'personal' AND coalesce(source NOT IN ('personal', 'wiki', 'custom-app', 'code-graph'), true))",
    "arm_disagreement": _search(_ranked_sql("a", "sec", True, 60), _ranked_sql("b", "sec", False, 60), _files_sql("fa", "a"), _files_sql("fb", "b")) + " SELECT query_id, fa_first.first_rank AS rank_a, fb_first.first_rank AS rank_b FROM fa_first JOIN fb_first USING (query_id) WHERE fa_first.first_rank IS DISTINCT FROM fb_first.first_rank",
    "stage_loss": _LOSS + " SELECT query_id, rank_retrieved, rank_deduped, rank_reranked, verdict FROM loss",
    "loss_counts": _LOSS + " SELECT verdict, count(*) AS n FROM loss GROUP BY verdict",
    "latency_percentiles": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(n) AS n, round(median(value), 6) AS p50, round(max(CASE WHEN r = CASE WHEN n >= 20 THEN n * 95 // 100 ELSE n END THEN value END), 6) AS p95_eval, round(max(CASE WHEN r = greatest(1, n * 95 // 100) THEN value END), 6) AS p95_planner, round(max(CASE WHEN r = least(n * 9 // 10 + 1, n) THEN value END), 6) AS p90_rank FROM r GROUP BY event_type",
    "golden_coverage": "WITH o AS (SELECT id, min(struct_pack(profile := coalesce(profile, 'none'), provenance := coalesce(provenance, 'none'))) AS v FROM golden GROUP BY id) SELECT v.profile AS profile, v.provenance AS provenance, count(*) AS n, greatest(20 - count(*), 0) AS gap FROM o GROUP BY 1, 2",
    "token_savings": _search(_ranked_sql("a", "sec", True, 5), "st AS (SELECT doc_id, rel_path, greatest(1, length(text) // 4) AS tokens FROM sec)", "w AS (SELECT rel_path, sum(tokens) AS file_tokens FROM st GROUP BY rel_path)", "rows AS (SELECT query_id, a.doc_id, st.rel_path, tokens, file_tokens FROM a JOIN st ON a.doc_id = st.doc_id JOIN w ON st.rel_path = w.rel_path)", "n AS (SELECT query_id, sum(file_tokens) AS naive FROM (SELECT DISTINCT query_id, rel_path, file_tokens FROM rows) GROUP BY query_id)") + " SELECT rows.query_id, any_value(naive)::BIGINT AS naive_tokens, sum(tokens)::BIGINT AS section_tokens, round(any_value(naive) / sum(tokens)::DOUBLE, 4) AS ratio, bool_or((rows.query_id, rel_path) IN (SELECT (query_id, doc_id) FROM expected)) AS hit FROM rows JOIN n ON rows.query_id = n.query_id GROUP BY rows.query_id",
    "evidence_pool": _pool_sql(12) + " SELECT question_id, parent_id, rank FROM pool",
    "judged_brief": _pool_sql(18) + """, y AS (SELECT *, rank > 3 AND right(parent_id, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS yes FROM pool WHERE rank <= 15),
z AS (SELECT *, least(3, rank - 1) + coalesce(sum(yes::INT) OVER (PARTITION BY question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 6 AS reached FROM y),
k AS (SELECT *, sum((rank > 3 AND reached)::INT) OVER (PARTITION BY question_id) AS n_judged FROM z)
SELECT question_id, parent_id, rank, n_judged FROM (SELECT question_id, parent_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank, n_judged::BIGINT AS n_judged FROM k WHERE reached AND (rank <= 3 OR yes)) WHERE rank <= 6""",
}
SQL["token_totals"] = f"SELECT count(*) AS n, sum(naive_tokens)::BIGINT AS naive_tokens, sum(section_tokens)::BIGINT AS section_tokens, round(avg(hit::INT::DOUBLE), 6) AS hit_rate, median(naive_tokens)::DOUBLE AS median_naive_tokens, median(section_tokens)::DOUBLE AS median_section_tokens, median(ratio) AS median_ratio, round(sum(naive_tokens) / sum(section_tokens)::DOUBLE, 4) AS total_ratio FROM ({SQL['token_savings']}) HAVING count(*) > 0"
