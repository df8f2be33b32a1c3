"""The search pipeline under each profile, capped answers, samples, and A/B reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.functions import text as X
from skarn.operators import chunking, evaluate, sampling, search
from skarn.plans import corpus_queries, evaluation_queries
from skarn.plans.retrieval_queries import _BM25_PARTS, _ONCE, _questions, _ranked_sql, sections_with_source
from skarn.plans.stage import write_stage
from skarn.plans.tables import table


def _indexed(spark, d):
    return sections_with_source(spark, d).withColumn("doc_type", F.when(F.contains("text", F.lit("```")), "api").otherwise("note"))


def _pipeline(profile: str, mode: str = "hybrid"):
    def run(spark, d):
        hits = search.Search(search.PROFILES[profile], mode).run(_questions(spark, d), _indexed(spark, d))
        return hits.withColumn("score", F.round("score", 6))

    return run


def capped_answers(spark, d):
    hits = search.Search(search.PROFILES["general"], "sparse").run(_questions(spark, d), _indexed(spark, d))
    return search.capped_answer(write_stage(hits, "hits"), _indexed(spark, d), 60, 1500).select("query_id", "rank", "doc_id", "running")


def facet_filter(spark, d):
    """Documents by type and facets of their frontmatter."""
    meta = chunking.metadata(corpus_queries._docs(spark, d))
    keep = search.build_filter(doc_types=("Task", "reference"), facets={"locale": ["de-DE", "fr-FR"], "release": "r24"})
    return meta.where(keep).select("rel_path", "doc_type")


def seeded_sample(spark, d):
    return sampling.seeded_sample(table(spark, d, "files", "rel_path", "source").distinct(), "rel_path", 50).select("rel_path", "source")


def needed_first(spark, d):
    expected = table(spark, d, "golden").select(F.explode("expected_rel_paths").alias("rel_path"))
    return sampling.needed_first(table(spark, d, "files", "rel_path").distinct(), "rel_path", expected, 100).select("rel_path", "is_needed")


def per_source_sample(spark, d):
    return sampling.per_group_sample(table(spark, d, "documents", "doc_id", "source"), "source", "doc_id", 5)


def title_sniff(spark, d):
    """A title from the first 30 lines: a title line of the frontmatter, or a first-level heading."""
    head = F.array_join(F.slice(F.split("text", "\n", 31), 1, 30), "\n")
    rows = table(spark, d, "documents", "doc_id", "text").select("doc_id", head.alias("h"))
    named, heading = F.regexp_extract("h", r'(?m)^title:[ ]*"?([^"\n]*)', 1), F.regexp_extract("h", r"(?m)^# ([^\n]*)", 1)
    return rows.select("doc_id", F.when(named != "", named).when(heading != "", heading).alias("title"))


def arm_deltas(spark, d):
    """Both arms side by side: cases, found at 10, mean reciprocal rank, never found."""
    filed = evaluation_queries._filed(spark, d)
    arms = [evaluation_queries._ranks(spark, d, idf, filed).withColumn("arm", F.lit(name)) for name, idf in (("with_idf", True), ("without_idf", False))]
    rows = arms[0].unionByName(arms[1])
    m = evaluate.recall_mrr(rows, "arm").withColumns({c: F.round(c, 6) for c in ("recall_at_5", "recall_at_10", "mrr")})
    lost = rows.groupBy("arm").agg(F.count_if(F.col("first_rank").isNull()).alias("never_found"))
    return m.join(lost, "arm")


def source_ratio(spark, d):
    """Most frequent first: sources of the documents with their share of rows and characters."""
    rows = table(spark, d, "documents", "source", "text").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"), F.sum(X.approx_tokens(F.col("text"))).alias("tokens"))
    return rows.orderBy(F.desc("n"), "source")


QUERIES = {f.__name__: f for f in (capped_answers, facet_filter, seeded_sample, needed_first, per_source_sample, title_sniff, arm_deltas, source_ratio)} | {
    "search_general": _pipeline("general"),
    "search_official": _pipeline("servicenow"),
    "search_personal": _pipeline("personal", "sparse"),
    "search_dense": _pipeline("general", "dense"),
}

_DRAW = "sha256('20260804:' || {key})"
SQL = {
    "seeded_sample": f"SELECT rel_path, source FROM (SELECT DISTINCT rel_path, source FROM files) WHERE rel_path IS NOT NULL ORDER BY {_DRAW.format(key='rel_path')}, rel_path LIMIT 50",
    "needed_first": f"WITH n AS (SELECT DISTINCT unnest(expected_rel_paths) AS rel_path FROM golden), f AS (SELECT DISTINCT rel_path FROM files WHERE rel_path IS NOT NULL) SELECT f.rel_path, n.rel_path IS NOT NULL AS is_needed FROM f LEFT JOIN n ON f.rel_path = n.rel_path ORDER BY is_needed DESC, {_DRAW.format(key='f.rel_path')}, f.rel_path LIMIT 100",
    "per_source_sample": f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_DRAW.format(key='doc_id')}, doc_id) AS n FROM documents) WHERE n <= 5",
    "title_sniff": "WITH h AS (SELECT doc_id, array_to_string(string_split(text, chr(10))[1:30], chr(10)) AS h FROM documents), t AS (SELECT doc_id, regexp_extract(h, '(?m)^title:[ ]*\"?([^\"\\n]*)', 1) AS a, regexp_extract(h, '(?m)^# ([^\\n]*)', 1) AS b FROM h) SELECT doc_id, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b END AS title FROM t",
    "arm_deltas": evaluation_queries.SQL["arm_disagreement"].split(" SELECT query_id, fa_first")[0] + ", r AS (SELECT 'with_idf' AS arm, first_rank FROM fa_first UNION ALL SELECT 'without_idf', first_rank FROM fb_first) SELECT arm, count(*) AS n, round(avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(CASE WHEN first_rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_10, round(avg(coalesce(1.0 / first_rank, 0.0)), 6) AS mrr, count(*) FILTER (first_rank IS NULL) AS never_found FROM r GROUP BY arm",
    "source_ratio": "SELECT source, count(*) AS n, sum(coalesce(length(text), 0))::BIGINT AS chars, sum(greatest(1, coalesce(length(text), 0) // 4))::BIGINT AS tokens FROM documents GROUP BY source",
}


_CODE = "\\b[a-z_$][\\w$]*\\.[a-z_$][\\w$]*|\\b[A-Z][a-z0-9]+[A-Z]\\w*|\\bsys_\\w+|\\b(?:gs|gr|g_form|g_user|current|previous)\\b"


def _vectors_sql(name: str, key: str, rows: str) -> str:
    """Stand-in vectors of rows (key, text): each word adds a sign of its MD5 in one of 64 places, unit length in single precision."""
    return f"""{name}_h AS (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS place, CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END AS sign FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM ({rows}))),
{name}_s AS (SELECT {key}, place, sum(sign) AS v FROM {name}_h GROUP BY ALL), {name}_n AS (SELECT {key}, sqrt(sum(v * v)) AS norm FROM {name}_s GROUP BY ALL),
{name}_g AS (SELECT {key}, unnest(range(64)) AS place FROM ({rows})),
{name} AS (SELECT g.{key}, list(coalesce((v / nullif(norm, 0))::FLOAT, 0)::DOUBLE ORDER BY place) AS v FROM {name}_g g LEFT JOIN {name}_s s USING ({key}, place) LEFT JOIN {name}_n n ON g.{key} = n.{key} GROUP BY g.{key})"""


def _dense_sql(name: str, docs: str, k: int) -> str:
    size = lambda c: f"sqrt(list_inner_product({c}, {c}))"
    return f"""{_vectors_sql(name + "q", "query_id", "SELECT query_id, text FROM questions")}, {_vectors_sql(name + "d", "doc_id", f"SELECT doc_id, text FROM {docs}")},
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(coalesce(list_inner_product(q.v, d.v) / nullif({size("q.v")} * {size("d.v")}, 0), 0), 9) AS score FROM {name}q q, {name}d d)) WHERE rank <= {k})"""


_FUSED = """u AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM a UNION ALL SELECT query_id, doc_id, rank FROM b) GROUP BY query_id, doc_id),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM u) WHERE rank <= 30)"""


def _overlap_sql(corpus: str) -> str:
    """Hits h, reranked by the share of the question's terms, the first eight."""
    return f"""qs AS (SELECT query_id, list(term) AS q, count(*) AS nq FROM qt GROUP BY query_id), ds AS (SELECT doc_id, list(DISTINCT term) AS t FROM dt WHERE doc_id IN (SELECT doc_id FROM h) GROUP BY doc_id),
o AS (SELECT h.query_id, h.doc_id, h.rank AS before, coalesce(len(list_intersect(q, t)), 0) / greatest(coalesce(nq, 0), 1)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS r FROM h) h LEFT JOIN qs ON h.query_id = qs.query_id LEFT JOIN ds ON h.doc_id = ds.doc_id),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM o) WHERE rank <= 8)"""


def _pipeline_sql(profile: str, mode: str) -> str:
    chosen = search.PROFILES[profile]
    where = "source IN (" + ", ".join(f"'{x}'" for x in chosen.sources) + ")" if chosen.sources else "true"
    depth = 120 if mode == "hybrid" else 30
    arms = {
        "sparse": _ranked_sql("a", "sec", True, depth, where) + ", h AS (SELECT query_id, doc_id, round(score, 9) AS score, rank FROM a)",
        "dense": _dense_sql("h", f"sec WHERE {where}", depth),
        "hybrid": _dense_sql("a", f"sec WHERE {where}", depth) + ", " + _ranked_sql("b", "sec", True, depth, where) + ", " + _FUSED,
    }[mode]
    favoured = "CASE WHEN contains(text, '```') THEN 'api' ELSE 'note' END IN (" + ", ".join(f"'{x}'" for x in chosen.boost) + ")" if chosen.boost else "false"
    return f"""WITH {_ONCE}, {_BM25_PARTS.format(corpus="sec")}, {arms}, {_overlap_sql("sec")},
b1 AS (SELECT r.query_id, r.doc_id, rel_path, text, score, row_number() OVER (PARTITION BY r.query_id ORDER BY coalesce({favoured}, false) DESC, rank) AS rank FROM r JOIN sec ON r.doc_id = sec.doc_id),
sy AS (SELECT query_id, list_distinct_ordered AS s FROM (SELECT query_id, (SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(f) AS x, generate_subscripts(f, 1) AS i) WHERE x <> '' GROUP BY x)) AS list_distinct_ordered FROM (SELECT query_id, regexp_extract_all(text, '{_CODE}') AS f FROM questions WHERE regexp_matches(text, '{_CODE}')))),
b2 AS (SELECT b1.*, coalesce(len(list_filter(s[1:3], lambda x: contains(text, x))) > 0, false) AS hit FROM b1 LEFT JOIN sy ON b1.query_id = sy.query_id),
fin AS (SELECT query_id, doc_id, rel_path, text, row_number() OVER (PARTITION BY query_id ORDER BY hit DESC, rank) AS rank, score, bool_or(hit) OVER (PARTITION BY query_id) AS used_lexical FROM b2),
con AS (SELECT query_id, count(*) AS considered FROM h GROUP BY query_id)
"""


_FOUND = "SELECT fin.query_id, doc_id, rel_path, rank, round(score, 6) AS score, considered, used_lexical FROM fin JOIN con ON fin.query_id = con.query_id"
_SNIPPET = f"w AS (SELECT query_id, rank, doc_id, {corpus_queries._WORDS} AS w FROM fin), sn AS (SELECT query_id, rank, doc_id, CASE WHEN len(w) <= 60 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:60], ' ') || chr(10) || chr(10) || '[TRUNCATED]' END AS snippet FROM w)"
_ITEM = corpus_queries._COST.format(json="to_json(struct_pack(rank := rank, doc_id := doc_id, snippet := snippet))", fields=3)
_CAPPED = _pipeline_sql("general", "sparse") + f", {_SNIPPET}, run AS (SELECT query_id, rank, doc_id, sum({_ITEM}) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM sn), kept AS (SELECT * FROM run WHERE (rank = 1 OR running <= 1500) AND rank <= 8) "
SQL |= {
    "search_general": _pipeline_sql("general", "hybrid") + _FOUND,
    "search_official": _pipeline_sql("servicenow", "hybrid") + _FOUND,
    "search_personal": _pipeline_sql("personal", "sparse") + _FOUND,
    "search_dense": _pipeline_sql("general", "dense") + _FOUND,
    "capped_answers": _CAPPED + "SELECT query_id, rank, doc_id, running FROM kept",
    "hybrid_search": f"WITH {_BM25_PARTS.format(corpus='documents')}, {_dense_sql('a', 'documents', 120)}, {_ranked_sql('b', 'documents', True, 120)}, {_FUSED}, {_overlap_sql('documents').replace('ORDER BY score DESC, rank) AS r FROM h', 'ORDER BY rank) AS r FROM h')} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM r",
}
