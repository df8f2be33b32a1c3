"""Search queries: dense, sparse, fused, policies, line search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import text as X
from skarn.operators import fusion, lexical, vector
from skarn.plans.stage import write_stage
from skarn.plans.tables import spread, table

K = 10
#: Ids of sections that come more than once, of which the list may be broadcast (some 30 MB).
MAX_BROADCAST_IDS = 300_000
#: What the line queries look for.
SYMBOL = "flowKit."


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"), "label")


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 100."""
    return _points(spark, d).where(F.col("point_id") % 100 == 0).select(F.col("point_id").alias("query_id"), "vector")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "golden").groupBy("id").agg(F.min("question").alias("text")).select(F.col("id").alias("query_id"), "text")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents", "doc_id", "text", "source", "lang"), "doc_id")


def sections_with_source(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, rel_path, text, source): sections, one row per id, with the source of their file (null if it has none)."""
    sources = table(spark, d, "files").groupBy("rel_path").agg(F.min("source").alias("source"))
    once = _paged(spark, d).withColumnRenamed("parent_id", "doc_id")
    return once.join(sources, "rel_path", "left").select("doc_id", "rel_path", "text", "source")


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def dense_topk(spark, d):
    return _ranked(vector.dense_topk(_vector_queries(spark, d), _points(spark, d), K))


def dense_topk_filtered(spark, d):
    return _ranked(vector.dense_topk(_vector_queries(spark, d), _points(spark, d), K, keep=F.col("label").isin(1, 3, 5)))


def dense_threshold(spark, d):
    return _ranked(vector.dense_topk(_vector_queries(spark, d), _points(spark, d), 50, min_score=0.2))


def lsh_topk(spark, d):
    return _ranked(vector.lsh_topk(_vector_queries(spark, d), _points(spark, d), K))


def term_postings(spark, d):
    return lexical.postings(_docs(spark, d))


def doc_stats(spark, d):
    return lexical.doc_stats(_docs(spark, d))


def bm25_topk(spark, d):
    return _ranked(lexical.sparse_topk(_questions(spark, d), _docs(spark, d), K))


def tf_topk(spark, d):
    return _ranked(lexical.sparse_topk(_questions(spark, d), _docs(spark, d), K, idf=False))


def rrf_hybrid(spark, d):
    q, docs = _questions(spark, d), _docs(spark, d)
    index = lexical.matched_index(q, docs)
    arms = [lexical.sparse_topk(q, docs, K * fusion.PREFETCH, idf=i, index=index) for i in (True, False)]
    return fusion.rrf(arms, K).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def hybrid_search(spark, d):
    """Dense (stand-in encoder) and BM25 arms, fused, reranked by term overlap: the whole search pipeline."""
    q, docs = _questions(spark, d), _docs(spark, d)
    encode = lambda rows, key: vector.hashed_embedding(rows, key, "text")
    dense = vector.dense_topk(encode(q, "query_id"), encode(docs, "doc_id").withColumnRenamed("doc_id", "point_id"), 30 * fusion.PREFETCH).withColumnRenamed("point_id", "doc_id")
    sparse = lexical.sparse_topk(q, docs, 30 * fusion.PREFETCH)
    return _ranked(fusion.overlap_rerank(write_stage(fusion.rrf([dense, sparse], 30), "hits"), q, docs, 8)).select("query_id", "doc_id", "rank", "score")


def parent_dedupe(spark, d):
    hits = vector.dense_topk(_vector_queries(spark, d), _points(spark, d), 30).withColumnRenamed("point_id", "doc_id")
    labelled = hits.join(_points(spark, d).select(F.col("point_id").alias("doc_id"), "label"), "doc_id")
    return _ranked(fusion.best_per_parent(labelled, "label")).select("query_id", "doc_id", "label", "rank", "score")


def _with_source(spark, d, hits):
    return hits.join(_docs(spark, d).select("doc_id", "source"), "doc_id")


def rerank_overlap(spark, d):
    q, docs = _questions(spark, d), _docs(spark, d)
    return _ranked(fusion.overlap_rerank(write_stage(lexical.sparse_topk(q, docs, 30), "hits"), q, docs, 8)).select("query_id", "doc_id", "rank", "score")


def type_boost(spark, d):
    hits = _with_source(spark, d, lexical.sparse_topk(_questions(spark, d), _docs(spark, d), K))
    return fusion.boosted(hits, F.col("source").isin("api-reference", "style-guides")).select("query_id", "doc_id", "source", "rank")


def lexical_promote(spark, d):
    """Hits whose text holds the longest content term of the question go first."""
    q, docs = _questions(spark, d), _docs(spark, d)
    hits = lexical.sparse_topk(q, docs, K)
    longest = q.select("query_id", F.get(X.content_terms(F.col("text")), F.lit(0)).alias("term"))
    texts = docs.select("doc_id", "text").join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    found = hits.join(longest, "query_id").join(texts, "doc_id").where(F.contains("text", F.col("term"))).select("query_id", "doc_id")
    return fusion.promoted(hits, found, "doc_id").select("query_id", "doc_id", "rank")


#: Sources that each search profile may reach; no list means all.
PROFILES = {"general": None, "official": ["official"], "personal": ["personal", "wiki", "custom-app", "code-graph"]}


def _policy(profile: str):
    def run(spark, d):
        sources = PROFILES[profile]
        keep = None if sources is None else F.col("source").isin(sources)
        return _ranked(lexical.sparse_topk(_questions(spark, d), sections_with_source(spark, d), 5, keep=keep))

    return run


def _paged(spark, d):
    """Section texts by id, one row each. Only the texts of ids that come more than once are shuffled."""
    rows = table(spark, d, "parents", "parent_id", "rel_path", "text")
    several = write_stage(rows.groupBy("parent_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select(F.col("parent_id").alias("_several")), "several")
    least = lambda x: x.groupBy("parent_id").agg(F.min(F.struct("rel_path", "text")).alias("v")).select("parent_id", "v.rel_path", "v.text")
    if several.count() > MAX_BROADCAST_IDS:
        return least(rows)
    same = F.col("parent_id").eqNullSafe(F.col("_several"))
    return rows.join(F.broadcast(several), same, "left_anti").unionByName(least(rows.join(F.broadcast(several), same, "left_semi")))


def lexical_lines(spark, d):
    return lexical.line_search(_paged(spark, d), SYMBOL, key="parent_id", max_per_file=3).select("parent_id", "line_no", "line")


def lexical_regex(spark, d):
    return lexical.line_search(_paged(spark, d), r"[a-z]+[A-Z][A-Za-z]*\.[a-z]+[A-Z][A-Za-z]*\(", fixed=False, key="parent_id").select("parent_id", "line_no")


def lexical_context(spark, d):
    hits = lexical.line_search(_paged(spark, d), SYMBOL, key="parent_id", context=2)
    return hits.select("parent_id", "line_no", F.array_join("before", "~").alias("before"), F.array_join("after", "~").alias("after"))


def lexical_citations(spark, d):
    """Files with a matching line in the official source, each once."""
    s = sections_with_source(spark, d).where(F.col("source") == "official")
    return lexical.line_search(s, SYMBOL, key="rel_path").groupBy("rel_path").agg(F.count(F.lit(1)).alias("n_lines"))


def match_density(spark, d):
    """The five texts with most matching lines; ties to the shorter path, then the path."""
    counts = lexical.match_counts(_paged(spark, d).select(F.col("parent_id").alias("rel_path"), "text"), SYMBOL)
    return counts.orderBy(F.desc("n_lines"), F.length("rel_path"), "rel_path").limit(5)


def symbol_hits(spark, d):
    """The three longest content terms of each question, with up to ten documents that hold the term: the candidates for promotion."""
    q = _questions(spark, d)
    wanted = q.select("query_id", F.posexplode(X.content_terms(F.col("text"), 3)).alias("pos", "symbol")).withColumn("symbol", F.lower("symbol"))
    # only postings of these terms are made; a symbol's documents are picked once, however many questions have it
    index = lexical.matched_index(wanted.select("query_id", F.col("symbol").alias("text")), _docs(spark, d))
    return wanted.join(lexical.first_docs(index, 10).withColumnRenamed("term", "symbol"), "symbol").select("query_id", "pos", "symbol", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (dense_topk, dense_topk_filtered, dense_threshold, lsh_topk, term_postings, doc_stats, bm25_topk, tf_topk, rrf_hybrid, hybrid_search, parent_dedupe, rerank_overlap, type_boost, lexical_promote, lexical_lines, lexical_regex, lexical_context, lexical_citations, match_density, symbol_hits)
} | {f"policy_{p}": _policy(p) for p in PROFILES}

_DENSE = """
WITH p AS (SELECT vec_id AS point_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
q AS (SELECT point_id AS query_id, v AS qv FROM p WHERE point_id % 100 = 0),
s AS (SELECT query_id, point_id, label, round(list_cosine_similarity(qv, v), 9) AS score FROM q, p WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM s)
"""
_TOPK = "SELECT query_id, point_id, rank, round(score, 6) AS score FROM r WHERE rank <= {k}"

_ONCE = """paged AS (SELECT parent_id, min(struct_pack(rel_path := rel_path, text := text)) AS v FROM parents GROUP BY parent_id),
sec AS (SELECT parent_id AS doc_id, v.rel_path AS rel_path, v.text AS text, src.source FROM paged LEFT JOIN (SELECT rel_path, min(source) AS source FROM files GROUP BY rel_path) src ON v.rel_path = src.rel_path)"""

_BM25_PARTS = """
questions AS (SELECT id AS query_id, min(question) AS text FROM golden GROUP BY id),
qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM questions),
dt AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {corpus}),
sized AS (SELECT c.doc_id, coalesce(n, 0) AS n_terms FROM {corpus} c LEFT JOIN (SELECT doc_id, count(*) AS n FROM dt GROUP BY doc_id) x ON c.doc_id = x.doc_id),
stats AS (SELECT count(*) AS n, avg(n_terms) AS mean FROM sized),
tf AS (SELECT term, doc_id, count(*) AS tf FROM dt GROUP BY term, doc_id),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""


def _ranked_sql(name: str, corpus: str, idf: bool, k: int, where: str = "true") -> str:
    weight = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / mean))" + (" * ln(1 + (n - df + 0.5) / (df + 0.5))" if idf else "")
    return f"""{name}_s AS (SELECT query_id, tf.doc_id, sum({weight}) AS score FROM qt JOIN tf ON qt.term = tf.term JOIN df ON tf.term = df.term JOIN sized ON tf.doc_id = sized.doc_id CROSS JOIN stats
  WHERE tf.doc_id IN (SELECT doc_id FROM {corpus} WHERE {where}) GROUP BY query_id, tf.doc_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {name}_s) WHERE rank <= {k})"""


def _bm25(arms: str, corpus: str = "documents") -> str:
    return "WITH " + _BM25_PARTS.format(corpus=corpus) + ",\n" + arms


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_PICK = "\nSELECT query_id, doc_id, rank, round(score, 6) AS score FROM {name}"
_HITS_30 = _ranked_sql("a", "documents", True, 30)
_HITS_10 = _ranked_sql("a", "documents", True, K)
_LINE_ROWS = f"lines AS (SELECT parent_id, v.rel_path AS rel_path, string_split(v.text, chr(10)) AS l FROM paged), numbered AS (SELECT parent_id, rel_path, l, unnest(generate_series(1, len(l))) AS line_no FROM lines), hit AS (SELECT parent_id, rel_path, l, line_no, l[line_no] AS line FROM numbered WHERE contains(l[line_no], '{SYMBOL}'))"
_PAGED = "paged AS (SELECT parent_id, min(struct_pack(rel_path := rel_path, text := text)) AS v FROM parents GROUP BY parent_id)"

SQL = {
    "dense_topk": _DENSE.format(where="true") + _TOPK.format(k=K),
    "dense_topk_filtered": _DENSE.format(where="label IN (1, 3, 5)") + _TOPK.format(k=K),
    "dense_threshold": _DENSE.format(where="true") + "SELECT query_id, point_id, rank, round(score, 6) AS score FROM r WHERE rank <= 50 AND score >= 0.2",
    "term_postings": "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) SELECT term, doc_id, count(*) AS tf FROM t GROUP BY term, doc_id",
    "doc_stats": "SELECT doc_id, coalesce(len(t), 0) AS n_terms, coalesce(len(list_distinct(t)), 0) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents)",
    "bm25_topk": _bm25(_HITS_10) + _PICK.format(name="a"),
    "tf_topk": _bm25(_ranked_sql("a", "documents", False, K)) + _PICK.format(name="a"),
    "rrf_hybrid": _bm25(_ranked_sql("a", "documents", True, 40) + ",\n" + _ranked_sql("b", "documents", False, 40)) + """,
f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM a UNION ALL SELECT query_id, doc_id, rank FROM b) GROUP BY query_id, doc_id),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM f)
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM g WHERE rank <= 10""",
    "parent_dedupe": _DENSE.format(where="true") + """, h AS (SELECT * FROM r WHERE rank <= 30),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, rank) AS n FROM h)
SELECT query_id, point_id AS doc_id, label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank, round(score, 6) AS score FROM b WHERE n = 1""",
    "rerank_overlap": _bm25(_HITS_30) + """,
qs AS (SELECT query_id, list(term) AS q, count(*) AS nq FROM qt GROUP BY query_id), ds AS (SELECT doc_id, list(DISTINCT term) AS t FROM dt WHERE doc_id IN (SELECT doc_id FROM a) GROUP BY doc_id),
o AS (SELECT a.query_id, a.doc_id, a.rank AS before, len(list_intersect(q, t)) / nq::DOUBLE AS score FROM a JOIN qs ON a.query_id = qs.query_id JOIN ds ON a.doc_id = ds.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM o)
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 8""",
    "type_boost": _bm25(_HITS_10) + """
SELECT query_id, a.doc_id, source, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(source IN ('api-reference', 'style-guides'), false) DESC, rank) AS rank FROM a JOIN documents d ON a.doc_id = d.doc_id""",
    "lexical_promote": _bm25(_HITS_10) + """,
w AS (SELECT query_id, unnest(t) AS term, unnest(generate_series(1, len(t))) AS i FROM (SELECT query_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.]{2,}') AS t FROM questions)),
lng AS (SELECT query_id, arg_min(term, struct_pack(a := -length(term), b := i)) AS term FROM w WHERE lower(term) NOT IN (""" + _STOP + """) GROUP BY query_id),
f AS (SELECT a.query_id, a.doc_id, a.rank, coalesce(contains(d.text, lng.term), false) AS found FROM a JOIN documents d ON a.doc_id = d.doc_id LEFT JOIN lng ON a.query_id = lng.query_id)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY found DESC, rank) AS rank FROM f""",
    "lexical_lines": f"WITH {_PAGED}, {_LINE_ROWS}, n AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY line_no) AS k FROM hit) SELECT parent_id, line_no, line FROM n WHERE k <= 3",
    "lexical_regex": f"WITH {_PAGED}, {_LINE_ROWS} SELECT parent_id, line_no FROM numbered WHERE regexp_matches(l[line_no], '[a-z]+[A-Z][A-Za-z]*\\.[a-z]+[A-Z][A-Za-z]*\\(')",
    "lexical_context": f"WITH {_PAGED}, {_LINE_ROWS} SELECT parent_id, line_no, array_to_string(l[greatest(line_no - 2, 1):line_no - 1], '~') AS before, array_to_string(l[line_no + 1:line_no + 2], '~') AS after FROM hit",
    "lexical_citations": f"WITH {_PAGED}, {_LINE_ROWS} SELECT rel_path, count(*) AS n_lines FROM hit WHERE rel_path IN (SELECT rel_path FROM files GROUP BY rel_path HAVING min(source) = 'official') GROUP BY rel_path",
    "match_density": f"WITH {_PAGED} SELECT parent_id AS rel_path, len(list_filter(string_split(v.text, chr(10)), lambda x: contains(x, '{SYMBOL}'))) AS n_lines, len(string_split(v.text, '{SYMBOL}')) - 1 AS n_matches FROM paged WHERE contains(v.text, '{SYMBOL}') ORDER BY n_lines DESC, length(parent_id), parent_id LIMIT 5",
    "symbol_hits": _bm25("""w AS (SELECT query_id, unnest(t) AS term, unnest(generate_series(1, len(t))) AS i FROM (SELECT query_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.]{2,}') AS t FROM questions)),
u AS (SELECT query_id, term, min(i) AS i FROM w WHERE lower(term) NOT IN (""" + _STOP + """) GROUP BY query_id, term),
k AS (SELECT query_id, lower(term) AS symbol, row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, i) - 1 AS pos FROM u),
h AS (SELECT query_id, pos, symbol, doc_id, row_number() OVER (PARTITION BY query_id, pos ORDER BY doc_id) AS n FROM k JOIN tf ON tf.term = symbol WHERE pos < 3)
SELECT query_id, pos, symbol, doc_id FROM h WHERE n <= 10"""),
}
for _p, _s in PROFILES.items():
    _where = "true" if _s is None else "source IN (" + ", ".join(f"'{x}'" for x in _s) + ")"
    SQL[f"policy_{_p}"] = f"WITH {_ONCE}, " + _BM25_PARTS.format(corpus="sec") + ",\n" + _ranked_sql("a", "sec", True, 5, _where) + _PICK.format(name="a")
