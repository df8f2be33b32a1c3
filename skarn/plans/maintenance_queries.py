"""Index upkeep, tool answers, and the cost of reading without an index."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.functions import text as X
from skarn.operators import baseline, index_pass, search
from skarn.plans import corpus_queries, evaluation_queries, pipeline_queries, retrieval_queries
from skarn.plans.stage import write_stage
from skarn.plans.tables import table

AT = "2026-01-01T00:00:00+00:00"
#: What the folder search looks for, and where.
FOLDER = "ServiceNowOfficialDocs/platform-core"
WORD = "rollback"


def _pending_counts(spark, d):
    """Pending files of the manifest with their number of chunks, if there are any."""
    counted = table(spark, d, "chunks").where(F.col("rel_path").isNotNull()).groupBy("rel_path").agg(F.countDistinct("chunk_id").alias("n_chunks"))
    return corpus_queries._manifest(spark, d).where(index_pass.is_status("pending")).select("rel_path").join(counted, "rel_path", "left")


def indexed_manifest(spark, d):
    """The manifest after the pending files that have chunks were marked."""
    counts = _pending_counts(spark, d).where(F.col("n_chunks").isNotNull())
    return index_pass.mark_indexed(corpus_queries._manifest(spark, d), counts, AT).select("rel_path", "status", "chunk_count", "indexed_at")


def error_log(spark, d):
    """The error log with the pending files added that have no chunks."""
    failed = _pending_counts(spark, d).where(F.col("n_chunks").isNull()).select("rel_path", F.lit("no chunks").alias("message"))
    return index_pass.append_errors(table(spark, d, "errors"), failed, "embed", AT)


def walk_check(spark, d):
    """Whether the files walked are as many as the manifest's rows."""
    sides = corpus_queries._walk(spark, d).select(F.lit(1).alias("w"), F.lit(0).alias("m")).unionByName(corpus_queries._manifest(spark, d).select(F.lit(0).alias("w"), F.lit(1).alias("m")))
    return sides.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n_walked"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_manifest")).withColumn("equal", F.col("n_walked") == F.col("n_manifest"))


def index_pass_files(spark, d):
    """Each document after a pass that indexes them all: status, chunks, and the error if there is one."""
    docs = corpus_queries._docs(spark, d).select("rel_path", "text")
    manifest = docs.select("rel_path", F.lit("pending").alias("status"), F.lit(None).cast("int").alias("chunk_count"), F.lit(None).cast("string").alias("indexed_at")).where(F.col("rel_path").isNotNull())
    done = index_pass.index_pass(manifest, docs, None, table(spark, d, "errors").limit(0), AT)
    return done.manifest.join(done.errors.select("rel_path", "message"), "rel_path", "left").select("rel_path", "status", F.col("message").alias("error"))


def _files(spark, d):
    """(rel_path, text): the documents as files."""
    return corpus_queries._docs(spark, d).select("rel_path", "text")


def densest_files(spark, d):
    """The five files of each question with most lines that hold one of its content terms."""
    return baseline.densest_files(retrieval_queries._questions(spark, d), _files(spark, d))


def reading_cost(spark, d):
    """Tokens of reading those files."""
    expected = table(spark, d, "golden").select(F.col("id").alias("query_id"), F.explode("expected_rel_paths").alias("rel_path"))
    return baseline.reading_cost(retrieval_queries._questions(spark, d), _files(spark, d), expected)


def answer_citations(spark, d):
    """The files cited by each capped answer, in order."""
    sections = pipeline_queries._indexed(spark, d)
    find = lambda: search.Search(search.PROFILES["general"], "sparse").run(retrieval_queries._questions(spark, d), sections)
    return search.answered(find, sections, 60, 1500).citations.select("query_id", F.array_join("citations", "~").alias("citations"))


def folder_lines(spark, d):
    """Files with a word in a folder of the official source, each once."""
    return search.find_lines(retrieval_queries.sections_with_source(spark, d), WORD, search.PROFILES["servicenow"], FOLDER)[1]


def located_files(spark, d):
    """Files for a word: those with the word in their path first, then those with it in a section that were not listed yet."""
    rows = table(spark, d, "parents", "rel_path", "text").where(F.col("rel_path").isNotNull())
    paths = table(spark, d, "files", "rel_path").where(F.contains(F.lower("rel_path"), F.lit(WORD))).distinct().withColumn("how", F.lit("path"))
    inside = rows.where(F.contains(F.lower("text"), F.lit(WORD))).select("rel_path").distinct().join(paths.select("rel_path"), "rel_path", "left_anti").withColumn("how", F.lit("content"))
    return paths.unionByName(inside)


def full_sections(spark, d):
    """Sections cut to the 8,000 characters that a tool may give back."""
    rows = table(spark, d, "parents", "parent_id", "text").groupBy("parent_id").agg(F.min("text").alias("text"))
    cut = X.truncate_chars(F.col("text"), search.CAPS["section"]["max_chars"])
    return rows.select("parent_id", F.length(cut["text"]).alias("n_chars"), F.md5(cut["text"]).alias("digest"), cut["truncated"].alias("truncated"))


def children_report(spark, d):
    """Stored children: per source of their file, children per file, their mean length, and totals scaled to all files."""
    kids = table(spark, d, "child_chunks", "chunk_id", "rel_path", "text").groupBy("chunk_id").agg(F.min("rel_path").alias("rel_path"), F.min(F.length("text")).alias("n_chars"))
    manifest = corpus_queries._manifest(spark, d).select("rel_path", "source")
    per = kids.groupBy("rel_path").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")).join(manifest, "rel_path")
    total = manifest.groupBy("source").agg(F.count(F.lit(1)).alias("n_all"))
    rows = per.groupBy("source").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_children"), F.sum("chars").alias("chars"))
    both = rows.join(total, rows["source"].eqNullSafe(total["source"])).drop(total["source"])
    return both.select("source", "n_files", "n_children", F.round(F.col("n_children") / F.col("n_files"), 6).alias("per_file"), F.round(F.col("chars") / F.col("n_children"), 4).alias("mean_chars"), F.round(F.col("n_children") * F.col("n_all") / F.col("n_files"), 4).alias("projected"))


def run_summary(spark, d):
    """The searches of the golden cases per provenance and overall: cases, those without any hit, the share found among ten, the share whose best file the profile reaches, files ranked."""
    q, s, index = evaluation_queries._indexed(spark, d)
    ranked = write_stage(evaluation_queries._files_ranked(q, s, index), "ranked")
    cases = evaluation_queries._scored(spark, d).select("query_id", "provenance", "profile")
    first = evaluation_queries.evaluate.first_ranks(cases, ranked, evaluation_queries._expected(spark, d))
    files = table(spark, d, "files").groupBy("rel_path").agg(F.min("source").alias("source")).select(F.col("rel_path").alias("doc_id"), "source")
    best = ranked.where(F.col("rank") == 1).join(files, "doc_id", "left").select("query_id", "source")
    n = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_ranked"))
    routed = F.when(F.col("profile") == "servicenow", F.coalesce(F.col("source") == "official", F.lit(False))).when(F.col("profile") == "personal", F.coalesce(F.col("source").isin(*search.PROFILES["personal"].sources), F.lit(False))).otherwise(True)
    rows = cases.join(first, "query_id").join(n, "query_id", "left").join(best, "query_id", "left")
    rows = rows.select("provenance", F.col("n_ranked").isNull().alias("failed"), (F.coalesce("first_rank", F.lit(99)) <= 10).alias("hit"), routed.alias("routed"), F.coalesce("n_ranked", F.lit(0)).alias("elapsed"))
    return evaluation_queries.evaluate.summary_with_total(rows, "provenance").withColumns({c: F.round(c, 6) for c in ("recall", "routing", "p50")})


QUERIES = {f.__name__: f for f in (indexed_manifest, error_log, walk_check, index_pass_files, densest_files, reading_cost, answer_citations, folder_lines, located_files, full_sections, children_report, run_summary)}

_PENDING = f"{corpus_queries._MANIFEST}, c AS (SELECT rel_path, count(DISTINCT chunk_id) AS n FROM chunks WHERE rel_path IS NOT NULL GROUP BY rel_path), p AS (SELECT m.rel_path, n FROM manifest m LEFT JOIN c ON m.rel_path = c.rel_path WHERE lower(trim(status)) = 'pending')"
_FILES = f"docs AS (SELECT {corpus_queries._REL} AS rel_path, text FROM documents)"
_STOPS = retrieval_queries._STOP
_DENSEST = f"""WITH {_FILES}, questions AS (SELECT id AS query_id, min(question) AS text FROM golden GROUP BY id),
tw AS (SELECT query_id, unnest(t) AS term, unnest(generate_series(1, len(t))) AS i FROM (SELECT query_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.]{{2,}}') AS t FROM questions)),
tu AS (SELECT query_id, term, min(i) AS i FROM tw WHERE lower(term) NOT IN ({_STOPS}) GROUP BY query_id, term),
tk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, i) AS k FROM tu),
terms AS (SELECT query_id, list(lower(term)) AS t FROM tk WHERE k <= 6 GROUP BY query_id),
lines AS (SELECT rel_path, unnest(string_split(lower(text), chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs WHERE text <> ''),
hits AS (SELECT DISTINCT q.query_id, l.rel_path, l.i FROM (SELECT DISTINCT query_id, unnest(t) AS w FROM terms) q JOIN lines l ON contains(l.line, q.w)),
n AS (SELECT query_id, rel_path, count(*) AS n_lines FROM hits GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_lines DESC, length(rel_path), rel_path) AS rank FROM n) WHERE rank <= 5)"""

SQL = {
    "indexed_manifest": f"WITH {_PENDING}, full_m AS (SELECT rel_path, status, chunk_count, indexed_at FROM (SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY recorded_at DESC NULLS LAST, sha256 DESC NULLS LAST, bytes DESC NULLS LAST, mtime DESC NULLS LAST, source DESC NULLS LAST, indexed_at DESC NULLS LAST, chunk_count DESC NULLS LAST, status DESC NULLS LAST) AS k FROM files WHERE rel_path IS NOT NULL) WHERE k = 1) SELECT f.rel_path, CASE WHEN n IS NULL THEN status ELSE 'indexed' END AS status, coalesce(n, chunk_count)::INT AS chunk_count, CASE WHEN n IS NULL THEN indexed_at ELSE '{AT}' END AS indexed_at FROM full_m f LEFT JOIN p ON f.rel_path = p.rel_path",
    "error_log": f"WITH {_PENDING} SELECT rel_path, phase, message, ts FROM errors UNION ALL SELECT rel_path, 'embed', 'no chunks', '{AT}' FROM p WHERE n IS NULL",
    "walk_check": f"WITH {corpus_queries._MANIFEST}, {corpus_queries._WALK}, w AS (SELECT count(*) AS a FROM walk), m AS (SELECT count(*) AS b FROM manifest) SELECT a AS n_walked, b AS n_manifest, a = b AS equal FROM w, m",
    "index_pass_files": f"WITH {_FILES} SELECT rel_path, CASE WHEN text IS NULL THEN 'pending' ELSE 'indexed' END AS status, CASE WHEN text IS NULL THEN 'the file can''t be read' END AS error FROM docs",
    "densest_files": _DENSEST + " SELECT query_id, rel_path, n_lines, rank FROM top",
    "reading_cost": _DENSEST + ", e AS (SELECT DISTINCT id AS query_id, unnest(expected_rel_paths) AS rel_path FROM golden), r AS (SELECT query_id, t.rel_path, length(array_to_string(string_split(text, chr(10))[1:2000], chr(10))) AS chars, (query_id, t.rel_path) IN (SELECT (query_id, rel_path) FROM e) AS h FROM top t JOIN docs d ON t.rel_path = d.rel_path) SELECT query_id, greatest(1, sum(chars)::BIGINT // 4) AS tokens, count(*) AS files_opened, bool_or(h) AS hit FROM r GROUP BY query_id",
    "answer_citations": pipeline_queries._CAPPED + ", f AS (SELECT kept.query_id, rel_path, min(kept.rank) AS rank FROM kept JOIN fin ON kept.query_id = fin.query_id AND kept.rank = fin.rank GROUP BY 1, 2) SELECT query_id, string_agg(rel_path, '~' ORDER BY rank) AS citations FROM f GROUP BY query_id",
    "folder_lines": f"WITH {retrieval_queries._ONCE} SELECT DISTINCT rel_path FROM sec WHERE source = 'official' AND starts_with(rel_path, '{FOLDER}/') AND contains(text, '{WORD}')",
    "located_files": f"WITH a AS (SELECT DISTINCT rel_path FROM files WHERE contains(lower(rel_path), '{WORD}')), b AS (SELECT DISTINCT rel_path FROM parents WHERE contains(lower(text), '{WORD}') AND rel_path IS NOT NULL AND rel_path NOT IN (SELECT rel_path FROM a)) SELECT rel_path, 'path' AS how FROM a UNION ALL SELECT rel_path, 'content' FROM b",
    "full_sections": f"WITH {corpus_queries._SECTION}, src AS (SELECT * FROM sec), heads AS {corpus_queries._truncate(8000)} SELECT parent_id, length(out)::INT AS n_chars, md5(out) AS digest, truncated FROM done",
    "children_report": f"WITH {corpus_queries._MANIFEST}, k AS (SELECT chunk_id, min(rel_path) AS rel_path, min(length(text)) AS n_chars FROM child_chunks GROUP BY chunk_id), per AS (SELECT m.source, k.rel_path, count(*) AS n, sum(n_chars) AS chars FROM k JOIN manifest m ON k.rel_path = m.rel_path GROUP BY 1, 2), t AS (SELECT source, count(*) AS n_all FROM manifest GROUP BY source), r AS (SELECT source, count(*) AS n_files, sum(n) AS n_children, sum(chars) AS chars FROM per GROUP BY source) SELECT r.source, n_files, n_children::BIGINT AS n_children, round(n_children / n_files::DOUBLE, 6) AS per_file, round(chars / n_children::DOUBLE, 4) AS mean_chars, round(n_children * n_all / n_files::DOUBLE, 4) AS projected FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source",
    "run_summary": evaluation_queries._A + ", k AS (SELECT query_id, count(*) AS n_ranked FROM fa GROUP BY query_id), b AS (SELECT query_id, source FROM fa LEFT JOIN (SELECT rel_path, min(source) AS source FROM files GROUP BY rel_path) s ON fa.doc_id = s.rel_path WHERE rank = 1), e AS (SELECT provenance, k.n_ranked IS NULL AS failed, coalesce(first_rank, 99) <= 10 AS hit, CASE profile WHEN 'servicenow' THEN coalesce(source = 'official', false) WHEN 'personal' THEN coalesce(source IN ('personal', 'wiki', 'custom-app', 'code-graph'), false) ELSE true END AS routed, coalesce(n_ranked, 0) AS value FROM scored c JOIN fa_first USING (query_id) LEFT JOIN k USING (query_id) LEFT JOIN b USING (query_id)) SELECT CASE WHEN grouping(provenance) = 1 THEN 'all' ELSE provenance END AS provenance, count(*) AS n, count(*) FILTER (failed) AS n_failed, round(avg(CASE WHEN NOT failed THEN hit::INT::DOUBLE END), 6) AS recall, round(avg(CASE WHEN NOT failed THEN routed::INT::DOUBLE END), 6) AS routing, round(median(value), 6) AS p50 FROM e GROUP BY GROUPING SETS ((provenance), ())",
}
