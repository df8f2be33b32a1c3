"""Manifest, segmentation, scalar and report queries over the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.functions import text as X
from skarn.operators import catalog, chunking, fusion, lexical
from skarn.plans.tables import spread, table
from skarn.sources import readers


def _manifest(spark, d):
    return catalog.latest(table(spark, d, "files"))


def _walk(spark, d):
    """What a walk over the files finds now, made from the manifest: hashes that end in 0 changed, those that start with f are gone, documents are new."""
    old = _manifest(spark, d).where(~F.col("sha256").startswith("f")).select("rel_path", F.when(F.col("sha256").endswith("0"), F.sha2(F.col("sha256"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    new = table(spark, d, "documents").where(F.col("doc_id").isNotNull()).select(F.concat(F.lit("raw/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return old.unionByName(new)


def _diff(spark, d):
    return catalog.manifest_diff(_walk(spark, d), _manifest(spark, d))


def classify_source(spark, d):
    return table(spark, d, "files", "rel_path").distinct().select("rel_path", catalog.source_of(F.col("rel_path")).alias("source_class"), catalog.skip_status(F.col("rel_path")).alias("status"), catalog.in_corpus(F.col("rel_path")).alias("walked"))


def unknown_folders(spark, d):
    return catalog.unknown_folders(table(spark, d, "chunks", "rel_path").distinct())


def latest_files(spark, d):
    return _manifest(spark, d).select("rel_path", "sha256", "status", "chunk_count")


def manifest_diff(spark, d):
    return _diff(spark, d)


def deletions(spark, d):
    return catalog.deletions(_diff(spark, d), table(spark, d, "chunks"))


def next_manifest(spark, d):
    return catalog.next_manifest(_diff(spark, d), _walk(spark, d), _manifest(spark, d))


def status_counts(spark, d):
    return _manifest(spark, d).groupBy(F.lower(F.trim("status")).alias("status")).agg(F.count(F.lit(1)).alias("n_files"))


def source_counts(spark, d):
    return _manifest(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"))


def drift(spark, d):
    return catalog.drift(_manifest(spark, d), table(spark, d, "chunks", "chunk_id"), table(spark, d, "child_chunks", "chunk_id"))


def pending_order(spark, d):
    return catalog.pending_order(_manifest(spark, d), 100)


def hash_order(spark, d):
    """The whole manifest with each file's place in the repeatable shuffle."""
    return catalog.hash_order(_manifest(spark, d))


def drained_chunks(spark, d):
    rows = catalog.drain(table(spark, d, "chunks"), table(spark, d, "pending_deletes"), _manifest(spark, d))
    return rows.groupBy("rel_path").agg(F.countDistinct("chunk_id").alias("n_chunks"))


def outbox(spark, d):
    """Queued deletions, once each, with whether the file is back."""
    queued = table(spark, d, "pending_deletes").groupBy("rel_path").agg(F.min(F.try_to_timestamp("detected_at")).alias("detected_at"))
    live = _manifest(spark, d).select("rel_path", F.lit(True).alias("live"))
    return queued.join(live, "rel_path", "left").select("rel_path", F.date_format("detected_at", "yyyy-MM-dd HH:mm").alias("detected_at"), F.coalesce("live", F.lit(False)).alias("live"))


def stale_files(spark, d):
    """Indexed files whose stored number of chunks differs from the chunks there are."""
    counted = table(spark, d, "chunks").where(F.col("rel_path").isNotNull()).groupBy("rel_path").agg(F.countDistinct("chunk_id").alias("n_chunks"))
    rows = _manifest(spark, d).where((F.lower(F.trim("status")) == "indexed") & F.col("chunk_count").isNotNull()).join(counted, "rel_path", "left")
    return rows.select("rel_path", "chunk_count", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")).where(F.col("chunk_count") != F.col("n_chunks"))


def error_counts(spark, d):
    return table(spark, d, "errors").groupBy(F.lower(F.trim("phase")).alias("phase"), F.coalesce(F.trim("message") == "", F.lit(True)).alias("blank")).agg(F.count(F.lit(1)).alias("n"), F.count("rel_path").alias("n_paths"))


def _docs(spark, d):
    rel = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return spread(table(spark, d, "documents", "doc_id", "source", "text"), "doc_id").select("doc_id", rel.alias("rel_path"), "source", "text")


def _sections(spark, d):
    return chunking.sections(_docs(spark, d))


def chunk_parents(spark, d):
    return chunking.parents(_sections(spark, d))


def chunk_children(spark, d):
    return chunking.children(_sections(spark, d))


def chunk_blocks(spark, d):
    return chunking.blocks(_docs(spark, d))


def chunk_sql(spark, d):
    """The table function from SQL: children per document."""
    chunking.register_sql(spark)
    _docs(spark, d).createOrReplaceTempView("_skarn_docs")
    return spark.sql("SELECT rel_path, count(*) AS n_children, max(parent_idx) AS last_parent FROM _skarn_docs, LATERAL chunk_document(text) GROUP BY rel_path")


def doc_metadata(spark, d):
    m = chunking.metadata(_docs(spark, d))
    return m.select("rel_path", "doc_title", "doc_type", F.to_json("facets").alias("facets"), F.array_join("warnings", "; ").alias("warnings"))


def replaced_index(spark, d):
    """Stored pieces of each file after the pieces of the changed and deleted files were replaced by their sections' ids."""
    old = table(spark, d, "child_chunks", "chunk_id", "rel_path").distinct()
    touched = _diff(spark, d).where(F.col("change").isin("changed", "deleted")).select("rel_path", "change")
    new = table(spark, d, "parents", "parent_id", "rel_path").distinct().join(touched.where("change = 'changed'"), "rel_path", "left_semi").select(F.col("parent_id").alias("chunk_id"), "rel_path")
    return catalog.replace_files(old, new, touched).groupBy("rel_path").agg(F.count(F.lit(1)).alias("n_chunks"))


def section_ids(spark, d):
    """Ids made from path and position, beside the stored ones."""
    rows = table(spark, d, "parents", "parent_id", "rel_path", "parent_idx").distinct()
    made = X.parent_id(F.col("rel_path"), F.col("parent_idx"))
    return rows.select("parent_id", made.alias("made_id"), X.chunk_id(F.col("rel_path"), F.col("parent_idx"), F.lit(0)).alias("first_chunk_id"), X.point_uuid(made).alias("point_uuid"))


def api_symbols(spark, d):
    return table(spark, d, "child_chunks", "chunk_id", "text").distinct().select("chunk_id", F.array_join(X.code_symbols(F.col("text")), " ").alias("symbols"), F.array_join(X.heading_symbols(F.regexp_extract("text", r"(?m)^#{1,6} .*$", 0)), " ").alias("in_heading"))


def code_like(spark, d):
    q = table(spark, d, "golden", "id", "question").distinct()
    return q.select("id", X.is_code_like(F.col("question")).alias("code_like"), F.array_join(X.query_symbols(F.col("question")), " ").alias("symbols"))


def embed_texts(spark, d):
    rows = table(spark, d, "child_chunks", "chunk_id", "rel_path", "h_path", "text").distinct()
    title = F.coalesce(F.substring_index("h_path", " > ", 1), F.lit(""))
    return rows.select("chunk_id", X.embed_text(title, F.col("rel_path"), F.coalesce("h_path", F.lit("")), F.col("text")).alias("embed_text"))


def truncated_sections(spark, d):
    """Sections cut to 800 characters: the full text by id, capped."""
    rows = table(spark, d, "parents", "parent_id", "text").groupBy("parent_id").agg(F.min("text").alias("text"))
    cut = X.truncate_chars(F.col("text"), 800)
    return rows.select("parent_id", cut["text"].alias("text"), cut["truncated"].alias("truncated"), X.approx_tokens(F.col("text")).alias("approx_tokens"))


def snippets(spark, d):
    rows = table(spark, d, "parents", "parent_id", "text").groupBy("parent_id").agg(F.min("text").alias("text"))
    return rows.select("parent_id", X.snippet(F.col("text"), 40).alias("snippet"), F.size(X.words(F.col("text"))).alias("n_words"))


def running_cap(spark, d):
    """The sections of each file that fit into 6,000 characters of JSON, in order."""
    rows = table(spark, d, "parents").groupBy("parent_id").agg(F.min(F.struct("rel_path", "parent_idx", "text")).alias("v")).select("parent_id", "v.*")
    capped = fusion.running_cap(rows, "rel_path", "parent_idx", X.item_cost("parent_id", "text"), 6000, 8)
    return capped.select("rel_path", "parent_idx", "parent_id", "running")


def outlines(spark, d):
    """Each file's outline: headings of its sections in order, capped to 3,000 characters and 40 sections."""
    rows = table(spark, d, "parents").groupBy("parent_id").agg(F.min(F.struct("rel_path", "parent_idx", F.coalesce("h_path", F.lit("")).alias("h_path"))).alias("v")).select("v.*")
    first = Window.partitionBy("rel_path").orderBy("parent_idx", "h_path")
    top = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= 40)
    line = F.concat(F.col("n").cast("string"), F.lit(". "), F.col("h_path"))
    listed = top.groupBy("rel_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda s: s["line"]), "\n").alias("text"), F.count(F.lit(1)).alias("n_sections"))
    cut = X.truncate_chars(F.col("text"), 3000)
    return listed.select("rel_path", "n_sections", cut["text"].alias("outline"), cut["truncated"].alias("truncated"))


def locate_rank(spark, d):
    """Candidate files for a word: content matches (at most 20 count) with bonuses for heading and file name and a malus for glossaries."""
    word = "rollback"
    rows = table(spark, d, "parents").groupBy("parent_id").agg(F.min(F.struct("rel_path", "h_path", "text")).alias("v")).select("v.*")
    n = F.regexp_count(F.lower("text"), F.lit(word))
    files = rows.withColumn("n", n).groupBy("rel_path").agg(F.sum("n").alias("n_matches"), F.max(F.coalesce(F.contains(F.lower("h_path"), F.lit(word)), F.lit(False))).alias("in_heading"))
    stem = F.contains(F.lower(F.substring_index("rel_path", "/", -1)), F.lit(word))
    score = F.least("n_matches", F.lit(20)) + F.when(F.col("in_heading"), 40).otherwise(0) + F.when(stem, 25).otherwise(0) - F.when(F.contains(F.lower("rel_path"), F.lit("glossary")), 15).otherwise(0)
    return files.where((F.col("n_matches") > 0) | stem).select("rel_path", score.alias("score")).orderBy(F.desc("score"), F.desc("rel_path")).limit(30)


def corpus_projection(spark, d):
    """Per source: files, sections and stored children, with sections per file: mean, median, p90 by rank, greatest."""
    per = table(spark, d, "parents").groupBy("rel_path").agg(F.countDistinct("parent_id").alias("n"))
    rows = _manifest(spark, d).select("rel_path", "source").join(per, "rel_path", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order, group = Window.partitionBy("source").orderBy("n", "rel_path"), Window.partitionBy("source")
    ranked = rows.withColumn("r", F.row_number().over(order)).withColumn("c", F.count(F.lit(1)).over(group))
    return ranked.groupBy("source").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_sections"), F.avg("n").alias("mean"), F.percentile("n", 0.5).alias("median"), F.max(F.when(F.col("r") == F.floor(F.col("c") * 9 / 10) + 1, F.col("n"))).alias("p90"), F.max("n").alias("most"))


#: What the questions among messages must be about.
DOMAIN = r"(?i)\b(?:role|flow|field|table|script|record|rollback|ticket|digest|policy|sensor|deck)s?\b"


def golden_messages(spark, d):
    """Questions of the domain among messages, mined as from transcripts: the questions of a profile are one project."""
    q = table(spark, d, "golden", "id", "question", "profile")
    return readers.mined_questions(q.select(F.col("profile").alias("project"), F.col("id").alias("file"), F.lit(1).alias("line_no"), F.col("question").alias("text")), DOMAIN)


def last_documents(spark, d):
    """The last text of each source, cut as the last message of a transcript is."""
    rows = table(spark, d, "documents", "doc_id", "source", "text", "collected_at").where(F.col("text").isNotNull() & (F.trim("text") != ""))
    return readers.last_prompts(rows.select(F.col("source").alias("file"), F.struct("collected_at", "doc_id").alias("line_no"), "text"))


QUERIES = {
    f.__name__: f
    for f in (
        classify_source, unknown_folders, latest_files, manifest_diff, deletions, next_manifest, status_counts, source_counts, drift, pending_order, hash_order, drained_chunks, outbox, stale_files, error_counts,
        chunk_parents, chunk_children, chunk_blocks, chunk_sql, doc_metadata, replaced_index, section_ids, api_symbols, code_like, embed_texts, truncated_sections, snippets, running_cap, outlines, locate_rank, corpus_projection, golden_messages, last_documents,
    )
}

_CLASS = "CASE WHEN NOT contains(rel_path, '/') THEN '" + catalog.ROOT_SOURCE + "' " + " ".join(f"WHEN split_part(rel_path, '/', 1) = '{k}' THEN '{v}'" for k, v in catalog.SOURCE_BY_FOLDER.items()) + " END"
_STATUS = "CASE WHEN regexp_extract(rel_path, '[^/]*$') = 'index.md' THEN 'skipped' ELSE 'pending' END"
_MANIFEST = """manifest AS (SELECT rel_path, sha256, source, status, bytes, chunk_count FROM (
  SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY recorded_at DESC NULLS LAST, sha256 DESC NULLS LAST, bytes DESC NULLS LAST, mtime DESC NULLS LAST, source DESC NULLS LAST, indexed_at DESC NULLS LAST, chunk_count DESC NULLS LAST, status DESC NULLS LAST) AS n
  FROM files WHERE rel_path IS NOT NULL) WHERE n = 1)"""
_WALK = """walk AS (SELECT rel_path, CASE WHEN ends_with(sha256, '0') THEN sha256(sha256) ELSE sha256 END AS sha256 FROM manifest WHERE NOT starts_with(sha256, 'f')
  UNION ALL SELECT 'raw/doc-' || doc_id || '.md', sha256(coalesce(text, '')) FROM documents WHERE doc_id IS NOT NULL)"""
_DIFF = f"""diff AS (SELECT rel_path, CASE WHEN NOT known THEN 'new' WHEN NOT walked THEN 'deleted' WHEN nh IS DISTINCT FROM oh THEN 'changed' WHEN (ns = 'skipped') <> (os = 'skipped') THEN 'flipped' ELSE 'unchanged' END AS change, nh, ns, os
  FROM (SELECT coalesce(w.rel_path, m.rel_path) AS rel_path, w.rel_path IS NOT NULL AS walked, m.rel_path IS NOT NULL AS known, w.sha256 AS nh, m.sha256 AS oh, {_STATUS.replace('rel_path', 'w.rel_path')} AS ns, m.status AS os FROM walk w FULL OUTER JOIN manifest m ON w.rel_path = m.rel_path))"""
_ALL = f"WITH {_MANIFEST}, {_WALK}, {_DIFF} "
_SECTION = "sec AS (SELECT parent_id, min(text) AS text FROM parents GROUP BY parent_id)"
_WORDS = "list_filter(string_split(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'), ' '), ' '), lambda w: w <> '')"


#: The length of a JSON object with blanks and ASCII escapes, from its compact, unescaped form.
_COST = "(length({json}) + 2 * {fields} - 1 + 5 * length(regexp_replace({json}, '[\\x{{00}}-\\x{{7E}}]', '', 'g')) + 6 * length(regexp_replace({json}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def _truncate(most: int) -> str:
    room = most - len(X.TRUNCATION_MARKER)
    last = lambda c: f"CASE WHEN contains(h, {c}) THEN length(h) - instr(reverse(h), {c}) ELSE -1 END"
    return f"(SELECT *, substr(text, 1, {room}) AS h, length(text) > {most} AS truncated FROM src), cut AS (SELECT *, {last('chr(10)')} AS nl, {last(chr(39) + ' ' + chr(39))} AS sp FROM heads), ends AS (SELECT *, CASE WHEN nl >= {room * 0.8} THEN nl ELSE sp END AS pos FROM cut), done AS (SELECT *, CASE WHEN truncated THEN (CASE WHEN pos > {room * 0.5} THEN substr(h, 1, pos) ELSE h END) || chr(10) || chr(10) || '[TRUNCATED]' ELSE text END AS out FROM ends)"


_LISTED = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _symbols(found: str, noise: str = "true") -> str:
    return f"list_sort(list_distinct(list_filter({found}, lambda s: NOT list_contains({_LISTED(X.NOISE_SYMBOLS)}, s) AND {noise})))"


# RE2 knows word boundaries of ASCII only, so that a character before and after stands for them.
_APART = "[^\\p{L}\\p{N}_]"


def _dotted(text: str) -> str:
    found = f"regexp_extract_all({text}, '(?:^|{_APART})({X.DOTTED_SYMBOL[2:].replace('[A-Za-z_$]', '[A-Za-z_]', 1)})', 1)"
    return f"list_filter({found}, lambda s: NOT list_contains({_LISTED(X.URL_TAILS)}, lower(string_split(s, '.')[-1])) AND len(list_intersect(string_split(s, '.'), {_LISTED(X.NOISE_SYMBOLS)})) = 0)"


def _camel(text: str) -> str:
    return f"regexp_extract_all(regexp_replace({text}, '({_APART})', '\\1\\1', 'g'), '(?:^|{_APART})({X.CAMEL_SYMBOL[2:-2]})(?:$|{_APART})', 1)"


def _code_symbols(text: str) -> str:
    return _symbols(f"list_concat({_dotted(text)}, {_camel(text)})")


def _heading_symbols(text: str) -> str:
    return _symbols(f"list_concat(regexp_extract_all({text}, '(?:^|{_APART}){X.HEADING_METHOD[2:]}', 1), {_camel(text)})")


_STEM = "regexp_replace(regexp_extract(rel_path, '[^/]*$'), '(.)\\.[^.]*$', '\\1')"
_TITLE = "coalesce(string_split(h_path, ' > ')[1], '')"

SQL = {
    "api_symbols": f"SELECT DISTINCT chunk_id, array_to_string({_code_symbols('text')}, ' ') AS symbols, array_to_string({_heading_symbols('h')}, ' ') AS in_heading FROM (SELECT DISTINCT chunk_id, text, regexp_extract(text, '(?m)^#{{1,6}} .*$') AS h FROM child_chunks)",
    "embed_texts": f"WITH t AS (SELECT DISTINCT chunk_id, rel_path, coalesce(h_path, '') AS h_path, text, {_TITLE} AS title, {_STEM} AS stem FROM child_chunks), u AS (SELECT *, trim(concat_ws(' ', title, array_to_string(list_filter(string_split(regexp_replace(stem, '[-_]+', ' ', 'g'), ' '), lambda w: w <> '' AND NOT contains(lower(title), lower(w))), ' '))) AS head FROM t) SELECT chunk_id, concat_ws(chr(10), CASE WHEN head <> '' THEN head END, CASE WHEN h_path <> '' THEN h_path END) || chr(10) || chr(10) || text AS embed_text FROM u",
    "classify_source": f"SELECT DISTINCT rel_path, {_CLASS} AS source_class, {_STATUS} AS status, ends_with(rel_path, '.md') AND len(list_intersect(string_split(rel_path, '/')[:-2], ['.git', '.obsidian', '.smart-env', '.claude'])) = 0 AS walked FROM files",
    "unknown_folders": f"SELECT split_part(rel_path, '/', 1) AS folder, count(*) AS n_files FROM (SELECT DISTINCT rel_path FROM chunks) WHERE rel_path IS NOT NULL AND ({_CLASS}) IS NULL GROUP BY 1",
    "latest_files": f"WITH {_MANIFEST} SELECT rel_path, sha256, status, chunk_count FROM manifest",
    "manifest_diff": _ALL + "SELECT rel_path, change, CASE WHEN change = 'deleted' THEN NULL WHEN change = 'unchanged' THEN os ELSE ns END AS status FROM diff",
    "deletions": _ALL + "SELECT rel_path FROM diff WHERE change = 'deleted' AND rel_path IN (SELECT rel_path FROM chunks WHERE rel_path IS NOT NULL)",
    "next_manifest": _ALL + "SELECT m.rel_path, m.sha256, m.status FROM manifest m JOIN diff d ON m.rel_path = d.rel_path WHERE change = 'unchanged' UNION ALL SELECT rel_path, nh, ns FROM diff WHERE change IN ('new', 'changed', 'flipped')",
    "status_counts": f"WITH {_MANIFEST} SELECT lower(trim(status)) AS status, count(*) AS n_files FROM manifest GROUP BY 1",
    "source_counts": f"WITH {_MANIFEST} SELECT source, count(*) AS n_files, sum(bytes)::BIGINT AS bytes FROM manifest GROUP BY 1",
    "drift": f"WITH {_MANIFEST}, s AS (SELECT coalesce(sum(CASE WHEN lower(trim(status)) = 'indexed' THEN chunk_count END), 0)::BIGINT AS chunk_sum FROM manifest), c AS (SELECT count(DISTINCT chunk_id) AS n_chunks FROM chunks), p AS (SELECT count(DISTINCT chunk_id) AS n_points FROM child_chunks) SELECT chunk_sum, n_chunks, n_points, n_points - chunk_sum AS drift, n_points = chunk_sum AND n_chunks = chunk_sum AS consistent FROM s, c, p",
    "pending_order": f"WITH {_MANIFEST} SELECT rel_path, source FROM manifest WHERE lower(trim(status)) = 'pending' ORDER BY rel_path LIMIT 100",
    "hash_order": f"WITH {_MANIFEST} SELECT rel_path, sha256 FROM manifest ORDER BY substr(sha256, 1, 8) NULLS FIRST, rel_path",
    "drained_chunks": "SELECT rel_path, count(DISTINCT chunk_id) AS n_chunks FROM chunks WHERE rel_path IS NULL OR rel_path NOT IN (SELECT rel_path FROM pending_deletes WHERE rel_path IS NOT NULL AND rel_path NOT IN (SELECT rel_path FROM files WHERE rel_path IS NOT NULL)) GROUP BY rel_path",
    "outbox": "SELECT rel_path, strftime(min(detected_at::TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS detected_at, rel_path IN (SELECT rel_path FROM files WHERE rel_path IS NOT NULL) AS live FROM pending_deletes GROUP BY rel_path",
    "stale_files": f"WITH {_MANIFEST}, c AS (SELECT rel_path, count(DISTINCT chunk_id) AS n FROM chunks GROUP BY rel_path) SELECT m.rel_path, chunk_count, coalesce(n, 0) AS n_chunks FROM manifest m LEFT JOIN c ON m.rel_path = c.rel_path WHERE lower(trim(status)) = 'indexed' AND chunk_count <> coalesce(n, 0)",
    "error_counts": "SELECT lower(trim(phase)) AS phase, coalesce(trim(message) = '', true) AS blank, count(*) AS n, count(rel_path) AS n_paths FROM errors GROUP BY 1, 2",
    "replaced_index": _ALL + ", t AS (SELECT rel_path, change FROM diff WHERE change IN ('changed', 'deleted')), r AS (SELECT DISTINCT chunk_id, rel_path FROM child_chunks WHERE rel_path IS NULL OR rel_path NOT IN (SELECT rel_path FROM t WHERE rel_path IS NOT NULL)), n AS (SELECT DISTINCT parent_id, rel_path FROM parents WHERE rel_path IN (SELECT rel_path FROM t WHERE change = 'changed')) SELECT rel_path, count(*) AS n_chunks FROM (SELECT chunk_id, rel_path FROM r UNION ALL SELECT parent_id, rel_path FROM n) GROUP BY rel_path",
    "section_ids": "SELECT DISTINCT parent_id, sha1(rel_path || '::' || parent_idx) AS made_id, sha1(rel_path || '::' || parent_idx || '::0') AS first_chunk_id, regexp_replace(substr(sha1(rel_path || '::' || parent_idx), 1, 32), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5') AS point_uuid FROM parents",
    "truncated_sections": f"WITH {_SECTION}, src AS (SELECT * FROM sec), heads AS {_truncate(800)} SELECT parent_id, out AS text, truncated, greatest(1, length(text) // 4) AS approx_tokens FROM done",
    "snippets": f"WITH {_SECTION}, w AS (SELECT parent_id, {_WORDS} AS w FROM sec) SELECT parent_id, CASE WHEN len(w) <= 40 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:40], ' ') || chr(10) || chr(10) || '[TRUNCATED]' END AS snippet, len(w) AS n_words FROM w",
    "running_cap": "WITH p AS (SELECT parent_id, min(struct_pack(rel_path := rel_path, parent_idx := parent_idx, text := text)) AS v FROM parents GROUP BY parent_id), r AS (SELECT v.rel_path AS rel_path, v.parent_idx AS parent_idx, parent_id, sum(" + _COST.format(json="to_json(struct_pack(parent_id := parent_id, text := v.text))", fields=2) + ") OVER w AS running, row_number() OVER w AS n FROM p WINDOW w AS (PARTITION BY v.rel_path ORDER BY v.parent_idx ROWS UNBOUNDED PRECEDING)) SELECT rel_path, parent_idx, parent_id, running::BIGINT AS running FROM r WHERE (n = 1 OR running <= 6000) AND n <= 8",
    "outlines": f"WITH p AS (SELECT min(struct_pack(rel_path := rel_path, parent_idx := parent_idx, h_path := coalesce(h_path, ''))) AS v FROM parents GROUP BY parent_id), r AS (SELECT v.rel_path AS rel_path, v.h_path AS h_path, row_number() OVER (PARTITION BY v.rel_path ORDER BY v.parent_idx, v.h_path) AS n FROM p), src AS (SELECT rel_path, string_agg(n || '. ' || h_path, chr(10) ORDER BY n) AS text, count(*) AS n_sections FROM r WHERE n <= 40 GROUP BY rel_path), heads AS {_truncate(3000)} SELECT rel_path, n_sections, out AS outline, truncated FROM done",
    "locate_rank": "WITH p AS (SELECT min(struct_pack(rel_path := rel_path, h_path := h_path, text := text)) AS v FROM parents GROUP BY parent_id), f AS (SELECT v.rel_path AS rel_path, sum(len(string_split(lower(v.text), 'rollback')) - 1) AS n, max(coalesce(contains(lower(v.h_path), 'rollback'), false)) AS h FROM p GROUP BY 1), g AS (SELECT *, contains(lower(regexp_extract(rel_path, '[^/]*$')), 'rollback') AS s FROM f) SELECT rel_path, (least(n, 20) + CASE WHEN h THEN 40 ELSE 0 END + CASE WHEN s THEN 25 ELSE 0 END - CASE WHEN contains(lower(rel_path), 'glossary') THEN 15 ELSE 0 END)::BIGINT AS score FROM g WHERE n > 0 OR s ORDER BY score DESC, rel_path DESC LIMIT 30",
    "corpus_projection": f"WITH {_MANIFEST}, per AS (SELECT rel_path, count(DISTINCT parent_id) AS n FROM parents GROUP BY rel_path), r AS (SELECT m.source, m.rel_path, coalesce(n, 0) AS n FROM manifest m LEFT JOIN per ON m.rel_path = per.rel_path), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n, rel_path) AS rn, count(*) OVER (PARTITION BY source) AS c FROM r) SELECT source, count(*) AS n_files, sum(n)::BIGINT AS n_sections, avg(n) AS mean, median(n) AS median, max(CASE WHEN rn = c * 9 // 10 + 1 THEN n END) AS p90, max(n) AS most FROM k GROUP BY source",
    "golden_messages": f"WITH m AS (SELECT id, profile AS project, question AS raw, trim(regexp_replace(question, '\\s+', ' ', 'g')) AS clean FROM golden WHERE NOT regexp_matches(question, '\\A(?:<|\\[Request interrupted|Caveat:|#|```)') AND NOT contains(question, 'tool_use_id') AND NOT contains(question, 'system-reminder') AND length(question) - length(replace(question, chr(10), '')) <= 6 AND length(question) <= 600), w AS (SELECT *, len(list_filter(string_split(clean, ' '), lambda x: x <> '')) AS n FROM m), k AS (SELECT *, substr(regexp_replace(lower(clean), '[^a-z0-9 ]', '', 'g'), 1, 80) AS key FROM w WHERE n BETWEEN 4 AND 60 AND NOT regexp_matches(clean, '{readers.COMMANDS.replace("'", "''")}') AND regexp_matches(clean, '{DOMAIN}') AND (regexp_matches(clean, '{readers.QUESTION_SHAPE.replace("'", "''")}') OR ends_with(rtrim(clean), '?'))), f AS (SELECT min(struct_pack(file := id, line_no := 1, project := project, clean := clean)) AS v FROM k GROUP BY key) SELECT v.project AS project, v.clean AS text, regexp_replace(substr(regexp_replace(lower(v.clean), '[^a-z0-9]+', '-', 'g'), 1, 40), '^-+|-+$', '', 'g') AS slug FROM f",
    "code_like": "SELECT DISTINCT id, regexp_matches(question, '\\b[a-z_$][\\w$]*\\.[a-z_$][\\w$]*|\\b[A-Z][a-z0-9]+[A-Z]\\w*|\\bsys_\\w+|\\b(?:gs|gr|g_form|g_user|current|previous)\\b') AS code_like, array_to_string(list_distinct(list_filter(regexp_extract_all(question, '\\b[a-z_$][\\w$]*\\.[a-z_$][\\w$]*|\\b[A-Z][a-z0-9]+[A-Z]\\w*|\\bsys_\\w+|\\b(?:gs|gr|g_form|g_user|current|previous)\\b'), lambda x: x <> '')), ' ') AS symbols FROM golden",
    "last_documents": "WITH r AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY collected_at DESC NULLS LAST, doc_id DESC) AS n FROM documents WHERE text IS NOT NULL AND trim(text, ' ') <> '') SELECT source AS file, substr(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), 1, 64) AS summary FROM r WHERE n = 1",
}


# Segmentation by recursion over lines: one state per document, moved on by flags that each line has by itself.
_REL = "coalesce(source, 'none') || '/' || doc_id || '.md'"
_LINES = f"""body AS (SELECT {_REL} AS rel_path, regexp_replace(text, '(?s)\\A---\\r?\\n(.*?)\\r?\\n---[ \\t]*\\r?\\n?', '') AS body FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
split AS (SELECT rel_path, unnest(regexp_extract_all(body, '[^\\n]*\\n|[^\\n]+')) AS line, generate_subscripts(regexp_extract_all(body, '[^\\n]*\\n|[^\\n]+'), 1) AS i FROM body),
bare AS (SELECT *, rtrim(line, chr(13) || chr(10)) AS b, lead(rtrim(line, chr(13) || chr(10))) OVER (PARTITION BY rel_path ORDER BY i) AS nb FROM split),
marked AS MATERIALIZED (SELECT rel_path, i, line, regexp_extract(line, '^ {{0,3}}(`{{3,}}|~{{3,}})', 1) AS f, regexp_extract(b, '^ {{0,3}}(`{{3,}}|~{{3,}})\\s*$', 1) AS c,
  len(regexp_extract_all(line, '(?i)<table\\b')) AS opens, len(regexp_extract_all(line, '(?i)</table\\b')) AS closes, contains(line, '|') AS pipe,
  contains(line, '|') AND coalesce(contains(nb, '|') AND regexp_matches(nb, '^ {{0,3}}\\|?[ \\t:|-]*-[ \\t:|-]*\\|?[ \\t]*$'), false) AS starts,
  length(regexp_extract(b, '^ {{0,3}}(#{{1,6}})[\\s\\p{{Z}}]+(.*?)[\\s\\p{{Z}}]*#*[\\s\\p{{Z}}]*$', 1)) AS lvl, regexp_replace(trim(regexp_extract(b, '^ {{0,3}}(#{{1,6}})[\\s\\p{{Z}}]+(.*?)[\\s\\p{{Z}}]*#*[\\s\\p{{Z}}]*$', 2)), '\\\\([\\\\`*_{{}}\\[\\]()#+\\-.!|~])', '\\1', 'g') AS title FROM bare)"""
_INSIDE = "CASE WHEN s.mode = 'pipe' AND s.skip = 0 AND NOT m.pipe THEN '' ELSE s.mode END"
_KIND = "CASE WHEN f <> '' THEN 'code' WHEN opens > 0 THEN 'html_table' WHEN starts THEN 'table' WHEN lvl > 0 THEN 'heading' ELSE 'text' END"
_BLOCKS_SQL = f"""WITH RECURSIVE {_LINES},
walk AS (
  SELECT rel_path, 0::BIGINT AS i, '' AS mode, '' AS fence, 0::BIGINT AS depth, 0 AS skip, '' AS kind, false AS first, []::STRUCT(l BIGINT, t VARCHAR)[] AS trail, 0::BIGINT AS lvl, '' AS line FROM body
  UNION ALL
  SELECT rel_path, i,
    CASE inside WHEN 'code' THEN CASE WHEN c <> '' AND c[1] = fence[1] AND length(c) >= length(fence) THEN '' ELSE 'code' END WHEN 'html' THEN CASE WHEN depth + opens - closes > 0 THEN 'html' ELSE '' END WHEN 'pipe' THEN 'pipe'
      ELSE CASE kind WHEN 'code' THEN 'code' WHEN 'html_table' THEN CASE WHEN opens - closes > 0 THEN 'html' ELSE '' END WHEN 'table' THEN 'pipe' ELSE '' END END,
    CASE WHEN inside = '' THEN f ELSE fence END, CASE WHEN inside = '' THEN opens - closes ELSE depth + opens - closes END, CASE WHEN inside = '' AND kind = 'table' THEN 1 ELSE 0 END,
    kind, inside = '' AND (kind <> 'text' OR was <> 'text'),
    CASE WHEN kind = 'heading' THEN list_append(list_filter(trail, lambda x: x.l < own), {{'l': own, 't': title}}) ELSE trail END, CASE WHEN kind = 'heading' THEN own ELSE 0 END, line
  FROM (SELECT m.rel_path, m.i, m.line, m.f, m.c, m.opens, m.closes, m.title, m.lvl AS own, s.fence, s.depth, s.trail, s.kind AS was, {_INSIDE} AS inside,
      CASE {_INSIDE} WHEN 'code' THEN 'code' WHEN 'html' THEN 'html_table' WHEN 'pipe' THEN 'table' ELSE {_KIND.replace("f <>", "m.f <>").replace("lvl >", "m.lvl >")} END AS kind
    FROM walk s JOIN marked m ON m.rel_path = s.rel_path AND m.i = s.i + 1)),
numbered AS (SELECT *, sum(first::INT) OVER (PARTITION BY rel_path ORDER BY i) - 1 AS block_idx FROM walk WHERE i > 0),
blk AS (SELECT rel_path, block_idx::BIGINT AS block_idx, any_value(kind) AS kind, max(lvl) AS level, array_to_string(list_transform(arg_min(trail, i), lambda x: x.t), ' > ') AS h_path, string_agg(line, '' ORDER BY i) AS text FROM numbered GROUP BY rel_path, block_idx)"""
_PARENTS_SQL = f"""{_BLOCKS_SQL},
runs AS (SELECT *, sum((kind = 'heading' AND level <= 3)::INT) OVER (PARTITION BY rel_path ORDER BY block_idx) AS run FROM blk),
sized AS MATERIALIZED (SELECT *, length(text) AS n, sum(length(text)) OVER (PARTITION BY rel_path, run) AS size, row_number() OVER (PARTITION BY rel_path, run ORDER BY block_idx) = 1 AS head FROM runs),
fold AS (
  SELECT rel_path, -1::BIGINT AS block_idx, false AS new, NULL::BIGINT AS open, 0::BIGINT AS room FROM body
  UNION ALL
  SELECT s.rel_path, s.block_idx, CASE WHEN s.size > 4000 THEN s.head OR s.n > f.room ELSE s.head AND (f.open IS NULL OR f.open >= 2000 OR f.open + s.size > 4000) END,
    (CASE WHEN s.size > 4000 THEN NULL WHEN NOT s.head THEN f.open WHEN f.open IS NULL OR f.open >= 2000 OR f.open + s.size > 4000 THEN s.size ELSE f.open + s.size END)::BIGINT,
    (CASE WHEN s.size <= 4000 THEN 0 WHEN s.head OR s.n > f.room THEN 4000 - s.n ELSE f.room - s.n END)::BIGINT
  FROM fold f JOIN sized s ON s.rel_path = f.rel_path AND s.block_idx = f.block_idx + 1),
placed AS (SELECT b.*, sum(new::INT) OVER (PARTITION BY b.rel_path ORDER BY b.block_idx) - 1 AS parent_idx FROM fold f JOIN blk b ON b.rel_path = f.rel_path AND b.block_idx = f.block_idx),
par AS (SELECT rel_path, parent_idx::INT AS parent_idx, arg_min(h_path, block_idx) AS h_path, string_agg(text, '' ORDER BY block_idx) AS whole, coalesce(string_agg(text, chr(10) ORDER BY block_idx) FILTER (kind = 'code'), '') AS code, coalesce(string_agg(text, chr(10) ORDER BY block_idx) FILTER (kind = 'heading'), '') AS heads FROM placed GROUP BY rel_path, placed.parent_idx)"""
SQL["chunk_blocks"] = _BLOCKS_SQL + " SELECT rel_path, block_idx, kind, level, h_path, text FROM blk"
SQL["chunk_parents"] = _PARENTS_SQL + f" SELECT sha1(rel_path || '::' || parent_idx) AS parent_id, rel_path, parent_idx, h_path, whole AS text, list_sort(list_distinct(list_concat({_code_symbols('code')}, {_heading_symbols('heads')}))) AS api_symbols FROM par"
