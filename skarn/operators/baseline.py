"""What reading without an index costs: count matching lines, read the best files."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.functions.text import content_terms

#: Files that are read, and lines that are read of each.
OPEN_FILES, MOST_LINES = 5, 2_000
#: Questions that one pass over the texts looks for.
QUESTIONS_AT_ONCE = 5_000


def densest_files(questions: DataFrame, docs: DataFrame, most: int = OPEN_FILES, key: str = "rel_path") -> DataFrame:
    """(query_id, rel_path, n_lines, rank): the files (rel_path, text) with most lines that hold one of a question's content terms, whatever their case; ties to the shorter path, then the path.

    One automaton of all terms goes over each text once; a task hands on its best files of each question only. Questions
    without content terms, and null texts, have no rows. More than QUESTIONS_AT_ONCE questions take further passes.
    """
    asked = [(r[0], [t.lower() for t in r[1]]) for r in questions.select("query_id", content_terms(F.col("text"))).orderBy("query_id").collect() if r[1]]
    parts = [_matched(asked[i : i + QUESTIONS_AT_ONCE], questions, docs, most, key) for i in range(0, len(asked), QUESTIONS_AT_ONCE)] or [_matched([], questions, docs, most, key)]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("n_lines"), F.length(key), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _matched(asked: list[tuple], questions: DataFrame, docs: DataFrame, most: int, key: str) -> DataFrame:
    terms = sorted({t for _, ts in asked for t in ts})
    number = {t: i for i, t in enumerate(terms)}
    wanted = [[number[t] for t in ts] for _, ts in asked]
    shared = docs.sparkSession.sparkContext.broadcast((terms, wanted, [q for q, _ in asked]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, wanted, ids = shared.value
        if not terms:
            return
        automaton, of_term = ahocorasick.Automaton(), [[] for _ in terms]
        for i, t in enumerate(terms):
            automaton.add_word(t, i)
        automaton.make_automaton()
        for q, mine in enumerate(wanted):
            for t in mine:
                of_term[t].append(q)
        best: list[list[tuple]] = [[] for _ in ids]
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if path is None or not text:
                    continue
                seen: dict[int, set[int]] = {}
                for n, line in enumerate(text.lower().split("\n")):
                    for _, t in automaton.iter(line):
                        seen.setdefault(t, set()).add(n)
                lines: dict[int, set[int]] = {}
                for t, where in seen.items():
                    for q in of_term[t]:
                        lines[q] = lines[q] | where if q in lines else where
                for q, where in lines.items():
                    best[q].append((-len(where), len(path), path))
                    if len(best[q]) > 8 * most:
                        best[q] = sorted(best[q])[:most]
        rows = [(q, path, -n) for q, found in enumerate(best) for n, _, path in found]
        if rows:
            who, paths, counts = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in who]), pa.array(paths, pa.string()), pa.array(np.array(counts, np.int64))], ["query_id", key, "n_lines"])

    kind = questions.schema["query_id"].dataType.simpleString()
    return docs.select(key, F.col("text").cast("string").alias("text")).mapInArrow(run, f"query_id {kind}, {key} string, n_lines bigint")


def reading_cost(questions: DataFrame, docs: DataFrame, expected: DataFrame, most: int = OPEN_FILES, most_lines: int = MOST_LINES) -> DataFrame:
    """(query_id, tokens, files_opened, hit) of each question (query_id, text) that has content terms: the first lines of its densest files (rel_path, text) are read whole. ``expected`` has (query_id, rel_path)."""
    found = densest_files(questions, docs, most)
    head = F.array_join(F.slice(F.split("text", "\n", -1), 1, most_lines), "\n")
    read = docs.join(found.select("rel_path").distinct(), "rel_path", "left_semi").groupBy("rel_path").agg(F.max(F.length(head)).alias("chars"))
    rows = found.join(read, "rel_path").join(expected.select("query_id", "rel_path").distinct().withColumn("_hit", F.lit(True)), ["query_id", "rel_path"], "left")
    return rows.groupBy("query_id").agg(F.greatest(F.lit(1), F.floor(F.sum("chars") / 4)).cast("long").alias("tokens"), F.count(F.lit(1)).alias("files_opened"), F.coalesce(F.max("_hit"), F.lit(False)).alias("hit"))
