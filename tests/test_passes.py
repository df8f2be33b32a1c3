"""The index pass, reading without an index, the research loop, answers and endpoints."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from skarn.functions import text as X
from skarn.operators import baseline, index_pass, lexical, research, search
from skarn.operators.references import dangling_references, references, target_intervals
from tests.brute import rows

MANIFEST = "rel_path string, sha256 string, status string, chunk_count int, indexed_at string"
AT = "2026-02-03T04:05:06+00:00"


def test_index_pass(spark):
    manifest = spark.createDataFrame([("a.md", "1", "pending", None, None), ("gone.md", "2", "Pending ", None, None), ("blank.md", "3", "pending", 4, None), ("null.md", "4", "pending", None, None), ("old.md", "5", "indexed", 1, "x"), ("index.md", "6", "skipped", None, None)], MANIFEST)
    corpus = spark.createDataFrame([("a.md", "# A\n\nsome text"), ("blank.md", " \n"), ("null.md", None), ("old.md", "other")], "rel_path string, text string")
    none = spark.createDataFrame([("z", "walk", "m", "t")], index_pass.ERRORS)
    first = index_pass.index_pass(manifest, corpus, None, none, AT)
    assert (first.n_files, first.n_failed, first.n_chunks) == (2, 2, 1)
    assert rows(first.manifest, "rel_path", "status", "chunk_count", "indexed_at") == sorted([("a.md", "indexed", 1, AT), ("blank.md", "indexed", 0, AT), ("gone.md", "Pending ", None, None), ("null.md", "pending", None, None), ("old.md", "indexed", 1, "x"), ("index.md", "skipped", None, None)], key=str)
    assert rows(first.errors, "rel_path", "phase") == [("gone.md", "embed"), ("null.md", "embed"), ("z", "walk")]
    assert rows(first.points, "rel_path", "text") == [("a.md", "# A\n\nsome text")]
    again = index_pass.index_pass(first.manifest, corpus, first.points, first.errors, AT, everything=True)
    assert rows(again.points, "rel_path") == [("a.md",), ("old.md",)] and again.errors.count() == 5  # the two that could not be read fail again
    assert index_pass.index_pass(manifest.limit(0), corpus, None, none, AT).n_files == 0


def test_a_file_that_breaks_does_not_stop_the_others(spark):
    from skarn.operators import chunking

    docs = spark.createDataFrame([("a.md", "text"), ("b.md", "more")], "rel_path string, text string")
    got = chunking.sections_or_errors(docs)
    assert rows(got, "rel_path", "error") == [("a.md", None), ("b.md", None)]
    assert got.drop("error").columns == chunking.sections(docs).columns


def test_densest_files_against_a_loop(spark):
    docs = {"a.md": "GlideRecord here\nnothing\nglideRECORD and roles", "bb.md": "roles\nroles\nROLES", "c.md": None, "d.md": "", "cc.md": "roles\nglide\nroles\nx"}
    q = spark.createDataFrame([("q1", "How do GlideRecord roles work"), ("q2", "is it the"), ("q3", None)], "query_id string, text string")
    d = spark.createDataFrame(list(docs.items()), "rel_path string, text string")
    terms = ["gliderecord", "roles", "work"]
    want = sorted(((-sum(any(t in x.lower() for t in terms) for x in text.split("\n")), len(p), p) for p, text in docs.items() if text), key=lambda x: x)
    got = sorted((r["rank"], r["rel_path"], r["n_lines"]) for r in baseline.densest_files(q, d, 2).collect())
    assert got == [(i + 1, p, -n) for i, (n, _, p) in enumerate(want[:2])]
    cost = baseline.reading_cost(q, d, spark.createDataFrame([("q1", "bb.md")], "query_id string, rel_path string"), 2, most_lines=1).collect()
    assert [(r["query_id"], r["tokens"], r["files_opened"], r["hit"]) for r in cost] == [("q1", (len("roles") + len("GlideRecord here")) // 4, 2, True)]
    assert baseline.densest_files(q.limit(0), d).count() == baseline.densest_files(q, d.limit(0)).count() == 0


def test_item_cost_is_that_of_escaped_json(spark):
    data = [(1, "plain"), (2, 'é "q" \\ \n\t /'), (3, "漢字 😀"), (None, None), (5, "\x7f\x01")]
    got = [r[0] for r in spark.createDataFrame(data, "rank int, text string").select(X.item_cost("rank", "text")).collect()]
    assert got == [len(json.dumps({"rank": a, "text": b})) for a, b in data]


def _ask(question):
    if "broken" in question:
        return "I can't"
    return '```json\n{"queries": ["' + question + '", "roles", "", "flows"], "profile": "' + ("personal" if "note" in question else "other") + '", "reason": "r"}\n```'


def _judge(question, excerpt):
    assert len(excerpt) <= research.EXCERPT_CHARS
    return "  No, it is not" if "unrelated" in excerpt else "maybe"


def test_research_loop(spark):
    texts = [(f"d{i}", ("unrelated " if i % 2 else "") + f"roles and flows number {i} " + "x" * 2000) for i in range(12)]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    q = spark.createDataFrame([("q1", "how do roles work"), ("q2", "a note on flows")], "query_id string, text string")

    def retrieve(queries, profile):
        return lexical.sparse_topk(queries, docs, 18).join(docs, "doc_id")

    plans = rows(research.plans_of(q, _ask), "question_id", "query_idx", "text", "profile")
    assert plans == sorted([("q1", 0, "how do roles work", "general"), ("q1", 1, "roles", "general"), ("q1", 2, "flows", "general"), ("q2", 0, "a note on flows", "personal"), ("q2", 1, "roles", "personal"), ("q2", 2, "flows", "personal")], key=str)
    found = research.research(q, _ask, retrieve, _judge, budget=5).collect()
    assert {r["question_id"] for r in found} == {"q1", "q2"}
    for name in ("q1", "q2"):
        mine = sorted((r["rank"], r["doc_id"], r["n_judged"]) for r in found if r["question_id"] == name)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and len(mine) <= 5
        assert all(int(d[1:]) % 2 == 0 for _, d, _ in mine[research.FREE_RANKS :])  # judged ones are related
        assert 0 < mine[0][2] <= research.MOST_JUDGED
    plain = research.research(q, _ask, retrieve, None, budget=2).collect()
    assert len(plain) == 4 and {r["n_judged"] for r in plain} == {0}
    assert research.research(q.limit(0), _ask, retrieve, _judge).count() == 0
    with pytest.raises(Exception, match="no planner"):
        research.plans_of(q, research.no_planner).collect()
    assert rows(spark.createDataFrame([("no",), (" NO way",), ("yes",), ("",), (None,)], "a string").select(research.is_relevant(F.col("a")).alias("r"))) == [(False,), (False,), (None,), (True,), (True,)]


def test_chat_endpoint():
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def _send(self, value):
            data = json.dumps(value).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self._send({"data": [{"id": "small:3b"}]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            ok = body["temperature"] == 0 and body["max_tokens"] == 400
            self._send({"choices": [{"message": {"content": body["messages"][0]["content"].upper()}}]} if ok else {})

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    chat = research.ChatEndpoint(url, "small", timeout=5)
    assert chat("hello") == "HELLO" and chat.reachable()
    assert not research.ChatEndpoint(url, "large", timeout=5).reachable()
    with pytest.raises(research.PlannerUnavailable):
        research.ChatEndpoint(url, "small", max_tokens=1, timeout=5)("hello")
    server.shutdown()
    server.server_close()
    assert not chat.reachable()
    with pytest.raises(research.PlannerUnavailable):
        chat("hello")


def test_answers_map_errors(spark):
    texts = spark.createDataFrame([("s1", "some text"), ("s2", "other")], "doc_id string, text string")
    hits = spark.createDataFrame([("q", 1, "s1", "b.md"), ("q", 2, "s2", "a.md"), ("q", 3, "s1", "b.md")], "query_id string, rank int, doc_id string, rel_path string")

    def fails(error):
        raise error

    good = search.answered(lambda: hits, texts)
    assert good.error is None and rows(good.citations) == [("q", ["b.md", "a.md"])]
    assert rows(search.answered(lambda: hits, texts, max_chars=1).citations) == [("q", ["b.md"])]
    assert search.answered(lambda: fails(ValueError("k")), texts).error == search.BAD_REQUEST
    assert search.answered(lambda: fails(research.PlannerUnavailable("x")), texts).error == search.BACKEND_UNAVAILABLE


def test_line_search_is_checked(spark):
    s = spark.createDataFrame([("a/x.md", "needle", "official"), ("b/y.md", "needle\nneedle", "official"), ("c.md", "needle", "wiki")], "rel_path string, text string, source string")
    lines, files = search.find_lines(s, "needle", search.PROFILES["servicenow"], "b")
    assert lines.count() == 2 and rows(files) == [("b/y.md",)]
    assert search.find_lines(s, "needle", search.PROFILES["general"])[1].count() == 3
    for bad in (("", search.PROFILES["general"], None), ("x" * 501, search.PROFILES["general"], None), ("x", search.PROFILES["general"], "a")):
        with pytest.raises(ValueError):
            search.find_lines(s, *bad)


def test_times_of_records_without_a_key_or_with_very_many_rows(spark):
    from datetime import datetime, timedelta

    t = datetime(2025, 1, 1)
    data = [("hot", f"f{i}", t + timedelta(days=i % 50)) for i in range(300)] + [(None, f"g{i}", t + timedelta(days=3 + i)) for i in range(40)] + [("one", "f1", t), ("one", "f1", t + timedelta(days=9))]
    df = spark.createDataFrame(data, "k string, rel_path string, at timestamp")
    from skarn.operators.references import references_of

    got = references_of(df, "t", {"rel_path": ("files", "rel_path")}, "k", "at", rows_per_salt=50)
    assert got.count() == 341
    assert {(r["record_key"], r["ref_time"]) for r in got.select("record_key", "ref_time").distinct().collect()} == {("hot", t), (None, t + timedelta(days=3)), ("one", t)}
    refs = references(df, "t", "rel_path", "files", "k", "rel_path", "at")
    gone = spark.createDataFrame([("g0", t + timedelta(days=5)), ("g1", t + timedelta(days=1)), ("g2", None)], "rel_path string, at timestamp")
    targets = target_intervals(df.limit(0), "files", "rel_path", "at", gone, "rel_path", F.col("at"))
    found = dangling_references(refs, targets).where("record_key IS NULL AND ref_key IN ('g0', 'g1', 'g2', 'g3')")
    assert rows(found, "ref_key", "state", "was_valid") == [("g0", "deleted", True), ("g1", "deleted", False), ("g2", "deleted", None), ("g3", "missing", None)]
