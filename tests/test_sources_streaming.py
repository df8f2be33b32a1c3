import json

import pytest

from skarn.plans.stage import write_stage
from skarn.sources import readers as R
from skarn.streaming.index_stream import index_stream
from tests.brute import rows


def test_corpus(spark, tmp_path):
    for name, data in {"a b.md": b"# A\n\xff", "wiki/x+y.md": "ä".encode(), ".git/c.md": b"no", "d.txt": b"no", "e/git.md": b"yes", "e/_x.md": b"no"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = {r["rel_path"]: r for r in R.read_corpus(spark, str(tmp_path)).collect()}
    assert set(got) == {"a b.md", "wiki/x+y.md", "e/git.md"}
    assert got["a b.md"]["text"] == "# A\n�" and got["a b.md"]["bytes"] == 5


def test_golden(spark, tmp_path):
    f = tmp_path / "g.yaml"
    f.write_text("- id: a\n  question: q?\n  profile: general\n  provenance: real\n  expected_rel_paths: [x.md]\n- id: b\n  question: ''\n  provenance: odd\n- id: a\n  question: q\n  provenance: negative\n  expect_no_answer: true\n")
    g = R.read_golden(spark, str(f))
    assert rows(R.golden_violations(g)) == [("a", "repeated id"), ("b", "no expectation"), ("b", "no question"), ("b", "unknown provenance")]
    corpus = spark.createDataFrame([("x.md",)], "rel_path string")
    first = g.limit(1)
    assert R.append_golden(g.limit(0), first, corpus).count() == 1
    with pytest.raises(ValueError, match="ids in use"):
        R.append_golden(first, first, corpus)
    with pytest.raises(ValueError, match="unknown paths"):
        R.append_golden(g.limit(0), first, corpus.limit(0))


def test_transcripts_and_mining(spark, tmp_path):
    user = lambda c: json.dumps({"type": "user", "message": {"content": c}})
    lines = [user("how do I group roles in a scope"), "{broken", user([{"type": "text", "text": "What is"}, {"type": "image"}, {"type": "text", "text": "a workflow role?"}]), json.dumps({"type": "assistant", "message": {"content": "x"}}), user("How do I group roles, in a scope"), user("<b>how do I role</b>"), user("run the workflow for me please now"), user("a\n" * 9 + "how role"), user("")]
    (tmp_path / "proj").mkdir()
    (tmp_path / "proj" / "s.jsonl").write_text("\n".join(lines))
    m = R.read_transcripts(spark, str(tmp_path))
    assert m.count() == 6 and rows(m, "project")[0] == ("proj",)
    q = R.mined_questions(m, r"(?i)\b(?:role|roles|workflow|scope)\b")
    assert rows(q, "text") == [("What is a workflow role?",), ("how do I group roles in a scope",)]
    assert rows(R.last_prompts(m), "summary") == [("a a a a a a a a a how role",)]


def test_destinations_and_literals(spark, tmp_path):
    assert R.destination("note.md") == "raw/inbox/note.md"
    for bad in ("", " ", "/etc/x.md", "a/../../x.md", "x\0.md", "x.exe"):
        with pytest.raises(ValueError):
            R.destination(bad)
    assert rows(R.literal_document(spark, content="hi", filename="n.md")) == [("raw/inbox/n.md", "hi")]
    for kw in ({}, {"content": "a", "path": "b"}, {"content": "a"}, {"content": "a" * (R.MOST_BYTES + 1), "filename": "n.md"}):
        with pytest.raises(ValueError):
            R.literal_document(spark, **kw)
    (tmp_path / "l.txt").write_text("a.md\n\nb.md\n")
    manifest = spark.createDataFrame([("a.md",), ("b.md",)], "rel_path string")
    assert R.read_path_list(spark, str(tmp_path / "l.txt"), manifest).count() == 2
    with pytest.raises(ValueError, match="b.md"):
        R.read_path_list(spark, str(tmp_path / "l.txt"), manifest.limit(1))


def test_index_stream_replaces_and_resumes(spark, tmp_path):
    store = R.Snapshots(spark, str(tmp_path / "store"), "rel_path", 8)
    docs = lambda data: spark.createDataFrame(data, "rel_path string, text string, recorded_at timestamp")
    from datetime import datetime

    t = datetime(2025, 1, 1)
    src = str(tmp_path / "in")
    docs([("a.md", "# A\n\nold", t), ("b.md", "b", t)]).coalesce(1).write.parquet(src)
    index_stream(spark, src, store, str(tmp_path / "state")).awaitTermination()
    docs([("a.md", "# A\n\nnew", datetime(2025, 1, 2)), ("b.md", "", datetime(2025, 1, 2))]).coalesce(1).write.mode("append").parquet(src)
    index_stream(spark, src, store, str(tmp_path / "state")).awaitTermination()
    assert rows(store.read(), "rel_path", "text") == [("a.md", "# A\n\nnew")]
    assert index_stream(spark, src, store, str(tmp_path / "state")).awaitTermination() is None


def test_stage_round_trip(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert rows(write_stage(df, "t")) == rows(df)


def test_snapshots_replace_roll_back_and_clean(spark, tmp_path):
    store = R.Snapshots(spark, str(tmp_path / "t"), "k", 4)
    with pytest.raises(FileNotFoundError):
        store.read()
    store.write(spark.range(20).selectExpr("id AS k", "'old' AS v"))
    first = store.current()
    folders = store._folders(first)
    store.replace(spark.createDataFrame([(3, "new"), (3, "more")], "k long, v string"), spark.createDataFrame([(3,), (7000,)], "k long"))
    assert len(rows(store.read())) == 21 and rows(store.read().where("v <> 'old'")) == [(3, "more"), (3, "new")]
    now = store._folders(store.current())
    assert sum(now[b] != folders[b] for b in folders) <= 2  # the other buckets were left alone
    store.rollback(first)
    assert rows(store.read()) == sorted([(i, "old") for i in range(20)], key=str)
    assert store.cleanup() >= 1 and store.read().count() == 20
    empty = R.Snapshots(spark, str(tmp_path / "e"), "k")
    empty.write(spark.range(0).selectExpr("id AS k"))
    assert empty.read().columns == ["k"] and empty.read().count() == 0


def test_late_rows_are_dropped_behind_the_watermark(spark, tmp_path):
    from datetime import datetime

    from skarn.streaming.index_stream import change_counts

    src, schema = str(tmp_path / "in"), "event_type string, ts timestamp, value double"
    add = lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        query = change_counts(spark, src, schema).writeStream.trigger(availableNow=True).outputMode("update").option("checkpointLocation", str(tmp_path / "s")).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={n}"))).start()
        query.awaitTermination()

    add([("a", datetime(2025, 1, 1, 5), 1.0), ("a", datetime(2025, 1, 9, 5), 2.0)])
    run()
    add([("a", datetime(2025, 1, 1, 6), 4.0), ("a", datetime(2025, 1, 9, 6), 8.0)])
    run()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy(R.F.date_format("window.start", "dd").alias("d")).agg(R.F.max("total").alias("t"))
    assert rows(got) == [("01", 1.0), ("09", 10.0)]


def test_question_sets_as_files(spark, tmp_path):
    path = str(tmp_path / "g.yaml")
    corpus = spark.createDataFrame([("x.md",)], "rel_path string")
    case = lambda *v: spark.createDataFrame([v], R.GOLDEN_SCHEMA)
    assert R.append_golden_file(spark, path, case("a", "what is é?", None, "real", ["x.md"], None, None), corpus) == 1
    assert R.append_golden_file(spark, path, case("b", "who?", None, "real", [], True, None), corpus) == 2
    assert rows(R.read_golden(spark, path), "id", "question", "provenance") == [("a", "what is é?", "real"), ("b", "who?", "negative")]
    with pytest.raises(ValueError, match="ids in use"):
        R.append_golden_file(spark, path, case("a", "again?", None, "real", ["x.md"], None, None), corpus)
    mined = spark.createDataFrame([("p", "How to x?", "how-to-x"), ("q", "How to x!", "how-to-x")], "project string, text string, slug string")
    assert rows(R.mined_cases(mined), "id") == [("how-to-x",), ("how-to-x-2",)]
    assert R.write_golden(R.mined_cases(mined), path) == 2
