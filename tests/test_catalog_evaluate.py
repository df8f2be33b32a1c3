import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skarn.operators import catalog, evaluate, research
from tests.brute import rows


def test_manifest_pass(spark):
    walk = spark.createDataFrame([("wiki/a.md", "1"), ("wiki/b.md", "2x"), ("wiki/new.md", "9"), ("wiki/index.md", "5")], "rel_path string, sha256 string")
    old = spark.createDataFrame([("wiki/a.md", "1", "indexed"), ("wiki/b.md", "2", "indexed"), ("wiki/gone.md", "3", "indexed"), ("wiki/gone2.md", "4", "pending"), ("wiki/index.md", "5", "pending")], "rel_path string, sha256 string, status string")
    diff = catalog.manifest_diff(walk, old)
    assert rows(diff) == [("wiki/a.md", "unchanged", "indexed"), ("wiki/b.md", "changed", "pending"), ("wiki/gone.md", "deleted", None), ("wiki/gone2.md", "deleted", None), ("wiki/index.md", "flipped", "skipped"), ("wiki/new.md", "new", "pending")]
    chunks = spark.createDataFrame([("c", "wiki/gone.md")], "chunk_id string, rel_path string")
    assert rows(catalog.deletions(diff, chunks)) == [("wiki/gone.md",)]
    after = catalog.next_manifest(diff, walk, old)
    assert rows(catalog.manifest_diff(walk, after), "change") == [("unchanged",)] * 4
    assert catalog.manifest_diff(walk.limit(0), old.limit(0)).count() == 0


def test_classification(spark):
    paths = ["x.md", "Notion/a.md", "wiki/.git/a.md", "wiki/.git", "odd/a.md", "wiki/index.md", "wiki/a.txt", None]
    df = spark.createDataFrame([(p,) for p in paths], "rel_path string")
    got = df.select("rel_path", catalog.source_of(F.col("rel_path")).alias("s"), catalog.skip_status(F.col("rel_path")).alias("k"), catalog.in_corpus(F.col("rel_path")).alias("w")).collect()
    assert [(r["s"], r["w"]) for r in got] == [("personal", True), ("personal", True), ("wiki", False), ("wiki", False), (None, True), ("wiki", True), ("wiki", False), (None, None)]
    assert rows(catalog.unknown_folders(df)) == [("odd", 1)]


def test_latest_upsert_drain_drift(spark):
    t = datetime(2025, 1, 1)
    files = spark.createDataFrame([("a", "1", t), ("a", "2", datetime(2025, 2, 1)), ("a", "1", t), ("b", "x", None), (None, "y", t)], "rel_path string, sha256 string, recorded_at timestamp")
    assert rows(catalog.latest(files), "rel_path", "sha256") == [("a", "2"), ("b", "x")]
    old = spark.createDataFrame([("a", 1), ("b", 2)], "rel_path string, v int")
    assert rows(catalog.upsert(old, spark.createDataFrame([("b", 3), ("c", 4)], "rel_path string, v int"), "rel_path")) == [("a", 1), ("b", 3), ("c", 4)]
    assert rows(catalog.replace_files(old, old.limit(0), old.where("v = 1"))) == [("b", 2)]
    assert rows(catalog.drain(old, old.where("v = 1"), old.limit(0))) == [("b", 2)]
    manifest = spark.createDataFrame([("a", " Indexed", 2), ("b", "pending", 7)], "rel_path string, status string, chunk_count int")
    ids = spark.createDataFrame([("1",), ("2",), ("2",)], "chunk_id string")
    assert rows(catalog.drift(manifest, ids, ids)) == [(2, 2, 2, 0, True)]


def test_metrics_against_plain_python(spark):
    ranks = {"a": 1, "b": 4, "c": 9, "d": None, "e": 30}
    df = spark.createDataFrame([("p", k, v) for k, v in ranks.items()], "profile string, query_id string, first_rank int")
    r = evaluate.recall_mrr(df, "profile").first()
    assert (r["n"], r["recall_at_5"], r["recall_at_10"]) == (5, 0.4, 0.6)
    assert r["mrr"] == pytest.approx((1 + 1 / 4 + 1 / 9 + 1 / 30) / 5)
    assert evaluate.gate(df).first()["verdict"] == "INCONCLUSIVE"


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 100])
def test_percentiles(spark, n):
    values = [float((i * 37) % 101) for i in range(n)]
    r = evaluate.percentiles(spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, v double"), "g", "v").first()
    s = sorted(values)
    assert r["p50"] == statistics.median(s)
    assert r["p95_eval"] == (s[int(n * 0.95) - 1] if n >= 20 else s[-1])
    assert r["p95_planner"] == s[max(0, int(n * 95 / 100) - 1)]
    assert r["p90_rank"] == s[min(int(n * 0.9), n - 1)]


def test_stage_loss_and_unwinnable(spark):
    q = spark.createDataFrame([(x,) for x in "abcde"], "query_id string")
    exp = spark.createDataFrame([(x, "d") for x in "abcde"], "query_id string, doc_id string")
    before = spark.createDataFrame([("a", "d", 1), ("b", "d", 1), ("c", "d", 9), ("e", "d", 9)], "query_id string, doc_id string, rank int")
    after = spark.createDataFrame([("a", "d", 2), ("c", "d", 3)], "query_id string, doc_id string, rank int")
    assert rows(evaluate.stage_loss(q, before, before, after, exp, 5), "query_id", "verdict") == [("a", "ok"), ("b", "lost by rerank"), ("c", "rescued by rerank"), ("d", "never retrieved"), ("e", "below cut")]
    corpus = spark.createDataFrame([("x",)], "doc_id string")
    assert evaluate.unwinnable(exp, corpus).count() == 5


def test_summary_has_an_overall_row(spark):
    df = spark.createDataFrame([("a", False, True, True, 1.0), ("b", True, False, False, 3.0)], "g string, failed boolean, hit boolean, routed boolean, elapsed double")
    got = {r["g"]: r for r in evaluate.summary_with_total(df, "g").collect()}
    assert got["all"]["n"] == 2 and got["all"]["recall"] == 1.0 and got["b"]["recall"] is None and got["all"]["p50"] == 2.0


def test_planner_protocol():
    assert research.plan("q", lambda _: '```json\n{"queries": ["a", " ", "b", "c", "d"], "agent": "personal", "reason": "r"}\n```').queries == ("a", "b", "c")
    assert research.plan("q", lambda _: 'Sure: {"queries": [], "profile": "x"} ok') == research.Plan(("q",), "general", "")
    with pytest.raises(ValueError):
        research.plan("q", lambda _: "I can't")
    with pytest.raises(research.PlannerUnavailable):
        research.plan("q")
    assert research.words_per_item(6) == 150 and research.words_per_item(100) == 150 and research.words_per_item(0) == 900
