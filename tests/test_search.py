import math
import random

import numpy as np
from pyspark.sql import functions as F

from skarn.functions import text as X
from skarn.operators import fusion, lexical, vector
from tests.brute import rows


def _vectors(n, dim=16, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    return [(i, (centres[i % 6] + 0.4 * r.normal(size=dim)).tolist()) for i in range(n)]


def _brute(points, query, k):
    q = np.array(query)
    s = [(-round(float(np.dot(q, v) / (np.linalg.norm(q) * np.linalg.norm(v) or 1)), 9), i) for i, v in points]
    return [i for _, i in sorted(s)[:k]]


def test_dense_topk_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "POINT_BLOCK", 37)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    points = _vectors(200)
    p = spark.createDataFrame([*points, (900, None)], "point_id long, vector array<double>")
    q = p.where("point_id % 20 = 0").withColumnRenamed("point_id", "query_id")
    got = {}
    for qid, pid, rank, _ in sorted((tuple(r) for r in vector.dense_topk(q, p, 7).collect()), key=lambda r: (r[0], r[2])):
        got.setdefault(qid, []).append(pid)
    assert got == {i: _brute(points, v, 7) for i, v in points if i % 20 == 0}
    assert vector.dense_topk(q.limit(0), p, 7).count() == 0
    assert vector.dense_topk(q, p.limit(0), 7).count() == 0
    assert vector.dense_topk(q.where("query_id = 0"), p, 500).count() == 200


def test_lsh_recall_is_at_least_nine_tenths(spark):
    points = _vectors(600, dim=64)
    p = spark.createDataFrame(points, "point_id long, vector array<double>")
    q = p.where("point_id % 20 = 0").withColumnRenamed("point_id", "query_id")
    exact = {(r[0], r[1]) for r in vector.dense_topk(q, p, 10).collect()}
    found = {(r[0], r[1]) for r in vector.lsh_topk(q, p, 10).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    odd = p.unionByName(spark.createDataFrame([(None, [1.0] * 64), (7000, None), (7001, []), (7002, [1.0])], p.schema))
    assert {(r[0], r[1]) for r in vector.lsh_topk(q, odd, 10).collect()} == found
    assert vector.lsh_topk(q.limit(0), p, 10).count() == vector.lsh_topk(q, p.limit(0), 10).count() == 0


DOCS = [(1, "the cat sat on the mat"), (2, "The CAT cat cat"), (3, None), (4, ""), (5, "dogs und Äpfel"), (6, "mat " * 500), (7, "the cat sat on the mat")]


def test_bm25_against_a_loop(spark):
    docs = spark.createDataFrame(DOCS, "doc_id int, text string")
    queries = [("a", "cat mat"), ("b", "Äpfel"), ("c", "nothing here"), ("d", None)]
    got = {}
    for r in lexical.sparse_topk(spark.createDataFrame(queries, "query_id string, text string"), docs, 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], round(r["score"], 9)))
    import re

    toks = {i: re.findall(r"\w+", (t or "").lower()) for i, t in DOCS}
    mean, n = sum(map(len, toks.values())) / len(toks), len(toks)
    for qid, text in queries:
        want = []
        for i, t in toks.items():
            s = 0.0
            for w in set(re.findall(r"\w+", (text or "").lower())):
                df, tf = sum(w in x for x in toks.values()), t.count(w)
                s += math.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean)) if tf else 0.0
            if s:
                want.append((-round(s, 9), i))
        assert sorted(got.get(qid, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(sorted(want))]


def test_line_search(spark):
    docs = spark.createDataFrame([("a", "one\ntwo x.y\nthree\nfour x.y\nfive x.y"), ("b", "xzy"), ("c", None), ("d", "")], "rel_path string, text string")
    hits = {(r["rel_path"], r["line_no"]): (r["before"], r["after"]) for r in lexical.line_search(docs, "x.y", context=2).collect()}
    assert hits == {("a", 2): (["one"], ["three", "four x.y"]), ("a", 4): (["two x.y", "three"], ["five x.y"]), ("a", 5): (["three", "four x.y"], [])}
    assert rows(lexical.line_search(docs, "x.y", max_per_file=2), "line_no") == [(2,), (4,)]
    assert lexical.line_search(docs, "x.y", fixed=False).count() == 4
    assert rows(lexical.match_counts(docs, "x.y")) == [("a", 3, 3)]
    assert rows(lexical.lines(docs.where("rel_path = 'd'"))) == [("d", 1, "")]


HITS = [("q", 1, 1, 0.9, "p"), ("q", 2, 2, 0.9, "p"), ("q", 3, 3, 0.8, None), ("q", 4, 4, 0.8, None), ("q", 5, 5, 0.7, "r"), ("z", 1, 1, 0.1, "p")]
HIT_SCHEMA = "query_id string, doc_id int, rank int, score double, parent string"


def _order(df, q="q"):
    return [r["doc_id"] for r in sorted(df.where(F.col("query_id") == q).collect(), key=lambda r: r["rank"])]


def test_fusion_and_policy(spark):
    hits = spark.createDataFrame(HITS, HIT_SCHEMA)
    assert _order(fusion.best_per_parent(hits, "parent")) == [1, 3, 4, 5]
    assert _order(fusion.boosted(hits, F.col("parent") == "r")) == [5, 1, 2, 3, 4]
    assert _order(fusion.promoted(hits, spark.createDataFrame([("q", 3), ("q", 3), ("z", 5)], "query_id string, doc_id int"), "doc_id")) == [3, 1, 2, 4, 5]
    other = hits.withColumn("rank", 6 - F.col("rank"))
    fused = fusion.rrf([hits, other], 3)
    want = sorted(range(1, 6), key=lambda i: (-round(1 / (60 + i) + 1 / (66 - i), 12), i))[:3]
    assert _order(fused) == want
    assert fusion.rrf([hits.limit(0), hits.limit(0)], 3).count() == 0


def test_running_cap_against_a_loop(spark):
    r = random.Random(5)
    data = [(f"g{r.randrange(20)}", i, r.randrange(1, 50)) for i in range(400)]
    got = rows(fusion.running_cap(spark.createDataFrame(data, "g string, i int, c int"), "g", "i", F.col("c"), 120), "g", "i")
    want = []
    for g in {x[0] for x in data}:
        total = 0
        for k, (_, i, c) in enumerate(sorted(x for x in data if x[0] == g)):
            if k and total + c > 120:
                break
            want.append((g, i))
            total += c
    assert got == sorted(want, key=str)


def test_judge_against_a_loop(spark):
    r = random.Random(9)
    pool = [(f"q{q}", k, r.random() < 0.5) for q in range(120) for k in range(1, r.randrange(1, 25))]
    got = {}
    for x in fusion.judged(spark.createDataFrame(pool, "question_id string, rank int, yes boolean"), F.col("yes"), 6).collect():
        got.setdefault(x["question_id"], ([], x["n_judged"]))[0].append(x["rank"])
    for q in {p[0] for p in pool}:
        kept, calls = [], 0
        for _, k, yes in sorted(p for p in pool if p[0] == q):
            if len(kept) >= 6:
                break
            if k > 3:
                if calls == 12:
                    break
                calls += 1
                if not yes:
                    continue
            kept.append(k)
        assert (sorted(got[q][0]), got[q][1]) == (kept, calls), q


def test_first_seen(spark):
    e = spark.createDataFrame([("q", 0, 1, "a"), ("q", 0, 2, ""), ("q", 1, 1, "a"), ("q", 1, 2, ""), ("q", 1, 3, None), ("q", 1, 4, "b")], "question_id string, query_idx int, rank int, parent string")
    assert rows(fusion.first_seen(e, "parent"), "query_idx", "rank") == [(0, 1), (0, 2), (1, 2), (1, 3), (1, 4)]


def _one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first()["v"]


def test_scalars(spark):
    t = F.col("t")
    assert [_one(spark, x, X.approx_tokens(t)) for x in (None, "", "abcd" * 3, "😀" * 9)] == [1, 1, 3, 2]
    assert _one(spark, "a b c", X.truncate_chars(t, 100))["truncated"] is False
    long = "word " * 100
    cut = _one(spark, long, X.truncate_chars(t, 100))
    assert cut["truncated"] and len(cut["text"]) <= 100 and cut["text"].endswith("word" + X.TRUNCATION_MARKER)
    assert _one(spark, "x" * 500, X.truncate_chars(t, 100))["text"] == "x" * (100 - len(X.TRUNCATION_MARKER)) + X.TRUNCATION_MARKER
    assert _one(spark, "x" * 500, X.truncate_chars(t, 5))["text"] == "[TRUNCATED]"
    assert _one(spark, None, X.truncate_chars(t, 5))["text"] is None
    assert _one(spark, " a \n b  c ", X.snippet(t, 2)) == "a b" + X.TRUNCATION_MARKER
    assert _one(spark, "use gs.info and GlideRecord on sys_user", X.query_symbols(t)) == ["gs.info", "GlideRecord", "sys_user"]
    assert [_one(spark, q, X.is_code_like(t)) for q in ("gs.log", "how do I do it", "sys_é", "Hello World")] == [True, False, True, False]
    assert _one(spark, "see a.b.com x.return y.z FooBar Date", X.code_symbols(t)) == ["FooBar", "y.z"]
    assert _one(spark, "Hello, Wörld! 9", X.dedupe_key(t)) == "hello wrld 9"
    assert _one(spark, "--A  b/c--", X.slug(t)) == "a-b-c"
    assert _one(spark, "aa bbbb cc.dd bbbb eee", X.content_terms(t, 3)) == ["cc.dd", "bbbb", "eee"]
    assert _one(spark, "body", X.embed_text(F.lit("My title"), F.lit("x/my-other_file.md"), F.lit("A > B"), t)) == "My title other file\nA > B\n\nbody"


def test_lsh_prunes_where_near_vectors_are_close(spark):
    r = np.random.default_rng(4)
    m = np.repeat(r.normal(size=(80, 64)), 40, 0) + 0.6 * r.normal(size=(3200, 64))
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "point_id long, vector array<double>")
    q = p.where("point_id % 100 = 0").withColumnRenamed("point_id", "query_id")
    exact = {(x[0], x[1]) for x in vector.dense_topk(q, p, 10).collect()}
    found = {(x[0], x[1]) for x in vector.lsh_candidates(q, p, 8, 15, 6).collect()}
    assert len(exact & found) >= 0.9 * len(exact) and len(found) < 0.05 * 32 * 3200


def test_postings_are_not_repeated_for_batches_of_questions(spark, monkeypatch):
    r = random.Random(9)
    docs = [(r.randrange(60), " ".join(r.choice("abcdefghij") for _ in range(r.randrange(9)))) for _ in range(80)]
    asked = [(f"q{i}", " ".join(r.choice("abcdefghijk") for _ in range(3))) for i in range(11)]
    d, q = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(asked, "query_id string, text string")
    texts = {}
    for i, t in docs:  # rows of equal id are one document
        texts.setdefault(i, []).extend(t.split())
    mean, n = sum(map(len, texts.values())) / len(texts), len(texts)
    want = []
    for qid, text in asked:
        scores = []
        for i, t in texts.items():
            s = [0.0]
            for w in set(text.split()) & set(t):
                df = sum(w in x for x in texts.values())
                s.append(math.log1p((n - df + 0.5) / (df + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)))
            scores += [(-round(sum(s), 9), i)] * (len(s) > 1)
        want += [(qid, i, k + 1) for k, (_, i) in enumerate(sorted(scores)[:4])]
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 3)
    monkeypatch.setattr(lexical, "MOST_BLOCK", 7)
    monkeypatch.setattr(lexical, "LEAST_BLOCK", 15)
    for most in (lexical.MAX_BROADCAST_TERMS, 0):
        monkeypatch.setattr(lexical, "MAX_BROADCAST_TERMS", most)
        index = lexical.matched_index(q, d)
        assert (index.docs.count(), index.n_docs, index.mean_terms) == (n, n, mean)
        hits = lexical.sparse_topk(q, d, 4, index=index)
        assert "sequence(" not in hits._jdf.queryExecution().toString()
        assert rows(hits, "query_id", "doc_id", "rank") == sorted(want, key=str)
        held = {(w, i) for w in set("abcdefghijk") & {w for _, t in asked for w in t.split()} for i in sorted(i for i, t in texts.items() if w in t)[:2]}
        assert set(rows(lexical.first_docs(index, 2))) == held


def test_single_sections_are_not_shuffled(spark, tmp_path):
    from skarn.plans.retrieval_queries import sections_with_source

    data = [("a", "x.md", "one"), ("b", "y.md", "two"), ("b", "x.md", "zwei"), (None, "z.md", "three"), (None, "y.md", None), ("c", None, "four")]
    spark.createDataFrame(data, "parent_id string, rel_path string, text string").write.parquet(f"{tmp_path}/parents.parquet")
    spark.createDataFrame([("x.md", "wiki"), ("x.md", "official")], "rel_path string, source string").write.parquet(f"{tmp_path}/files.parquet")
    s = sections_with_source(spark, str(tmp_path))
    assert rows(s) == sorted([("a", "x.md", "one", "official"), ("b", "x.md", "zwei", "official"), (None, "y.md", None, None), ("c", None, "four", None)], key=str)
    s = s.select("doc_id", "text")
    assert "Union" in s._jdf.queryExecution().optimizedPlan().toString() and "files.parquet" not in s._jdf.queryExecution().executedPlan().toString()


def test_points_are_not_repeated_for_batches_of_queries(spark, monkeypatch):
    for name, value in (("POINT_BLOCK", 31), ("QUERY_BLOCK", 2), ("QUERY_BATCH", 3), ("LEAST_POINTS", 50)):
        monkeypatch.setattr(vector, name, value, raising=False)
    points = [(i, v) for i, v in _vectors(160)] + [(1000 + i, v) for i, v in _vectors(160)]  # every score twice
    p = spark.createDataFrame(points, "point_id long, vector array<double>")
    q = p.where("point_id % 20 = 0 AND point_id < 1000").withColumnRenamed("point_id", "query_id")
    hits = vector.dense_topk(q, p, 5)
    assert "sequence(" not in hits._jdf.queryExecution().toString()
    got = {}
    for r in sorted(hits.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["point_id"])
    assert got == {i: _brute(points, v, 5) for i, v in points if i % 20 == 0 and i < 1000}


def test_both_orders_of_a_ranking_take_one_shuffle(spark):
    from skarn.operators import evaluate

    hits = spark.createDataFrame(HITS, HIT_SCHEMA)
    ranking = fusion.best_per_parent(hits, "parent").drop("doc_id").withColumnRenamed("parent", "doc_id")
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(ranking) == 1
    expected = spark.createDataFrame([("q", "r"), ("q", "p"), ("q", None), ("z", "x")], "query_id string, doc_id string")
    queries = spark.createDataFrame([("q",), ("z",), ("y",)], "query_id string")
    assert rows(evaluate.first_ranks(queries, ranking, expected)) == [("q", 1), ("y", None), ("z", None)]
