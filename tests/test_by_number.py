"""Queries that rank by number, on odd tables, against their SQL in DuckDB."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from skarn.operators import fusion, lexical, ranked
from skarn.plans.pipeline_queries import _indexed
from tests.brute import rows

WORDS = ["alpha", "beta", "gs.log", "gamma", "delta", "sys_user", "omega", "the"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Files that are null or unlisted, sections of equal id and of equal text, questions without terms, empty and missing expectations."""
    d, c, r = tmp_path_factory.mktemp("odd"), duckdb.connect(), random.Random(4)
    paths = [None, "", *(f"f{i}.md" for i in range(7))]
    text = lambda: "x " + " ".join(r.choices(WORDS, k=r.randrange(1, 90)))
    parents = [(f"{i:040x}", r.choice(paths), r.choice([None, "", text(), text(), text()])) for i in range(60)]
    parents += [(f"{100 + i % 9:040x}", r.choice(paths[2:]), text()) for i in range(20)]
    golden = [(f"g{i}", r.choice([None, "?!", *[" ".join(r.choices(WORDS, k=4))] * 6]), r.choice([None, "general"]), r.choice(["real", None]), r.choice([None, [], r.choices(paths, k=2)] + [r.choices(paths[2:], k=3)] * 3), r.choice([None, False, True])) for i in range(50)]
    files = [(p, r.choice(["official", "wiki"])) for p in paths[1:-1]]
    for name, kinds, data in (
        ("parents", "parent_id VARCHAR, rel_path VARCHAR, text VARCHAR", parents),
        ("golden", "id VARCHAR, question VARCHAR, profile VARCHAR, provenance VARCHAR, expected_rel_paths VARCHAR[], expect_no_answer BOOLEAN", golden),
        ("files", "rel_path VARCHAR, source VARCHAR", files),
    ):
        c.sql(f"CREATE TABLE {name} ({kinds})")
        c.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(data[0]))})", data)
        c.sql(f"COPY {name} TO '{d}/{name}.parquet'")
    return str(d), c


def _agrees(spark, odd, name):
    d, c = odd
    df = e.queries()[name](spark, d)
    columns = sorted(df.columns)
    plain = lambda x: tuple(f"{v:.6g}" if isinstance(v, float) else str(v) if isinstance(v, (int, bool)) else v for v in x)
    got = sorted((plain(x) for x in df.select(*columns).collect()), key=str)
    want = sorted((plain(x) for x in c.sql(e.oracle_sql()[name]).select(*(f'"{x}"' for x in columns)).fetchall()), key=str)
    assert got == want and got, [x for x in got if x not in want] + [x for x in want if x not in got]
    return df


@pytest.mark.parametrize("name", ["first_rank", "recall_mrr", "gate", "arm_deltas", "arm_disagreement"])
def test_first_ranks(spark, odd, name):
    # what is ranked has numbers: no order is by the name of a question or file
    plan = _agrees(spark, odd, name)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [row_number" in plan and "rel_path" not in "".join(x for x in plan.split("\n") if "Window [" in x)


@pytest.mark.parametrize("name", ["stage_loss", "loss_counts"])
def test_losses(spark, odd, name):
    # the share of terms comes from the index: no texts are compared
    assert "array_intersect" not in _agrees(spark, odd, name)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["evidence_pool", "judged_brief"])
def test_pools(spark, odd, name):
    # pooled by number: sections get their ids after the pool's order, once for both arms
    plan = _agrees(spark, odd, name)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Project \[(?:n#\d+L, doc_id#\d+|doc_id#\d+, n#\d+L)\]", plan)) == 1


@pytest.mark.parametrize("name", ["capped_answers", "answer_citations", "search_personal"])
def test_answers(spark, odd, name):
    _agrees(spark, odd, name)


def test_matched_terms_are_those_of_the_text(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "A a"), (3, None), (4, "b"), (5, "d")], "doc_id int, text string")
    q = spark.createDataFrame([("x", "a b b z"), ("y", "c a"), ("n", "?")], "query_id string, text string")
    hits = lexical.sparse_topk(q, docs, 3, matched=True)
    assert rows(hits.select("query_id", "doc_id", "matched")) == [("x", 1, 2), ("x", 2, 1), ("x", 4, 1), ("y", 1, 2), ("y", 2, 1)]
    assert rows(fusion.overlap_rerank(hits, q, None, 2)) == rows(fusion.overlap_rerank(hits.drop("matched"), q, docs, 2).select("query_id", "doc_id", "score", "rank"))


def test_texts_that_are_not_hit_are_not_shuffled(spark, odd):
    s = _indexed(spark, odd[0]).where(F.col("doc_id").isNotNull())
    some = s.select("doc_id").orderBy("doc_id").limit(5)
    left = ranked.thinned(s, some, "doc_id")
    assert {x[0] for x in some.collect()} <= {x["doc_id"] for x in left.collect()} and left.count() < s.count()
    assert ranked.thinned(s, some.limit(0), "doc_id").count() == 0
