"""What queries over long texts put on disk: numbers of what is ranked, not the texts."""

import random

import duckdb
import pytest

import __spark_entry__ as e


@pytest.fixture(scope="module")
def long_texts(tmp_path_factory):
    """(folder, bytes of text): few questions, of which none looks like code, over long sections whose tails don't compress; an excerpt ends before the tail."""
    d, c, r = tmp_path_factory.mktemp("long"), duckdb.connect(), random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    parents = [(f"{i:040x}", f"f{i % 40}.md", " ".join(r.choices(words, k=60) + [f"{r.getrandbits(128):032x}" for _ in range(450)])) for i in range(200)]
    golden = [(f"g{i}", " ".join(r.choices(words, k=4)), "general", "real", [f"f{i}.md"], False) for i in range(25)]
    for name, kinds, data in (
        ("parents", "parent_id VARCHAR, rel_path VARCHAR, text VARCHAR", parents),
        ("golden", "id VARCHAR, question VARCHAR, profile VARCHAR, provenance VARCHAR, expected_rel_paths VARCHAR[], expect_no_answer BOOLEAN", golden),
        ("files", "rel_path VARCHAR, source VARCHAR", [(f"f{i}.md", "wiki") for i in range(40)]),
    ):
        c.sql(f"CREATE TABLE {name} ({kinds})")
        c.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(data[0]))})", data)
        c.sql(f"COPY {name} TO '{d}/{name}.parquet'")
    return str(d), sum(len(x[2]) for x in parents)


def _shuffled(spark) -> dict[int, int]:
    """Bytes of shuffle files that each stage has written, by its number. The session keeps the last 1,000 stages only."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s := stages.apply(i)).stageId(): s.shuffleWriteBytes() for i in range(stages.size())}


@pytest.mark.parametrize("name", ["answer_citations", "judged_brief", "recall_mrr", "arm_disagreement", "gate", "stage_loss"])
def test_texts_are_not_shuffled(spark, long_texts, name):
    d, size = long_texts
    last = max(_shuffled(spark), default=-1)
    e.queries()[name](spark, d).collect()
    assert 0 < sum(v for k, v in _shuffled(spark).items() if k > last) < size / 10
