import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.llm import packing
from skarn.llm.mixing import largest_exact_total, mixed, water_fill
from skarn.llm.packing import InvertedIndex, fill, packed
from skarn.llm.tokens import TOKENIZER_PATH, counted, encoder
from tests.brute import rows

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER_PATH), reason="no tokenizer here")
DOCS = "doc_id long, source string, text string, n_tokens int"


def _docs(spark, n=400, seed=1):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    data = [(i, r.choice(["a", "b", None]), " ".join(r.choice(words) for _ in range(int(r.expovariate(1 / 60)) + 1)), 0) for i in range(n)]
    data += [(n, "a", None, 0), (n + 1, "a", "", 0), (n + 2, "b", "long text " * 3000, 0), (n + 3, None, "same", 0), (n + 4, None, "same", 0)]
    return data, spark.createDataFrame(data, DOCS)


def test_counts(spark):
    data, docs = _docs(spark)
    e = encoder()
    assert rows(counted(docs, ["doc_id"], "text")) == sorted(((d[0], len(e.encode_ordinary(d[2] or ""))) for d in data), key=str)


@pytest.mark.parametrize("block", [7, 64, 512])
def test_packing(spark, monkeypatch, block):
    monkeypatch.setattr(packing, "SHARD_DOCS", block)
    data, docs = _docs(spark)
    n = {d[0]: len(encoder().encode_ordinary(d[2] or "")) for d in data}
    limits = {"s": 100, "m": 777}
    out = packed(docs.coalesce(2), list(limits.items())).toPandas()
    for name, capacity in limits.items():
        g = out[out.pack_name == name]
        assert g.groupby("doc_id").n_tokens.sum().to_dict() == n
        assert set(g[g.container_id.isna()].doc_id) == {k for k, v in n.items() if v == 0}
        boxes = g[g.container_id.notna()].groupby("container_id").n_tokens.sum()
        assert boxes.max() <= capacity
        assert set(g[g.duplicated("doc_id")].doc_id) == {k for k, v in n.items() if v > capacity}
        assert not g[g.container_id.notna()].duplicated(["container_id", "slot"]).any()
        parts = docs.rdd.getNumPartitions()
        assert len(boxes) <= math.ceil(sum(n.values()) / capacity) * 1.1 + 8 + parts
    assert packed(docs.limit(0), [("s", 10)]).count() == 0
    with pytest.raises(ValueError):
        packed(docs, [("s", 0)])


def test_index_and_fill_against_loops():
    r = np.random.default_rng(2)
    terms = [np.unique(r.integers(0, 60, 9)) for _ in range(16)]
    counts = [r.integers(1, 5, len(t)) for t in terms]
    sizes = np.array([c.sum() for c in counts], np.float64)
    index = InvertedIndex(terms, counts)
    df = {t: sum(t in x for x in terms) for x in terms for t in x}
    assert max(df.values()) > 4 and min(df.values()) == 1
    for i in range(16):
        for j in range(16):
            s = 0.0
            for t, c in zip(terms[j], counts[j]):
                if t in terms[i] and 1 < df[t] <= 4:
                    s += math.log1p((16 - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * sizes[j] / sizes.mean()))
            assert index.scores(i)[j] == pytest.approx(s)
    boxes = fill(sizes.astype(int), np.arange(16), index, 80)
    assert sorted(sum(boxes, [])) == list(range(16)) and all(sizes[b].sum() <= 80 for b in boxes)

    class Alike:
        def scores(self, doc):
            return np.array([1.0, 0, 0, 9]) if doc == 0 else np.zeros(4)

    assert fill(np.array([50, 10, 10, 10]), np.arange(4), Alike(), 60)[0] == [0, 3]  # the related neighbour is taken
    assert InvertedIndex([], []).n == 0


def test_containers_do_not_depend_on_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 50)
    _, docs = _docs(spark, 600)
    limits = [("s", 100), ("m", 900)]
    once = rows(packed(docs.repartition(7), limits))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows(packed(docs.coalesce(1), limits)) == once
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repeated_and_null_ids_keep_the_capacity(spark):
    data = [(1, "a", "word " * 60, 0), (1, "a", "other " * 60, 0), (None, "a", "third " * 58, 0), (None, "b", "fourth " * 58, 0), (2, "a", "x", 0), (2, "a", "x", 0)]
    out = packed(spark.createDataFrame(data, DOCS), [("s", 70)]).toPandas()
    assert len(out) >= 6 and out.groupby("container_id").n_tokens.sum().max() <= 70
    assert out.n_tokens.sum() == sum(len(encoder().encode_ordinary(d[2])) for d in data)


def test_water_filling():
    assert water_fill({"a": 0.5, "b": 0.5}, {"a": 100, "b": 100}, 100) == {"a": 50, "b": 50}
    assert water_fill({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 1000, "c": 1000}, 100) == {"a": 10, "b": pytest.approx(54), "c": pytest.approx(36)}
    assert water_fill({"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, 100) == {"a": 1, "b": 2}
    assert water_fill({"a": 0.0, "b": 1.0}, {"a": 1, "b": 2}, 1) == {"a": 0.0, "b": 1.0}
    assert water_fill({}, {}, 5) == {}
    assert largest_exact_total({"a": 0.5, "b": 0.5}, {"a": 10, "b": 100}) == 20
    assert largest_exact_total({"a": 1.0}, {"a": 0}) == 0


def _mix(spark, total=None):
    r = random.Random(3)
    data = [(i, r.choice("aaaab"), "word " * r.randrange(1, 60), 0) for i in range(3000)] + [(9000, "c", "word " * 30, 0), (9001, None, "x", 0), (9002, "zzz", "x", 0), (9003, "b", None, 0)]
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.5, 3), ("c", 0.1, 2), ("d", 0.1, 4)], "source string, target_share double, max_repeats int")
    return mixed(spark.createDataFrame(data, DOCS), targets, total)


def test_mix_meets_targets(spark):
    uses, shares = _mix(spark)
    got = {x["source"]: x for x in shares.collect()}
    assert got["c"]["epochs"] == 2.0 and got["d"]["used_tokens"] == 0
    assert uses.where(~F.col("source").isin("a", "b", "c")).count() == 0
    assert sum(x["actual_share"] for x in got.values()) == pytest.approx(1)


def test_clamped_mix(spark):
    uses, shares = _mix(spark, 400_000)
    got = {x["source"]: x for x in shares.collect()}
    assert got["a"]["epochs"] == 1.0 and got["b"]["epochs"] == 3.0
    again, _ = _mix(spark, 60_000)
    shares = {x["source"]: x for x in _mix(spark, 60_000)[1].collect()}
    # c is clamped at two uses and d has nothing: a and b share the rest 3 to 5
    assert shares["a"]["used_tokens"] / shares["b"]["used_tokens"] == pytest.approx(0.6, rel=0.02)
    limit = {"a": 1, "b": 3, "c": 2}
    assert all(r["uses"] <= limit[r["source"]] for r in uses.collect())
    assert rows(again) == rows(_mix(spark, 60_000)[0])  # repeatable


def test_the_fraction_is_exact_to_a_record(spark):
    data = [(i, "a", "word " * (1 + i % 40), 0) for i in range(2000)]
    docs = spark.createDataFrame(data, DOCS)
    have = sum(len(encoder().encode_ordinary(d[2])) for d in data)
    targets = spark.createDataFrame([("a", 1.0, 5)], "source string, target_share double, max_repeats int")
    for wanted in (1, have // 3, have - 1, have + 17, 4.5 * have):
        used = mixed(docs, targets, wanted)[1].first()["used_tokens"]
        assert abs(used - wanted) <= 45


def test_empty_mix(spark):
    empty = spark.createDataFrame([], DOCS)
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    uses, shares = mixed(empty, targets)
    assert uses.count() == 0 and shares.first()["actual_share"] == 0.0
    assert mixed(empty, targets.limit(0))[1].count() == 0
