import os
import time

import pytest
from pyspark.sql import functions as F

from skarn.operators import sampling
from skarn.operators import search as S
from skarn.sources import ingest as I
from skarn.sources.readers import Snapshots
from tests.brute import rows

SECTIONS = "doc_id string, rel_path string, text string, source string, doc_type string, facets map<string,array<string>>, api_symbols array<string>"


@pytest.fixture(scope="module")
def sections(spark):
    data = [
        ("s1", "o/a.md", "how to call gs.info in a script", "official", "api", {"release": ["r1"], "tags": ["x", "y"]}, ["gs.info"]),
        ("s2", "o/b.md", "how to write a script", "official", "note", {"release": ["r2"]}, []),
        ("s3", "w/c.md", "a note on gs.info and a call", "wiki", "note", None, None),
        ("s4", "w/d.md", "nothing of use", None, "API", {}, []),
        ("s5", "w/e.md", None, "wiki", None, {}, []),
    ]
    return spark.createDataFrame(data, SECTIONS)


def test_filters(sections):
    ids = lambda c: rows(sections.where(c), "doc_id")
    assert S.build_filter() is None
    assert ids(S.build_filter(sources=("official",))) == [("s1",), ("s2",)]
    assert ids(S.build_filter(doc_types=("Api",))) == [("s1",), ("s4",)]
    assert ids(S.build_filter(facets={"tags": ["y", "z"], "release": "r1"})) == [("s1",)]
    assert ids(S.build_filter(symbols=("gs.info",))) == [("s1",)]
    with pytest.raises(ValueError, match="release"):
        S.allowed_facets(S.PROFILES["general"], {"release": "r1"})


@pytest.mark.parametrize("mode", S.MODES)
def test_search(spark, sections, mode):
    q = spark.createDataFrame([("q1", "how do I call gs.info"), ("q2", "zzz")], "query_id string, text string")
    got = S.Search(S.PROFILES["general"], mode, candidates=5).run(q, sections, 3)
    first = {r["rank"]: r for r in got.where("query_id = 'q1'").collect()}
    assert sorted(first) == list(range(1, len(first) + 1)) and first[1]["doc_id"] in ("s1", "s3") and first[1]["used_lexical"]
    official = S.Search(S.PROFILES["servicenow"], mode, candidates=5).run(q, sections)
    assert {r[0] for r in rows(official, "doc_id")} <= {"s1", "s2"}
    assert S.Search(S.PROFILES["general"], mode).run(q.limit(0), sections).count() == 0
    assert S.Search(S.PROFILES["general"], mode).run(q, sections.limit(0)).count() == 0


def test_unknown_mode(spark, sections):
    with pytest.raises(ValueError):
        S.Search(S.PROFILES["general"], "fuzzy").run(spark.createDataFrame([("q", "x")], "query_id string, text string"), sections)


def test_capped_answer_keeps_the_first(spark, sections):
    hits = spark.createDataFrame([("q", 1, "s1"), ("q", 2, "s2"), ("q", 3, "s3")], "query_id string, rank int, doc_id string")
    assert rows(S.capped_answer(hits, sections, max_chars=1), "rank") == [(1,)]
    assert rows(S.capped_answer(hits, sections, max_chars=150), "rank") == [(1,), (2,)]


def test_samples(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(100)] + [(None, "a")], "k int, g string")
    assert rows(sampling.seeded_sample(df, "k", 10)) == rows(sampling.seeded_sample(df.repartition(7), "k", 10))
    assert sampling.seeded_sample(df, "k", 10, seed=1).exceptAll(sampling.seeded_sample(df, "k", 10)).count() > 0
    needed = spark.createDataFrame([(5,), (5,), (77,), (1000,)], "k int")
    got = sampling.needed_first(df, "k", needed, 10)
    assert got.count() == 10 and rows(got.where("is_needed"), "k") == [(5,), (77,)]
    assert rows(sampling.per_group_sample(df, "g", "k", 3).groupBy("g").count()) == [("a", 3), ("b", 3)]
    lengths = [r[0] for r in sampling.length_batches(df.coalesce(1).withColumn("t", F.repeat(F.lit("x"), F.col("k") % 7)), "t").select(F.length("t")).collect()]
    assert [x for x in lengths if x is not None] == sorted(x for x in lengths if x is not None)


def test_ingest(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    r = I.ingest(spark, store, content="# A\n\nsome text", filename="wiki/n.md")
    assert (r.rel_path, r.n_chunks, r.replaced) == ("wiki/n.md", 1, False)
    with pytest.raises(ValueError, match="taken"):
        I.ingest(spark, store, content="other", filename="wiki/n.md")
    assert I.ingest(spark, store, overwrite=True, content="other", filename="wiki/n.md").replaced
    assert rows(store.read(), "text") == [("other",)]
    with pytest.raises(ValueError, match="official"):
        I.ingest(spark, store, content="x", filename="ServiceNowOfficialDocs/x.md")
    with pytest.raises(ValueError, match="at most"):
        I.ingest(spark, store, content="# h\n\n" + "Some sentence here. " * 20_000, filename="wiki/l.md")


def test_nightly(tmp_path):
    stamp, lock, done = str(tmp_path / "stamp"), str(tmp_path / "lock"), []
    with pytest.raises(RuntimeError):
        I.nightly(stamp, lock, lambda: (_ for _ in ()).throw(RuntimeError("no")))
    assert not os.path.exists(stamp)
    assert I.nightly(stamp, lock, lambda: done.append(1)) and not I.nightly(stamp, lock, lambda: done.append(2))
    os.utime(stamp, (time.time() - 21 * 3600,) * 2)
    with I.exclusive(lock), pytest.raises(RuntimeError, match="held"):
        I.nightly(stamp, lock, lambda: done.append(3))
    assert done == [1]


def test_synthesized(spark):
    df = spark.createDataFrame([("a/my-note_x.md", "body"), ("b.md", "---\ntitle: t\n---\nx"), ("c.md", None)], "rel_path string, text string")
    assert [r["text"] for r in I.synthesized(df).collect()] == ['---\ntitle: "my note x"\n---\nbody', "---\ntitle: t\n---\nx", '---\ntitle: "c"\n---\n']
