from datetime import datetime, timedelta

import pytest

from skarn.operators.references import dangling_counts, dangling_references, references, target_intervals
from tests.brute import rows

T0 = datetime(2025, 3, 31, 23, 30)
REFS = "chunk_id string, rel_path string, recorded_at timestamp, period string"
FILES = "rel_path string, recorded_at timestamp, ref_time timestamp"


def _run(spark, chunk_rows, file_rows, deleted=(), rows_per_salt=100_000):
    refs = references(spark.createDataFrame(chunk_rows, REFS), "chunks", "rel_path", "files", "chunk_id", "rel_path", "recorded_at")
    gone = spark.createDataFrame([(d,) for d in deleted], "rel_path string")
    targets = target_intervals(spark.createDataFrame(file_rows, FILES), "files", "rel_path", "recorded_at", gone, "rel_path")
    return dangling_references(refs, targets, rows_per_salt=rows_per_salt)


def test_states_and_copies(spark):
    day = timedelta(days=1)
    chunk_rows = [
        ("a", "there.md", T0, None), ("b", "gone.md", T0, None), ("c", "never.md", T0, None), ("d", "late.md", T0, None), ("e", "edge.md", T0, None),
        ("c", "never.md", T0 + day, None),  # a later copy: the earliest time counts
        ("f", None, T0, None), ("g", "", T0, None), ("h", "never.md", None, None), ("i", "late.md", None, None), (None, "never.md", T0, None),
    ]
    file_rows = [("there.md", T0 + day, None), ("there.md", T0 + 9 * day, None), ("late.md", T0 + day + timedelta(microseconds=1), None), ("edge.md", T0 + day, None), (None, T0, None)]
    got = rows(_run(spark, chunk_rows, file_rows, deleted=["gone.md", "there.md"]), "record_key", "ref_key", "period", "state")
    assert got == sorted([("b", "gone.md", "2025-03", "deleted"), ("c", "never.md", "2025-03", "missing"), ("d", "late.md", "2025-03", "late"), ("h", "never.md", None, "missing"), (None, "never.md", "2025-03", "missing")], key=str)


def test_one_hot_key_is_salted(spark):
    chunk_rows = [(f"c{i}", "hot.md" if i % 3 else f"f{i}.md", T0, None) for i in range(3000)]
    out = _run(spark, chunk_rows, [("hot.md", T0 + timedelta(days=3), None)], rows_per_salt=100)
    assert out.count() == 3000
    assert dict((r["state"], r["n_refs"]) for r in dangling_counts(out).collect()) == {"late": 2000, "missing": 1000}


def test_arrays_and_empty_tables(spark):
    golden = spark.createDataFrame([("q", ["a", "a", "", None, "b"], T0), ("r", None, T0), ("s", [], T0)], "id string, paths array<string>, added_at timestamp")
    refs = references(golden, "golden", "paths", "files", "id", "paths", "added_at")
    assert rows(refs, "record_key", "ref_key") == [("q", "a"), ("q", "b")]
    assert _run(spark, [], []).count() == 0
    assert _run(spark, [("a", "x", T0, None)], []).count() == 1


@pytest.mark.parametrize("n", [1, 50])
def test_against_brute_force(spark, n):
    import random

    r = random.Random(n)
    chunk_rows = [(f"c{r.randrange(40)}", r.choice([None, "", *(f"f{i}" for i in range(12))]), T0 + timedelta(hours=r.randrange(200)), None) for _ in range(40 * n)]
    file_rows = [(f"f{r.randrange(10)}", T0 + timedelta(hours=r.randrange(300)), None) for _ in range(8 * n)]
    first, seen = {}, {}
    for k, v, t, _ in chunk_rows:
        first[k] = min(first.get(k, t), t)
    for f, t, _ in file_rows:
        seen[f] = min(seen.get(f, t), t)
    want = {(k, v) for k, v, _, _ in chunk_rows if v and (v not in seen or seen[v] > first[k] + timedelta(hours=24))}
    assert {(x[0], x[1]) for x in rows(_run(spark, chunk_rows, file_rows), "record_key", "ref_key")} == want
