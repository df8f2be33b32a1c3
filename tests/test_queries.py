"""Every core query with SQL, against DuckDB on the smallest data."""

import glob
import math
import os

import duckdb
import pytest

from skarn.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v.isoformat() if hasattr(v, "isoformat") else str(v) if isinstance(v, (int, bool)) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(map(_plain, r)) for r in df.select(*columns).collect()), key=str)
    if name not in catalogue.oracle_sql():
        assert df.columns
        return
    rel = con.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(map(_plain, r)) for r in rel.select(*(f'"{c}"' for c in columns)).fetchall()), key=str)
    assert got == want


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_flagship(spark):
    assert catalogue.flagship(spark, DATA).count() > 0
