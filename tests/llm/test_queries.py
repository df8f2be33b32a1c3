"""Every query of the package: against SQL where there is some, and on empty and dirty tables."""

import glob
import os

import duckdb
import pytest

from skarn.llm import catalogue
from tests.brute import hard_tables, rows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = catalogue.queries()[name](spark, DATA)
    want = con.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df) == sorted(want.select(*df.columns).fetchall(), key=str)


@pytest.mark.parametrize("kind", ["empty", "dirty"])
def test_hard_tables(spark, tmp_path, kind):
    path = hard_tables(DATA, str(tmp_path), kind == "empty")
    counts = {name: query(spark, path).count() for name, query in catalogue.queries().items()}
    if kind == "empty":
        assert {n for n, c in counts.items() if c} == {"p6_shares", "p6_exact_shares"}  # a row for each target, with nothing used
    else:
        assert all(counts.values()), counts
