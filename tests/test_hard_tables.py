"""Every core query on empty tables, and on tables with nulls, repeated rows and clashing extra columns."""

import os

import pytest

from skarn.plans import catalogue
from tests.brute import hard_tables

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module", params=["empty", "dirty"])
def folder(request, tmp_path_factory):
    return hard_tables(DATA, str(tmp_path_factory.mktemp(request.param)), request.param == "empty"), request.param


def test_all_queries(spark, folder):
    path, kind = folder
    counts = {name: query(spark, path).count() for name, query in catalogue.queries().items()}
    aggregates = {"drift", "run_summary", "walk_check"}  # one overall row, whatever the input
    if kind == "empty":
        assert {n for n, c in counts.items() if c} <= aggregates
    else:
        assert sum(1 for c in counts.values() if c) > 0.8 * len(counts)
