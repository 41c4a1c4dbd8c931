"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from sluicebox.showcase.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert name in entry.oracle_sql()
    assert compare(spark, FOLDER, entry.queries()[name], entry.oracle_sql()[name], con) == []


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "failure_rate_percent" in df.columns
