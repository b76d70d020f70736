"""Every registered query against its SQL statement on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    verdict, _ = compare(spark, con, name, entry.queries()[name], SQL.get(name), FOLDER)
    assert verdict.startswith(("ok", "rows-only")), verdict


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
