"""Every registered query against its SQL equal."""

import os

import pytest

import __spark_entry__ as entry
from tests import oracle

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_are_query_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


# The optional training-data queries have tests of their own.
@pytest.mark.parametrize("name", sorted(entry.catalog.QUERIES))
def test_query(spark, con, name):
    got = oracle.compare(spark, SF, name, entry.queries()[name], entry.oracle_sql()[name], con)
    assert got["ok"], got["why"]
