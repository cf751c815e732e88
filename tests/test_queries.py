"""Every registered query against its SQL on the smallest data folder."""

import os

import pytest

import __spark_entry__ as entry_point
import check_queries
from procurisk.plans.queries import registry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def connection():
    return check_queries.duckdb_connection(SF_DIR)


@pytest.mark.parametrize("name", list(registry()))
def test_query(spark, connection, name):
    outcome, _ = check_queries.compare(spark, connection, SF_DIR, name)
    assert outcome.startswith("same"), outcome


def test_every_sql_has_a_query():
    assert set(registry()) <= set(entry_point.oracle_sql())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
