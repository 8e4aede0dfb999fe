"""Every registered query against its SQL on the smallest tables; those without SQL must give rows."""

import __spark_entry__ as registered
import pytest

from assayer.plans import registry
from assayer.plans.check import compare, crossing, duckdb_tables

FOLDER = "/root/testdata/sf0.001"
QUERIES = registry()


@pytest.fixture(scope="module")
def con():
    return duckdb_tables(FOLDER)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_same_as_sql(spark, con, name):
    query, sql = QUERIES[name]
    assert compare(spark, con, FOLDER, query, sql) is None


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_gives_rows(spark, name):
    df = QUERIES[name][0](spark, FOLDER)
    assert crossing(df) is None and df.count() > 0


def test_entry(spark):
    assert registered.entry(spark).count() == 63
    assert set(registered.oracle_sql()) <= set(registered.queries())
