"""Every registered query against its SQL on the smallest tables."""

import subprocess
import sys

import duckdb
import pytest
from oracle_check import connect, difference

import __spark_entry__ as entry
from conftest import ROOT, SF
from dockpulse.plans import catalog, oracle

QUERIES, SQL = catalog.QUERIES, oracle.sql_by_query()


@pytest.fixture(scope="module")
def con() -> duckdb.DuckDBPyConnection:
    return connect(SF)


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    actual = QUERIES[name](spark, SF).toPandas()
    problem = difference(actual, con.execute(SQL[name]).df())
    assert problem is None, problem


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == [
        "delivery",
        "created_by",
        "scanned_count",
        "number_of_packages",
        "progress_percentage",
    ]
    assert df.count() == 615


def test_entry_without_the_training_data_operators():
    """They may be left out as a whole; the other queries stay."""
    code = (
        "import sys; sys.modules['dockpulse.llm'] = None; import __spark_entry__ as e; "
        "assert 'progress' in e.queries() and not any(n.startswith('op') for n in e.queries()); "
        "assert e.queries().keys() == e.oracle_sql().keys()"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_registered_queries():
    assert catalog.QUERIES.keys() <= entry.queries().keys()
