"""Every registered query against its SQL at the smallest scale."""

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from check_oracle import compare, oracle
from oracle_queries import ORACLE


@pytest.fixture(scope="module")
def connection():
    with oracle(SF) as connection:
        yield connection


def test_every_query_has_its_sql():
    assert set(entry._QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(entry._QUERIES))
def test_query(spark, connection: duckdb.DuckDBPyConnection, name):
    assert compare(spark, connection, name, SF) == ""


def test_entry(spark):
    top = entry.entry(spark)
    assert top.columns == ["name", "message_count"] and top.count() == 10
