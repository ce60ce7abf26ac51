"""Every registered query against SQL run by a second engine on the same tables."""

import datetime
import decimal

import duckdb
import pytest

from ticketlake.plans.oracle import ORACLE
from ticketlake.plans.registry import QUERIES
from ticketlake.plans.views import TABLES


@pytest.fixture(scope="session")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 9) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_plain(row[i]) for i in order]) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, sf_dir, name):
    result = QUERIES[name](spark, sf_dir)
    expected = duck.sql(ORACLE[name])
    assert sorted(result.columns) == sorted(expected.columns)
    got = _rows(result.columns, [tuple(row) for row in result.collect()])
    assert got == _rows(expected.columns, expected.fetchall())
