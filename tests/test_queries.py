"""Each registered query against its SQL, over the smallest given tables."""

import datetime as dt
import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for file in TABLES.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 9)
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(row[i]) for i in order] for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, database, name):
    frame = entry.queries()[name](spark, str(TABLES))
    rows = frame.collect()
    if name not in entry.oracle_sql():
        assert rows
        return
    result = database.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert table(frame.columns, rows) == table(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
