"""Every registered query against its SQL, run by DuckDB on the same tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from linewright.registry import ORACLE_SQL, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

EXPECTED_ROWS = {
    "count_matching_lines": 1000,
    "having_marker": 39,
    "neutralise_lines": 1000,
    "latest_per_key": 150,
    "stem_counts": 210,
    "missing_inputs": 601,
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        path = f"{SF_DIR}/{table}.parquet"
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(row[i] for i in order) for row in rows),
        key=lambda row: [(value is not None, str(value)) for value in row],
    )


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLE_SQL.keys()
    assert QUERIES.keys() <= queries().keys() and ORACLE_SQL.keys() <= oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_oracle(spark, duck, name):
    result = queries()[name](spark, SF_DIR)
    cursor = duck.execute(oracle_sql()[name])
    columns = [column[0] for column in cursor.description]
    assert sorted(result.columns) == sorted(columns)
    found = _rows(result.columns, result.collect())
    assert found == _rows(columns, cursor.fetchall())
    if SF_DIR.endswith("/sf0.01") and name in EXPECTED_ROWS:
        assert len(found) == EXPECTED_ROWS[name]


def test_entry(spark):
    assert entry(spark).count() == 200
