"""Every registered query against its SQL in DuckDB, on the test tables."""

import os
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
         "DATE": "date", "TIMESTAMP": "timestamp_ntz"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


def normal(value):
    return float(value) if isinstance(value, Decimal) else value


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, rows, name):
    found = queries()[name](spark, SF_DIR)
    result = duck.sql(oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(result.columns)
    types = {column: TYPES[str(kind)] for column, kind in zip(result.columns, result.types)}
    assert dict(found.dtypes) == types
    expected = duck.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()
    key = lambda row: [(value is not None, value) for value in row]
    assert rows(found.select(*columns)) == sorted((tuple(map(normal, row)) for row in expected), key=key)
