"""Every registered query with SQL, compared with DuckDB on the smallest tables."""

from glob import glob
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from check_queries import table_of

ORACLES = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def db(small_folder):
    connection = duckdb.connect()
    for path in glob(f"{small_folder}/*.parquet"):
        connection.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, small_folder, name):
    df = entry_point.queries()[name](spark, small_folder)
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert table_of([tuple(r) for r in df.collect()], df.columns) == table_of(cursor.fetchall(), names)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
