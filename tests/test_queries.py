"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import TABLES, normal


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, small, duck, name):
    got = normal(queries()[name](spark, small).toPandas())
    want = normal(duck.execute(oracle_sql()[name]).fetch_df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=1e-9)


def test_entry(spark):
    assert entry(spark).count() == 4


def test_every_sql_has_its_query():
    assert set(oracle_sql()) <= set(queries())
