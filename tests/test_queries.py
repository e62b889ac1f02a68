"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from creditledger.plans.catalog import QUERIES
from creditledger.plans.oracle import ORACLES
from creditledger.sources.schemas import DRIVER_TABLES


@pytest.fixture(scope="module")
def duck(small_dir):
    connection = duckdb.connect()
    for name in sorted(os.listdir(small_dir)):
        table = name.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small_dir}/{name}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = sorted(repr(tuple(row[i] for i in places)) for row in result.fetchall())
    got = sorted(repr(tuple(row)) for row in df.select(*columns).collect())
    assert got and got == want


def test_entry_has_rows(spark, small_dir):
    assert driver.entry(spark).count() > 0


def test_schemas_fit_the_tables(spark, small_dir):
    for table, schema in DRIVER_TABLES.items():
        found = spark.read.parquet(f"{small_dir}/{table}.parquet").schema
        assert {f.name: f.dataType for f in schema} == {f.name: f.dataType for f in found}
