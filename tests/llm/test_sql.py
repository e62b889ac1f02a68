"""Every operator's query that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from creditledger.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(small_dir):
    connection = duckdb.connect()
    for name in sorted(os.listdir(small_dir)):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{small_dir}/{name}'")
    return connection


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())
    assert set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = sorted(repr(tuple(row[i] for i in places)) for row in result.fetchall())
    assert sorted(repr(tuple(row)) for row in df.select(*columns).collect()) == want


def test_native_query_has_no_python(spark, small_dir):
    plan = QUERIES["op7_exact_dedup"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Arrow", "Pandas"):
        assert node not in plan
