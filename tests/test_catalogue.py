"""Every catalogue query against its SQL twin on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return connection


def test_every_query_has_an_oracle():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sql, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    oracle = entry.oracle_sql().get(name)
    if oracle is not None:
        want = sql.execute(oracle).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
