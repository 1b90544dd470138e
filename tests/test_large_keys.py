"""Batches of orders whose keys have more than six digits, against the SQL."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
NAMED = ["batch_activities", "batch_from_person", "batch_identifies", "batch_in_container", "batch_mentions", "batch_mentions_person", "batch_owns"]
KEYS = [7, 123_456, 1_000_000, 1_000_001, 10_000_000, 12_345_678, 123_456_780]


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("orders"))
    rows = [(k, k % 61, dt.datetime(1996, 1, 1 + k % 2)) for k in KEYS]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.mark.parametrize("name", NAMED)
def test_batches_of_long_keys(spark, orders, name):
    got = sorted(tuple(r) for r in QUERIES[name](spark, orders).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{orders}/orders.parquet/*.parquet'")
    assert got == sorted(c.execute(SQL[name]).fetchall())
    if name != "batch_identifies":
        assert len(got) == len(KEYS)  # no two orders are one message
