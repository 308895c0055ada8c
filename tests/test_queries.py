from __future__ import annotations

import pytest

import __spark_entry__
import compare
from workload import oracle
from workload.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SQL = oracle.build()


@pytest.fixture(scope="module")
def connection():
    return compare.connect(FOLDER)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_point_registers_them():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, connection, name):
    assert compare.difference(QUERIES[name](spark, FOLDER), connection, SQL[name]) is None


def test_comparison_notices_differences(spark, connection):
    right = "SELECT n_nationkey, n_name FROM nation"
    frame = spark.read.parquet(f"{FOLDER}/nation.parquet").select("n_nationkey", "n_name")
    assert compare.difference(frame, connection, right) is None
    for wrong in (
        right + " WHERE n_nationkey > 0",
        "SELECT n_nationkey, n_name || 'x' AS n_name FROM nation",
        "SELECT n_nationkey AS k, n_name FROM nation",
        "SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name FROM nation",
    ):
        assert compare.difference(frame, connection, wrong) is not None


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 7
