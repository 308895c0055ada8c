"""Runs queries and their SQL equivalents and compares them value by value.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()
# DuckDB's names for Spark's types.
KINDS = {"integer": "int", "varchar": "string"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda at: names[at])
    return Counter(tuple(row[at] for at in order) for row in rows)


def difference(df, connection, sql: str) -> str | None:
    """None if names, kinds and all values agree, else what differs."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    kinds = {column[0]: KINDS.get(str(column[1]).lower(), str(column[1]).lower()) for column in result.description}
    expected = _rows(names, result.fetchall())
    got_kinds = dict(df.dtypes)
    got = _rows(df.columns, [tuple(row) for row in df.collect()])
    if got_kinds != kinds:
        return f"columns {got_kinds} instead of {kinds}"
    if got != expected:
        return (
            f"{sum(got.values())} rows instead of {sum(expected.values())};"
            f" extra {list((got - expected).items())[:2]}, missing {list((expected - got).items())[:2]}"
        )
    if not got or any(isinstance(v, float) and math.isnan(v) for row in got for v in row):
        return "no rows, or not a number"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, queries, sql = connect(folder), __spark_entry__.queries(), __spark_entry__.oracle_sql()
    print("without SQL:", sorted(set(queries) - set(sql)))
    failed = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            if name in sql:
                problem = difference(queries[name](spark, folder), connection, sql[name])
            else:
                problem = None if queries[name](spark, folder).count() else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {problem or 'equal'}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
