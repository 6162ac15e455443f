"""Compare every query with its SQL: ``python -m harness.check [sf_dir] [query ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from harness.oracle import ORACLE_SQL
from harness.queries import QUERIES

TABLES = ("events", "customer", "supplier")


def spark_rows(spark: SparkSession, name: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    table = QUERIES[name](spark, sf_dir)
    names = sorted(table.columns)
    cells = [tuple(str(row[n]) for n in names) for row in table.collect()]
    return names, sorted(cells)


def oracle_rows(connection: duckdb.DuckDBPyConnection, name: str) -> tuple[list[str], list[tuple]]:
    result = connection.execute(ORACLE_SQL[name])
    columns = [column[0] for column in result.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    cells = [tuple(str(row[i]) for i in order) for row in result.fetchall()]
    return [columns[i] for i in order], sorted(cells)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def main(arguments: list[str]) -> int:
    sf_dir = arguments[0] if arguments else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = []
    for name in arguments[1:] or QUERIES:
        started = time.perf_counter()
        try:
            actual, expected = spark_rows(spark, name, sf_dir), oracle_rows(connection, name)
            same = actual == expected
        except Exception as error:  # report and go on to the next query
            print(f"ERROR {name}: {str(error)[:1500]}")
            failed.append(name)
            continue
        seconds = time.perf_counter() - started
        print(f"{'ok   ' if same else 'DIFF '} {name} rows={len(actual[1])} {seconds:.2f}s")
        if not same:
            failed.append(name)
            print("  columns", actual[0], expected[0], "rows", len(actual[1]), len(expected[1]))
            print("  only spark", [r for r in actual[1] if r not in set(expected[1])][:2])
            print("  only sql  ", [r for r in expected[1] if r not in set(actual[1])][:2])
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
