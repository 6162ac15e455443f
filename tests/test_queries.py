"""Every registered query against its SQL, on the smallest driver tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from harness.check import connect, oracle_rows, spark_rows
from harness.oracle import ORACLE_SQL
from harness.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(queries()) and set(ORACLE_SQL) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    assert spark_rows(spark, name, SF_DIR) == oracle_rows(connection, name)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize(
    "name", ["clean_login", "scan_denial_audit", "user_summary", "adu_monthly_denials", "login_gaps"]
)
def test_results_do_not_depend_on_the_session_zone(spark, connection, name):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert spark_rows(spark, name, SF_DIR) == oracle_rows(connection, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
