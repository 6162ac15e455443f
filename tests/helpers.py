from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from seatscope.params import Exclusions, Params

PLAIN = Params(exclusions=Exclusions())


def audit(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A login audit from (user, event time) pairs."""
    return spark.createDataFrame(rows, "`User Name` string, `Event Time` string")


def denial_audit(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(
        rows, "`Event Label` string, `Event Time` string, `User Name` string"
    )


def daily(spark: SparkSession, rows: list[tuple[str, str, int]]) -> DataFrame:
    """Per-day activity from (user, ISO date, events)."""
    typed = [(user, date.fromisoformat(day), events) for user, day, events in rows]
    return spark.createDataFrame(typed, "user string, activity_date date, event_count long")


def dicts(table: DataFrame) -> list[dict]:
    return [row.asDict() for row in table.collect()]


def values(table: DataFrame) -> dict:
    """A metric table as a dict."""
    return {row["metric"]: row["value"] for row in table.collect()}


def executed_plan(table: DataFrame) -> str:
    return table._jdf.queryExecution().executedPlan().toString()
