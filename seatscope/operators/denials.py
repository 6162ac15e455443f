"""Licence denials: per user and per month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seatscope.functions.event_time import month_of
from seatscope.functions.rules import repeated_denials
from seatscope.functions.text import display_name
from seatscope.operators.activity import (
    recent_cutoff,
    starts_month,
    with_gaps,
    with_month_labels,
)
from seatscope.params import Params

DENIAL_SUMMARY_COLUMNS = (
    "user", "user_display_name", "adu_denied_attempts", "adu_denied_days", "adu_denied_months",
    "first_adu_denial", "last_adu_denial", "adu_denied_attempts_last_90_days",
    "adu_denied_days_last_90_days", "is_repeated_adu_denial_user",
)


def denial_user_counts(daily: DataFrame, params: Params) -> DataFrame:
    """Attempts, days, months, first and last denial, and the recent share, per user."""
    days = (
        with_gaps(daily)
        .withColumn("last_date", daily.agg(F.max("activity_date")).scalar())
        .withColumn(
            "is_recent", F.col("activity_date") >= recent_cutoff(F.col("last_date"), params)
        )
    )
    return days.groupBy("user").agg(
        F.sum("event_count").alias("adu_denied_attempts"),
        F.count("*").alias("adu_denied_days"),
        F.count_if(starts_month()).alias("adu_denied_months"),
        F.min("activity_date").alias("first_adu_denial"),
        F.max("activity_date").alias("last_adu_denial"),
        F.sum(F.when(F.col("is_recent"), F.col("event_count")).otherwise(0)).alias(
            "adu_denied_attempts_last_90_days"
        ),
        F.count_if("is_recent").alias("adu_denied_days_last_90_days"),
    )


def adu_user_summary(daily: DataFrame, params: Params) -> DataFrame:
    return (
        denial_user_counts(daily, params)
        .withColumn("user_display_name", display_name(F.col("user")))
        .withColumn(
            "is_repeated_adu_denial_user",
            repeated_denials(F.col("adu_denied_days"), F.col("adu_denied_attempts"), params),
        )
        .select(*DENIAL_SUMMARY_COLUMNS)
    )


def adu_monthly_denials(daily: DataFrame) -> DataFrame:
    """Attempts, users and days per month. Days of a month are counted as bits of one number."""
    day_bit = F.expr("shiftleft(1L, dayofmonth(activity_date) - 1)")
    monthly = (
        daily.withColumn("day_bit", day_bit)
        .groupBy(month_of(F.col("activity_date")).alias("year_month"))
        .agg(
            F.sum("event_count").alias("adu_denied_attempts"),
            F.count_distinct("user").alias("adu_denied_users"),
            F.bit_count(F.bit_or("day_bit")).cast("long").alias("adu_denied_days"),
        )
    )
    return with_month_labels(monthly)


def denial_order() -> list:
    """Most affected users first; equal rows by user."""
    return [
        F.desc("adu_denied_days"),
        F.desc("adu_denied_attempts"),
        F.desc("last_adu_denial"),
        F.asc("user_display_name"),
        F.asc("user"),
    ]


def ranked_adu_users(denial_summary: DataFrame, limit: int = 20) -> DataFrame:
    """The most affected users, labelled U1, U2, ..."""
    top = denial_summary.orderBy(*denial_order()).limit(limit)
    rank = F.row_number().over(Window.orderBy(*denial_order()))
    return top.select(F.concat(F.lit("U"), rank.cast("string")).alias("user_label"), "*")


def adu_user_label_key(ranked: DataFrame) -> DataFrame:
    return ranked.select("user_label", "user_display_name")
