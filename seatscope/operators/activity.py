"""Login activity: per user and day, per user, per month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seatscope.functions.event_time import month_of
from seatscope.functions.rules import OCCASIONAL, RARE, REGULAR, usage_category
from seatscope.functions.text import display_name, round2
from seatscope.params import Params


def daily_activity(cleaned: DataFrame, date_column: str = "login_date") -> DataFrame:
    """``(user, activity_date, event_count)``: the only aggregate that reads the cleaned events.

    Counts are combined within each task first, so a user with very many events sends one row per
    day and task. Everything per user or per month is built on this much smaller table.

    The filter keeps every row. It makes each use of the table need the count, so that all uses
    within a query have the same shuffle, which Spark then runs once.
    """
    daily = cleaned.groupBy("user", F.col(date_column).alias("activity_date")).agg(
        F.count("*").alias("event_count")
    )
    return daily.filter(F.col("event_count") > 0)


def reporting_period(daily: DataFrame) -> DataFrame:
    """One row, one struct: observed months, first and last date, number of events."""
    return daily.agg(
        F.struct(
            F.count_distinct(month_of(F.col("activity_date"))).alias("months"),
            F.min("activity_date").alias("first_date"),
            F.max("activity_date").alias("last_date"),
            F.coalesce(F.sum("event_count"), F.lit(0)).alias("events"),
        ).alias("period")
    )


def with_gaps(daily: DataFrame) -> DataFrame:
    """Add the previous active day of the same user and the days in between."""
    by_user = Window.partitionBy("user").orderBy("activity_date")
    return daily.withColumn("previous_date", F.lag("activity_date").over(by_user)).withColumn(
        "gap_days", F.datediff("activity_date", "previous_date")
    )


def login_gaps(daily: DataFrame) -> DataFrame:
    return with_gaps(daily).select(
        "user",
        F.col("activity_date").alias("login_date"),
        F.col("previous_date").alias("previous_login_date"),
        "gap_days",
    )


def starts_month() -> Column:
    """On rows of ``with_gaps``: the first active day of a user in its month."""
    day, previous = F.col("activity_date"), F.col("previous_date")
    return previous.isNull() | (F.trunc(day, "MM") != F.trunc(previous, "MM"))


def user_activity(daily: DataFrame) -> DataFrame:
    """Counts, dates and gaps per user, in one pass over each user's days in date order."""
    return (
        with_gaps(daily)
        .groupBy("user")
        .agg(
            F.sum("event_count").alias("total_logins"),
            F.count("*").alias("distinct_login_days"),
            F.count_if(starts_month()).alias("active_months"),
            F.min("activity_date").alias("first_login_date"),
            F.max("activity_date").alias("last_login_date"),
            F.coalesce(F.max("gap_days"), F.lit(0)).cast("long").alias("longest_gap_days"),
            round2(F.coalesce(F.median("gap_days"), F.lit(0.0))).alias("median_days_between_activity"),
        )
        .withColumn("user_display_name", display_name(F.col("user")))
    )


def recent_cutoff(last_date: Column, params: Params) -> Column:
    return F.date_sub(last_date, params.recent_days)


USER_SUMMARY_COLUMNS = (
    "user", "user_display_name", "total_logins", "distinct_login_days", "active_months",
    "average_logins_per_month", "average_active_days_per_month", "percentage_months_active",
    "first_login_date", "last_login_date", "longest_gap_days", "median_days_between_activity",
    "last_90_days_active", "usage_category",
)


def user_summary(daily: DataFrame, params: Params) -> DataFrame:
    """Per-user activity with averages over the observed months, recency and usage category."""
    months = F.col("period.months")
    users = user_activity(daily).withColumn("period", reporting_period(daily).scalar())
    users = users.withColumns(
        {
            "average_logins_per_month": F.try_divide("total_logins", months),
            "average_active_days_per_month": F.try_divide("distinct_login_days", months),
            "percentage_months_active": round2(F.try_divide("active_months", months) * 100),
            "last_90_days_active": F.col("last_login_date")
            >= recent_cutoff(F.col("period.last_date"), params),
        }
    )
    return users.withColumn(
        "usage_category", usage_category(F.col("average_active_days_per_month"), params)
    ).select(*USER_SUMMARY_COLUMNS)


def user_month_days(daily: DataFrame) -> DataFrame:
    """Active days per user and month."""
    return (
        daily.groupBy("user", month_of(F.col("activity_date")).alias("year_month"))
        .agg(F.count("*").alias("active_days"))
        .select("user", display_name(F.col("user")).alias("user_display_name"), "year_month", "active_days")
    )


def months_of(monthly_users: DataFrame) -> list[str]:
    """Months of a table with one row per month; they become column names, so the driver needs them."""
    return sorted(row["year_month"] for row in monthly_users.select("year_month").collect())


def monthly_activity(daily: DataFrame, months: Sequence[str]) -> DataFrame:
    """User by month matrix of active days, with a total."""
    by_month = daily.groupBy("user", month_of(F.col("activity_date")).alias("year_month")).agg(
        F.count("*").alias("days")
    )
    matrix = by_month.groupBy("user").pivot("year_month", list(months)).agg(F.sum("days"))
    cells = [F.coalesce(F.col(f"`{name}`"), F.lit(0)).alias(name) for name in months]
    total = sum(cells, F.lit(0).cast("long")).alias("Total")
    return matrix.select("user", display_name(F.col("user")).alias("user_display_name"), *cells, total)


def with_month_labels(monthly: DataFrame) -> DataFrame:
    """M1, M2, ... by month, on a table that has one row per month already."""
    label = F.concat(F.lit("M"), F.row_number().over(Window.orderBy("year_month")).cast("string"))
    return monthly.select(label.alias("month_label"), "*")


def monthly_active_users(daily: DataFrame) -> DataFrame:
    monthly = daily.groupBy(month_of(F.col("activity_date")).alias("year_month")).agg(
        F.count_distinct("user").alias("active_users")
    )
    return with_month_labels(monthly)


def average_monthly_users(monthly_users: DataFrame) -> DataFrame:
    """One row: mean number of active users per month, 0 when there are no months."""
    return monthly_users.agg(
        F.coalesce(round2(F.avg("active_users")), F.lit(0.0)).alias("average_monthly_users")
    )


def category_summary(users: DataFrame) -> DataFrame:
    """Users per category; all three categories always present, in fixed order."""
    counts = users.agg(
        F.count("*").alias("all_users"),
        *[F.count_if(F.col("usage_category") == name).alias(name) for name in (REGULAR, OCCASIONAL, RARE)],
    )
    rows = [
        F.struct(
            F.lit(name).alias("category"),
            F.col(name).alias("user_count"),
            round2(F.try_divide(name, "all_users") * 100).alias("percentage_of_total_users"),
        )
        for name in (REGULAR, OCCASIONAL, RARE)
    ]
    return counts.select(F.inline(F.array(*rows)))


def users_by_category(users: DataFrame, category: str) -> DataFrame:
    return users.filter(F.col("usage_category") == category)


def most_active_users(users: DataFrame, limit: int = 50) -> DataFrame:
    return (
        users.orderBy(
            F.desc("average_active_days_per_month"),
            F.desc("distinct_login_days"),
            F.desc("total_logins"),
            "user_display_name",
            "user",
        )
        .limit(limit)
        .select(
            "user_display_name",
            "usage_category",
            "average_active_days_per_month",
            "distinct_login_days",
            "total_logins",
            "last_login_date",
        )
    )


def at_risk_rare_users(users: DataFrame, limit: int = 50) -> DataFrame:
    """Rare users without recent activity, least active first."""
    return (
        users.filter((F.col("usage_category") == RARE) & ~F.col("last_90_days_active"))
        .orderBy(
            "average_active_days_per_month",
            "distinct_login_days",
            "total_logins",
            "last_login_date",
            "user_display_name",
            "user",
        )
        .limit(limit)
        .select(
            "user_display_name",
            "usage_category",
            "average_active_days_per_month",
            "distinct_login_days",
            "total_logins",
            "last_login_date",
            "last_90_days_active",
        )
    )
