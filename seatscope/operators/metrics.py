"""Management metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatscope.functions.rules import (
    ALLOCATE_DEDICATED,
    MATCHED,
    MONITOR,
    OCCASIONAL,
    RARE,
    REGULAR,
    REVIEW_NEED,
)
from seatscope.functions.text import round2
from seatscope.operators.activity import average_monthly_users, reporting_period
from seatscope.operators.matching import named_counts
from seatscope.operators.recommend import licence_position
from seatscope.operators.reshape import metric_table
from seatscope.params import Params


CLEANING_COUNTERS = (
    "input_rows", "output_rows", "dropped_missing_user_rows",
    "dropped_invalid_timestamp_rows", "dropped_excluded_user_rows",
)


def _number(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double")


def _category_counts(users: DataFrame) -> list[Column]:
    return [
        F.count_if(F.col("usage_category") == name).alias(name)
        for name in (REGULAR, OCCASIONAL, RARE)
    ]


def executive_summary(
    daily: DataFrame,
    users: DataFrame,
    denial_summary: DataFrame,
    matches: DataFrame,
    recommendations: DataFrame,
) -> DataFrame:
    """Eleven headline numbers."""
    user_counts = users.agg(F.count_distinct("user").alias("users"), *_category_counts(users))
    technician_counts = matches.agg(
        F.count("*").alias("reviewed"),
        F.count_if(F.col("match_status") != MATCHED).alias("unmatched"),
    )
    return metric_table(
        [
            (reporting_period(daily), [("PLM login records analysed", _number("period.events"))]),
            (
                user_counts,
                [
                    ("PLM users analysed", _number("users")),
                    ("Regular PLM users", _number(REGULAR)),
                    ("Occasional PLM users", _number(OCCASIONAL)),
                    ("Rare PLM users", _number(RARE)),
                ],
            ),
            (
                denial_summary.agg(F.count("*").alias("denied")),
                [("Users with ADU denial evidence", _number("denied"))],
            ),
            (
                technician_counts,
                [
                    ("Production Technicians reviewed", _number("reviewed")),
                    (
                        "Production Technicians with no observed PLM authentication",
                        _number("unmatched"),
                    ),
                ],
            ),
            (
                licence_position(recommendations),
                [
                    ("Potential licences recoverable", _number("recoverable")),
                    ("Potential dedicated licence demand", _number("demand")),
                    (
                        "Recoverable licences remaining after proposed allocations",
                        _number("remaining"),
                    ),
                ],
            ),
        ]
    )


def overview_metrics(daily: DataFrame, users: DataFrame, report: DataFrame) -> DataFrame:
    """Nine overview values and the five cleaning counters, as text."""
    values = users.agg(
        F.count_distinct("user").alias("users"),
        *_category_counts(users),
        round2(F.avg("total_logins")).alias("logins_per_user"),
        round2(F.avg("distinct_login_days")).alias("days_per_user"),
    ).withColumn("period", reporting_period(daily).scalar())

    def text(name: str) -> Column:
        return F.col(name).cast("string")

    return metric_table(
        [
            (
                values,
                [
                    ("total_login_records", text("period.events")),
                    ("total_unique_users", text("users")),
                    ("date_range_start", text("period.first_date")),
                    ("date_range_end", text("period.last_date")),
                    ("regular_user_count", text(REGULAR)),
                    ("occasional_user_count", text(OCCASIONAL)),
                    ("rare_user_count", text(RARE)),
                    ("average_logins_per_user", text("logins_per_user")),
                    ("average_active_days_per_user", text("days_per_user")),
                ],
            ),
            (report, [(name, text(name)) for name in CLEANING_COUNTERS]),
        ]
    )


def assigned_with_denials(analysis: DataFrame, denial_summary: DataFrame, params: Params) -> DataFrame:
    """One row: denied users whose display name is, letter for letter, a shared-licence holder's."""
    assigned = (
        analysis.filter(F.col("allocated_licence") == params.shared_licence)
        .groupBy("named_user")
        .agg(F.count("*").alias("holders"))
    )
    denied = denial_summary.groupBy("user_display_name").agg(F.count("*").alias("denied"))
    # Rows per name are counted on both sides and multiplied, so that no pairs are made. Null-safe,
    # because a plain equality would add a not-null filter below the shared aggregates.
    same_name = F.col("user_display_name").eqNullSafe(F.col("named_user"))
    pairs = F.sum(F.col("holders") * F.col("denied"))
    return denied.join(assigned, same_name, "inner").agg(
        F.coalesce(pairs, F.lit(0)).alias("assigned_with_denials")
    )


def estate_metrics(
    analysis: DataFrame,
    denial_summary: DataFrame,
    recommendations: DataFrame,
    monthly_users: DataFrame,
    params: Params,
) -> DataFrame:
    counts = analysis.agg(
        F.count("*").alias("named"),
        F.count_if(F.col("match_status") != MATCHED).alias("no_login"),
        F.count_if(F.col("allocated_licence") == params.shared_licence).alias("assigned"),
    )
    return metric_table(
        [
            (
                counts,
                [
                    ("Named licence users", _number("named")),
                    ("Named licence users with no observed login", _number("no_login")),
                    ("ADU-assigned users", _number("assigned")),
                ],
            ),
            (
                assigned_with_denials(analysis, denial_summary, params),
                [("ADU-assigned users with denial evidence", _number("assigned_with_denials"))],
            ),
            (
                licence_position(recommendations),
                [("High-confidence dedicated ADU candidates", _number("demand"))],
            ),
            (
                average_monthly_users(monthly_users),
                [("Average monthly PLM users", _number("average_monthly_users"))],
            ),
        ]
    )


def named_vs_average(analysis: DataFrame, monthly_users: DataFrame) -> DataFrame:
    counts = named_counts(analysis).withColumn(
        "average", average_monthly_users(monthly_users).scalar()
    )
    return metric_table(
        [
            (
                counts,
                [
                    ("Named licence users", _number("named")),
                    ("Average monthly PLM users", _number("average")),
                    ("Named users with no observed login", _number("no_login")),
                ],
            )
        ]
    )


def named_allocation_comparison(named_summary: DataFrame) -> DataFrame:
    """Two of the named-licence metrics side by side."""
    wanted = ("Named licences allocated", "Average monthly PLM users")
    return named_summary.filter(F.col("metric").isin(*wanted))


def named_vs_adu_status(analysis: DataFrame, params: Params) -> DataFrame:
    """Usage status of all named users and of those on the shared licence."""
    status = F.coalesce("usage_category", F.lit("No observed login"))
    statuses = (REGULAR, OCCASIONAL, RARE, "No observed login")
    on_shared = F.coalesce(F.col("allocated_licence") == params.shared_licence, F.lit(False))
    counts = analysis.select(status.alias("status"), on_shared.alias("on_shared")).agg(
        *[F.count_if(F.col("status") == name).alias(f"all {name}") for name in statuses],
        *[
            F.count_if((F.col("status") == name) & F.col("on_shared")).alias(f"shared {name}")
            for name in statuses
        ],
    )
    rows = [
        F.struct(
            F.lit(label).alias("group"),
            *[F.col(f"{prefix} {name}").alias(name) for name in statuses],
        )
        for label, prefix in (("Named users", "all"), ("ADU-assigned users", "shared"))
    ]
    return counts.select(F.inline(F.array(*rows)))


def adu_executive_summary(denial_summary: DataFrame, recommendations: DataFrame) -> DataFrame:
    def total(label: str, name: str) -> Column:
        return F.count_if(F.col("recommendation") == label).alias(name)

    counts = recommendations.agg(
        total(ALLOCATE_DEDICATED, "dedicated"), total(REVIEW_NEED, "review"), total(MONITOR, "monitor")
    )
    return metric_table(
        [
            (
                denial_summary.agg(F.count("*").alias("denied")),
                [("Users with ADU denial evidence", _number("denied"))],
            ),
            (
                counts,
                [
                    ("High-confidence dedicated licence candidates", _number("dedicated")),
                    ("ADU users for review", _number("review")),
                    ("ADU users to monitor", _number("monitor")),
                ],
            ),
        ]
    )
