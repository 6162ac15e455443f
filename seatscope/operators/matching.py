"""Matching people across sources by normalised name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatscope.functions.rules import (
    NO_LOGIN_ACTIVITY,
    OCCASIONAL,
    RARE,
    REGULAR,
    MATCHED,
    dedicated_candidate,
    match_status,
    named_review_status,
    technician_review_status,
)
from seatscope.functions.text import name_key, round2
from seatscope.operators.activity import average_monthly_users
from seatscope.operators.reshape import match_list, metric_table
from seatscope.params import Params

_KEY = "_name_key"
_PARTS, _PART = "_name_parts", "_name_part"
DENIAL_COUNTS = (
    "adu_denied_attempts", "adu_denied_days", "adu_denied_months",
    "adu_denied_attempts_last_90_days", "adu_denied_days_last_90_days",
)
# Column order of the flagged user summary after the summary's own columns.
FLAG_COLUMNS = (
    "is_production_technician", "production_technician_name", "adu_denied_attempts",
    "adu_denied_days", "adu_denied_months", "last_adu_denial", "adu_denied_attempts_last_90_days",
    "adu_denied_days_last_90_days", "is_repeated_adu_denial_user", "has_adu_denials",
    "is_dedicated_licence_candidate",
)


def with_name_key(table: DataFrame, name_column: str = "user_display_name") -> DataFrame:
    return table.withColumn(_KEY, name_key(F.col(name_column)))


def _technician_side(technicians: DataFrame) -> DataFrame:
    return technicians.select(
        F.col("production_technician_match_key").alias(_KEY), "production_technician_name"
    )


def _denial_side(denial_summary: DataFrame) -> DataFrame:
    return with_name_key(denial_summary).select(
        _KEY, "user", *DENIAL_COUNTS, "last_adu_denial", "is_repeated_adu_denial_user"
    )


def _technician_flag() -> dict[str, Column]:
    return {"is_production_technician": F.col("production_technician_name").isNotNull()}


def _denial_flags(params: Params) -> dict[str, Column]:
    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    flags = {name: count(name) for name in DENIAL_COUNTS}
    flags["is_repeated_adu_denial_user"] = F.coalesce("is_repeated_adu_denial_user", F.lit(False))
    flags["has_adu_denials"] = count("adu_denied_attempts") > 0
    flags["is_dedicated_licence_candidate"] = dedicated_candidate(
        count("adu_denied_days"), F.col("usage_category"), params
    )
    return flags


def flag_technicians(users: DataFrame, technicians: DataFrame) -> DataFrame:
    """Users with the technician of the same name, in the technician list's spelling."""
    return (
        with_name_key(users)
        .join(_technician_side(technicians), _KEY, "left")
        .withColumns(_technician_flag())
        .select(*users.columns, *FLAG_COLUMNS[:2])
    )


def heavy_names(denial_side: DataFrame, params: Params) -> DataFrame:
    """Names that more than ``name_part_rows`` denied users share, and into how many parts to deal them."""
    rows = F.count("*")
    counts = denial_side.filter(F.col(_KEY).isNotNull()).groupBy(_KEY).agg(rows.alias("_rows"))
    parts = F.ceil(F.col("_rows") / params.name_part_rows)
    return counts.filter(F.col("_rows") > params.name_part_rows).select(_KEY, parts.alias(_PARTS))


def dealt_by_part(
    users: DataFrame, denial_side: DataFrame, params: Params
) -> tuple[DataFrame, DataFrame]:
    """Both sides of the denial join, with the part of the name that each row belongs to.

    A denied user of a heavy name is in one part, chosen by the user; a user of that name is in all
    of them. All other names have the one part 0. So no task has to hold all denied users of a name.
    """
    heavy = heavy_names(denial_side, params)
    parts = F.coalesce(F.col(_PARTS), F.lit(1)).cast("long")
    one = F.pmod(F.xxhash64("user"), parts)
    every = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    return (
        users.join(heavy, _KEY, "left").withColumn(_PART, every),
        denial_side.join(heavy, _KEY, "left").withColumn(_PART, one).drop(_PARTS, "user"),
    )


def _with_denials(users: DataFrame, denial_summary: DataFrame, params: Params) -> DataFrame:
    """Users that have a name key, left joined with the denied users of their name."""
    left, right = dealt_by_part(users, _denial_side(denial_summary), params)
    joined = left.join(right, [_KEY, _PART], "left")
    # A heavy name has denied users, so a row without one is a part that is empty.
    is_match = F.col(_PARTS).isNull() | F.col("adu_denied_attempts").isNotNull()
    return joined.filter(is_match)


def add_denial_flags(users: DataFrame, denial_summary: DataFrame, params: Params) -> DataFrame:
    """Users with the denials of every denied user of the same name."""
    return (
        _with_denials(with_name_key(users), denial_summary, params)
        .withColumns(_denial_flags(params))
        .select(*users.columns, *FLAG_COLUMNS[2:])
    )


def flag_users(
    users: DataFrame, technicians: DataFrame, denial_summary: DataFrame, params: Params
) -> DataFrame:
    """Both flags in two left joins.

    Users are the outer side of both, so a very common name can be split among tasks. Technicians
    are unique by name; denied users of a very common name are dealt into parts.
    """
    return (
        _with_denials(
            with_name_key(users).join(_technician_side(technicians), _KEY, "left"),
            denial_summary,
            params,
        )
        .withColumns({**_technician_flag(), **_denial_flags(params)})
        .select(*users.columns, *FLAG_COLUMNS)
    )


def technician_matches(technicians: DataFrame, users: DataFrame) -> DataFrame:
    """Every technician with the users of the same name, and a review status."""
    people = with_name_key(users).select(
        _KEY,
        F.col("user").alias("matched_user"),
        "user_display_name",
        "usage_category",
        "distinct_login_days",
        "last_login_date",
    )
    status = match_status(F.col("matched_user"))
    return (
        match_list(technicians, "production_technician_match_key", people, _KEY)
        .withColumn("match_status", status)
        .withColumn(
            "review_status", technician_review_status(F.col("match_status"), F.col("usage_category"))
        )
        .select(
            "production_technician_name",
            "match_status",
            "matched_user",
            "user_display_name",
            "usage_category",
            "review_status",
            "distinct_login_days",
            "last_login_date",
        )
    )


def technician_review_summary(matches: DataFrame) -> DataFrame:
    status = technician_review_status(F.col("match_status"), F.col("usage_category"))
    return matches.groupBy(status.alias("review_status")).agg(F.count("*").alias("user_count"))


def named_licence_analysis(named: DataFrame, flagged_users: DataFrame) -> DataFrame:
    """Every named-licence holder with the users of the same name, and a review status."""
    counts = (
        "distinct_login_days", "active_months", "average_active_days_per_month",
        "adu_denied_days", "adu_denied_attempts",
    )
    people = with_name_key(flagged_users).select(
        _KEY,
        F.col("user").alias("matched_login_user"),
        "user_display_name",
        "usage_category",
        "last_login_date",
        "is_production_technician",
        *counts,
    )
    return (
        match_list(named, "named_user_match_key", people, _KEY)
        .withColumn("match_status", match_status(F.col("matched_login_user")))
        .withColumns(
            {
                "named_licence_review_status": named_review_status(
                    F.col("match_status"), F.col("usage_category")
                ),
                "is_production_technician": F.coalesce("is_production_technician", F.lit(False)),
                **{name: F.coalesce(F.col(name), F.lit(0)) for name in counts},
            }
        )
        .select(
            "named_user",
            "allocated_licence",
            "match_status",
            "matched_login_user",
            "user_display_name",
            "usage_category",
            "distinct_login_days",
            "active_months",
            "average_active_days_per_month",
            "last_login_date",
            "adu_denied_days",
            "adu_denied_attempts",
            "is_production_technician",
            "named_licence_review_status",
        )
    )


def named_counts(analysis: DataFrame) -> DataFrame:
    """One row of counts over the named-licence analysis."""
    category = F.col("usage_category")
    return analysis.agg(
        F.count("*").alias("named"),
        F.count_if(F.col("match_status") == MATCHED).alias("matched"),
        F.count_if(F.col("match_status") != MATCHED).alias("no_login"),
        F.count_if(category == REGULAR).alias("regular"),
        F.count_if(category == OCCASIONAL).alias("occasional"),
        F.count_if(category == RARE).alias("rare"),
    )


def named_licence_summary(analysis: DataFrame, monthly_users: DataFrame) -> DataFrame:
    """Headline numbers of the named-licence group; the monthly average is 0 for an empty group."""
    counts = named_counts(analysis).withColumn(
        "average",
        F.when(F.col("named") > 0, average_monthly_users(monthly_users).scalar()).otherwise(0.0),
    )

    def number(name: str) -> Column:
        return F.col(name).cast("double")

    return metric_table(
        [
            (
                counts,
                [
                    ("Named licences allocated", number("named")),
                    ("Named users matched to login audit", number("matched")),
                    ("Named users with no observed login", number("no_login")),
                    ("Named users classed as Regular", number("regular")),
                    ("Named users classed as Occasional", number("occasional")),
                    ("Named users classed as Rare", number("rare")),
                    ("Average monthly PLM users", number("average")),
                    (
                        "Named licences above average monthly PLM users",
                        round2(number("named") - F.col("average")),
                    ),
                ],
            )
        ]
    )


def named_licence_review_summary(analysis: DataFrame) -> DataFrame:
    return analysis.groupBy("named_licence_review_status").agg(F.count("*").alias("user_count"))


def named_licence_no_login(analysis: DataFrame) -> DataFrame:
    return analysis.filter(F.col("named_licence_review_status") == NO_LOGIN_ACTIVITY)
