"""Licence recommendations and the tables derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatscope.functions.rules import (
    ALLOCATE_DEDICATED,
    JUSTIFICATION_SUFFIX,
    NO_AUTHENTICATION,
    REMOVE_OR_REALLOCATE,
    evidence_summary,
    first_filled,
    recommendation,
    user_group,
)
from seatscope.operators.matching import with_name_key
from seatscope.operators.reshape import first_per_key
from seatscope.params import Params

_KEY = "_name_key"

# The evidence rows.
EVIDENCE_ROWS = (
    (
        "Potential recoverable Production Technician licences",
        "recoverable",
        "Count of Production Technicians either unmatched to the PLM login audit "
        "or matched but classified as Rare usage.",
    ),
    (
        "Dedicated licences proposed for ADU users",
        "demand",
        "Count of ADU-denied users with observed Regular or Occasional PLM usage and ADU denied days "
        "above the dedicated-licence threshold.",
    ),
    (
        "Recoverable licences remaining after proposed allocations",
        "remaining",
        "Potential recoverable Production Technician licences minus proposed dedicated ADU allocations.",
    ),
)


def review_subjects(
    users: DataFrame, denial_summary: DataFrame, matches: DataFrame
) -> DataFrame:
    """One row per name that has denials or is a technician, with its first row of each source.

    Each source is cut to one row per name before anything is joined, so that a name shared by
    many users cannot load a single task.
    """
    logins = first_per_key(
        with_name_key(users),
        _KEY,
        [
            F.asc("usage_category"),
            F.desc("average_active_days_per_month"),
            F.desc("distinct_login_days"),
            F.asc("user_display_name"),
            F.asc("user"),
        ],
    ).select(
        _KEY,
        F.col("user_display_name").alias("login_name"),
        "usage_category",
        "distinct_login_days",
        "active_months",
        "last_login_date",
    )
    denials = first_per_key(
        with_name_key(denial_summary),
        _KEY,
        [
            F.desc("adu_denied_days"),
            F.desc("adu_denied_attempts"),
            F.desc("last_adu_denial"),
            F.asc("user_display_name"),
            F.asc("user"),
        ],
    ).select(
        _KEY,
        F.col("user_display_name").alias("denial_name"),
        "adu_denied_attempts",
        "adu_denied_days",
        "last_adu_denial",
        F.lit(True).alias("has_denials"),
    )
    technicians = first_per_key(
        with_name_key(matches, "production_technician_name"),
        _KEY,
        ["match_status", "production_technician_name"],
    ).select(
        _KEY,
        F.col("production_technician_name").alias("technician_name"),
        F.col("match_status").alias("technician_status"),
        F.lit(True).alias("is_technician"),
    )
    return denials.join(technicians, _KEY, "full").join(logins, _KEY, "left")


def licence_recommendations(
    users: DataFrame, denial_summary: DataFrame, matches: DataFrame, params: Params
) -> DataFrame:
    """Recommendation, rationale and evidence per name."""

    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("long")

    subjects = review_subjects(users, denial_summary, matches).withColumns(
        {
            "distinct_login_days": count("distinct_login_days"),
            "active_months": count("active_months"),
            "adu_denied_attempts": count("adu_denied_attempts"),
            "adu_denied_days": count("adu_denied_days"),
            "has_denials": F.coalesce("has_denials", F.lit(False)),
            "is_technician": F.coalesce("is_technician", F.lit(False)),
        }
    )
    outcome = recommendation(
        category=F.col("usage_category"),
        is_technician=F.col("is_technician"),
        technician_status=F.col("technician_status"),
        has_denials=F.col("has_denials"),
        denied_attempts=F.col("adu_denied_attempts"),
        denied_days=F.col("adu_denied_days"),
        params=params,
    )
    evidence = evidence_summary(
        category=F.col("usage_category"),
        login_days=F.col("distinct_login_days"),
        active_months=F.col("active_months"),
        denied_attempts=F.col("adu_denied_attempts"),
        denied_days=F.col("adu_denied_days"),
        technician_status=F.col("technician_status"),
    )
    return subjects.withColumn("outcome", outcome).select(
        first_filled(F.col("login_name"), F.col("denial_name"), F.col("technician_name")).alias("user"),
        user_group(F.col("is_technician"), F.col("has_denials")).alias("user_group"),
        F.coalesce(F.nullif("usage_category", F.lit("")), F.lit(NO_AUTHENTICATION)).alias("usage_category"),
        "distinct_login_days",
        "active_months",
        "last_login_date",
        "adu_denied_attempts",
        "adu_denied_days",
        "last_adu_denial",
        F.col("technician_status").alias("production_technician_match_status"),
        "outcome.recommendation",
        "outcome.rationale",
        evidence.alias("evidence_summary"),
    )


def dedicated_licence_candidates(recommendations: DataFrame) -> DataFrame:
    return recommendations.filter(F.col("recommendation") == ALLOCATE_DEDICATED).select(
        "user",
        "usage_category",
        "distinct_login_days",
        "active_months",
        "adu_denied_attempts",
        "adu_denied_days",
        "last_adu_denial",
        F.concat("evidence_summary", F.lit(JUSTIFICATION_SUFFIX)).alias("justification"),
    )


def recommendation_summary(recommendations: DataFrame) -> DataFrame:
    return recommendations.groupBy("recommendation").agg(F.count("*").alias("user_count"))


def licence_position(recommendations: DataFrame) -> DataFrame:
    """One row: recoverable licences, dedicated demand, and what remains."""
    totals = recommendations.agg(
        F.count_if(F.col("recommendation") == REMOVE_OR_REALLOCATE).alias("recoverable"),
        F.count_if(F.col("recommendation") == ALLOCATE_DEDICATED).alias("demand"),
    )
    return totals.withColumn("remaining", F.col("recoverable") - F.col("demand"))


def licence_balance(recommendations: DataFrame) -> DataFrame:
    rows = [
        F.struct(F.lit(label).alias("licence_position"), F.col(name).alias("user_count"))
        for label, name in (
            ("Potential licences recoverable", "recoverable"),
            ("Potential dedicated licence demand", "demand"),
        )
    ]
    return licence_position(recommendations).select(F.inline(F.array(*rows)))


def unused_licence_evidence(recommendations: DataFrame) -> DataFrame:
    rows = [
        F.struct(
            F.lit(measure).alias("measure"),
            F.col(name).alias("count"),
            F.lit(method).alias("confirmation_method"),
        )
        for measure, name, method in EVIDENCE_ROWS
    ]
    return licence_position(recommendations).select(F.inline(F.array(*rows)))
