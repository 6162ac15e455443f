"""The review: four inputs in, the full set of result tables out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatscope.functions.rules import OCCASIONAL, RARE, REGULAR, row_highlight
from seatscope.operators import activity, clean, denials, matching, metrics, recommend
from seatscope.params import Params
from seatscope.plans import rules_text
from seatscope.session import StagedTables, configure, unstaged
from seatscope.sources import readers, writers

Stage = Callable[[str, DataFrame], DataFrame]


@dataclass(frozen=True)
class Inputs:
    """Raw login and denial rows, and the two cleaned name lists."""

    login: DataFrame
    denials: DataFrame
    named: DataFrame
    technicians: DataFrame


def read_inputs(spark: SparkSession, params: Params) -> Inputs:
    return Inputs(
        login=readers.read_login_audit(spark, params),
        denials=readers.read_denial_audit(spark, params),
        named=readers.read_named_licences(spark, params),
        technicians=readers.read_technicians(spark, params),
    )


def _nulls_last(*names: str) -> list[Column]:
    """Sort keys with NULLs last both ways; a leading minus sorts downwards."""
    return [
        F.desc_nulls_last(name[1:]) if name.startswith("-") else F.asc_nulls_last(name)
        for name in names
    ]


_BY_ACTIVITY = (
    "usage_category", "-average_active_days_per_month", "-distinct_login_days",
    "user_display_name", "user",
)
_BY_DENIALS = (
    "-adu_denied_days", "-adu_denied_attempts", "-last_adu_denial", "user_display_name", "user",
)

# Row order of each table. Tables not named here carry their order already.
REPORT_ORDER = {
    "user_summary": _BY_ACTIVITY,
    "regular_users": _BY_ACTIVITY,
    "occasional_users": _BY_ACTIVITY,
    "rare_users": _BY_ACTIVITY,
    "adu_user_summary": _BY_DENIALS,
    "adu_monthly_denials": ("year_month",),
    "monthly_active_users": ("year_month",),
    "monthly_activity": ("user_display_name", "user"),
    "production_technician_matches": ("match_status", "production_technician_name", "matched_user"),
    "production_technician_review_summary": ("review_status",),
    "named_licence_analysis": (
        "allocated_licence", "named_licence_review_status", "named_user", "matched_login_user",
    ),
    "named_licence_no_login": (
        "allocated_licence", "named_licence_review_status", "named_user", "matched_login_user",
    ),
    "named_licence_review_summary": ("-user_count", "named_licence_review_status"),
    "licence_recommendations": (
        "recommendation", "-adu_denied_days", "-distinct_login_days", "user",
    ),
    "dedicated_licence_candidates": (
        "-adu_denied_days", "-adu_denied_attempts", "-distinct_login_days", "user",
    ),
    "recommendation_summary": ("-user_count", "recommendation"),
    "technician_list": ("production_technician_name",),
    "named_licence_list": ("named_user",),
}

# Tables of a run by report section, with the tables each section is made of.
REPORT_SECTIONS = {
    "overall_analysis": (
        "overall_metrics", "category_summary", "monthly_active_users", "estate_metrics",
        "named_vs_average", "named_vs_adu_status",
    ),
    "named_licence_overview": (
        "named_licence_summary", "named_licence_review_summary", "named_allocation_comparison",
    ),
    "denial_overview": (
        "adu_executive_summary", "threshold_explanation", "adu_monthly_denials",
        "ranked_adu_users", "adu_user_label_key",
    ),
    "reallocation": (
        "licence_balance", "unused_licence_evidence", "recommendation_summary",
        "dedicated_licence_candidates",
    ),
    "usage_analysis": ("category_summary", "monthly_active_users", "most_active_users"),
    "denial_analysis": ("adu_monthly_denials", "ranked_adu_users", "adu_user_label_key"),
    "reporting": (
        "executive_summary", "unused_licence_evidence", "dedicated_licence_candidates",
        "category_summary", "recommendation_summary", "monthly_active_users",
        "adu_monthly_denials", "ranked_adu_users", "production_technician_matches",
        "licence_balance",
    ),
    "named_licences": ("named_licence_analysis", "named_licence_no_login"),
    "recommendations": ("licence_recommendations", "dedicated_licence_candidates"),
    "technicians": ("production_technician_matches", "production_technician_review_summary"),
    "users": ("user_summary", "regular_users", "occasional_users", "rare_users"),
    "denied_users": ("adu_user_summary",),
    "monthly": ("monthly_activity", "adu_monthly_denials"),
    "source_rows": ("raw_login", "raw_denials"),
    "rules": ("rules_and_assumptions", "category_rules"),
}


# The metrics of the executive summary that head the overall analysis.
OVERALL_METRICS = (
    "PLM login records analysed", "PLM users analysed", "Regular PLM users", "Occasional PLM users",
    "Rare PLM users",
)

# Cleaned rows; written by month, in time order within each.
SOURCE_ROWS = ("raw_login", "raw_denials")


def in_report_order(name: str, table: DataFrame) -> DataFrame:
    order = REPORT_ORDER.get(name)
    return table.orderBy(*_nulls_last(*order)) if order else table


def with_highlight(users: DataFrame) -> DataFrame:
    """User rows with the highlight a reader of the report would see."""
    highlight = row_highlight(
        F.col("is_production_technician"), F.col("is_dedicated_licence_candidate")
    )
    return users.withColumn("row_highlight", highlight)


def build_tables(
    spark: SparkSession, inputs: Inputs, params: Params, stage: Stage = unstaged
) -> dict[str, DataFrame]:
    """All result tables by name, unordered.

    ``stage`` is called on every intermediate that several tables share. Each raw audit is read
    once, also with an exclusion table: its rows are staged with their states, and the cleaned rows,
    the per-day tables, which everything else builds on, and the excluded users come from there.
    """
    login_rows = stage("login_rows", clean.login_rows(inputs.login, params))
    login_rows = clean.after_exclusions(login_rows, params)
    denial_rows = stage("denial_rows", clean.denial_rows(inputs.denials, params))
    denial_rows = clean.after_exclusions(denial_rows, params)
    cleaned_login = clean.kept_logins(login_rows)
    cleaned_denials = clean.kept_denials(denial_rows)
    states = stage("login_day_states", clean.login_day_states(login_rows))
    daily = clean.kept_days(states)
    denial_daily = stage("denial_daily", activity.daily_activity(cleaned_denials, "denial_date"))
    report = clean.report_of_states(states)
    technicians = stage("technician_list", inputs.technicians)
    named = stage("named_licence_list", inputs.named)

    denied = stage("adu_user_summary", denials.adu_user_summary(denial_daily, params))
    users = stage(
        "user_summary",
        matching.flag_users(activity.user_summary(daily, params), technicians, denied, params),
    )
    matches = stage("technician_matches", matching.technician_matches(technicians, users))
    analysis = stage("named_licence_analysis", matching.named_licence_analysis(named, users))
    advice = stage(
        "licence_recommendations",
        recommend.licence_recommendations(users, denied, matches, params),
    )
    monthly_users = stage("monthly_active_users", activity.monthly_active_users(daily))

    executive = metrics.executive_summary(daily, users, denied, matches, advice)
    named_summary = matching.named_licence_summary(analysis, monthly_users)
    ranked = denials.ranked_adu_users(denied)
    return {
        "raw_login": cleaned_login,
        "raw_denials": cleaned_denials,
        "cleaning_report": report,
        "user_summary": users,
        "regular_users": activity.users_by_category(users, REGULAR),
        "occasional_users": activity.users_by_category(users, OCCASIONAL),
        "rare_users": activity.users_by_category(users, RARE),
        "adu_user_summary": denied,
        "adu_monthly_denials": denials.adu_monthly_denials(denial_daily),
        "monthly_active_users": monthly_users,
        "monthly_activity": activity.monthly_activity(daily, activity.months_of(monthly_users)),
        "category_summary": activity.category_summary(users),
        "most_active_users": activity.most_active_users(users),
        "at_risk_rare_users": activity.at_risk_rare_users(users),
        "technician_list": technicians,
        "production_technician_matches": matches,
        "production_technician_review_summary": matching.technician_review_summary(matches),
        "named_licence_list": named,
        "named_licence_analysis": analysis,
        "named_licence_summary": named_summary,
        "named_licence_review_summary": matching.named_licence_review_summary(analysis),
        "named_licence_no_login": matching.named_licence_no_login(analysis),
        "licence_recommendations": advice,
        "dedicated_licence_candidates": recommend.dedicated_licence_candidates(advice),
        "recommendation_summary": recommend.recommendation_summary(advice),
        "licence_balance": recommend.licence_balance(advice),
        "unused_licence_evidence": recommend.unused_licence_evidence(advice),
        "executive_summary": executive,
        "overall_metrics": executive.filter(F.col("metric").isin(*OVERALL_METRICS)),
        "overview_metrics": metrics.overview_metrics(daily, users, report),
        "estate_metrics": metrics.estate_metrics(analysis, denied, advice, monthly_users, params),
        "named_vs_average": metrics.named_vs_average(analysis, monthly_users),
        "named_vs_adu_status": metrics.named_vs_adu_status(analysis, params),
        "named_allocation_comparison": metrics.named_allocation_comparison(named_summary),
        "adu_executive_summary": metrics.adu_executive_summary(denied, advice),
        "ranked_adu_users": ranked,
        "adu_user_label_key": denials.adu_user_label_key(ranked),
        "category_rules": rules_text.category_rules(spark, params),
        "rules_and_assumptions": rules_text.rules_and_assumptions(spark, params),
        "threshold_explanation": rules_text.threshold_explanation(spark, params),
    }


def write_review(
    spark: SparkSession, inputs: Inputs, params: Params, output_format: str = "parquet"
) -> list[str]:
    """Build every table and write each one once, in report order; publish the run when all are there.

    Tables lie in a folder of the run, see ``writers.Publication``. A run that fails leaves what was
    published before as it was.
    """
    configure(spark)
    staged = StagedTables(spark)
    publication = writers.Publication(spark, params.output_path)
    try:
        tables = build_tables(spark, inputs, params, staged)
        for name in ("user_summary", "regular_users", "occasional_users", "rare_users"):
            tables[name] = with_highlight(tables[name])
        rows = {name: tables.pop(name) for name in SOURCE_ROWS}
        ordered = {name: in_report_order(name, table) for name, table in tables.items()}
        folders = writers.write_tables(ordered, publication.folder, output_format)
        folders += writers.write_tables(
            {name: clean.in_time_order_within_months(table) for name, table in rows.items()},
            publication.folder,
            output_format,
            partition_by="year_month",
        )
        publication.publish()
        return folders
    except BaseException:
        publication.withdraw()
        raise
    finally:
        staged.remove()


def run_review(spark: SparkSession, params: Params, output_format: str = "parquet") -> list[str]:
    """Read the inputs named in the parameters and write the review."""
    configure(spark)
    return write_review(spark, read_inputs(spark, params), params, output_format)
