"""One query per operator, each over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harness import inputs
from harness.inputs import PARAMS
from seatscope.functions import event_time, rules, text
from seatscope.operators import activity, clean, denials, matching, metrics, recommend
from seatscope.params import Exclusions, Params, Source
from seatscope.plans.review import Inputs, in_report_order, with_highlight
from seatscope.session import StagedTables
from seatscope.sources import exclusions, readers


class Review:
    """The intermediate tables of one run, built lazily; nothing is computed or kept here."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def login_audit(self) -> DataFrame:
        return inputs.login_audit(self.spark, self.sf_dir)

    @cached_property
    def denial_audit(self) -> DataFrame:
        return inputs.denial_audit(self.spark, self.sf_dir)

    @cached_property
    def login(self) -> DataFrame:
        return clean.clean_login(self.login_audit, PARAMS)

    @cached_property
    def denied_rows(self) -> DataFrame:
        return clean.clean_denials(self.denial_audit, PARAMS)

    @cached_property
    def daily(self) -> DataFrame:
        return activity.daily_activity(self.login)

    @cached_property
    def denial_daily(self) -> DataFrame:
        return activity.daily_activity(self.denied_rows, "denial_date")

    @cached_property
    def users(self) -> DataFrame:
        return activity.user_summary(self.daily, PARAMS)

    @cached_property
    def denied(self) -> DataFrame:
        return denials.adu_user_summary(self.denial_daily, PARAMS)

    @cached_property
    def technician_names(self) -> DataFrame:
        return inputs.technician_names(self.spark, self.sf_dir)

    @cached_property
    def technicians(self) -> DataFrame:
        return readers.technician_list(self.technician_names, PARAMS, F.col("ord"))

    @cached_property
    def named(self) -> DataFrame:
        rows = inputs.named_licences(self.spark, self.sf_dir)
        return readers.named_licence_list(rows, PARAMS, F.col("ord"))

    @cached_property
    def flagged(self) -> DataFrame:
        return matching.flag_users(self.users, self.technicians, self.denied, PARAMS)

    @cached_property
    def matches(self) -> DataFrame:
        return matching.technician_matches(self.technicians, self.flagged)

    @cached_property
    def analysis(self) -> DataFrame:
        return matching.named_licence_analysis(self.named, self.flagged)

    @cached_property
    def advice(self) -> DataFrame:
        return recommend.licence_recommendations(self.flagged, self.denied, self.matches, PARAMS)

    @cached_property
    def monthly(self) -> DataFrame:
        return activity.monthly_active_users(self.daily)

    @cached_property
    def report(self) -> DataFrame:
        return clean.cleaning_report(self.login_audit, PARAMS)

    @cached_property
    def named_summary(self) -> DataFrame:
        return matching.named_licence_summary(self.analysis, self.monthly)

    @cached_property
    def ranked(self) -> DataFrame:
        return denials.ranked_adu_users(self.denied)

    # Sources

    def scan_login_audit(self) -> DataFrame:
        source = Source(f"{self.sf_dir}/events.parquet")
        return readers.read_login_audit(self.spark, Params(login=source))

    def scan_denial_audit(self) -> DataFrame:
        """A denial audit with typed columns; the label filter reaches the scan."""
        params = Params(
            denials=Source(f"{self.sf_dir}/events.parquet"),
            denial_user_column="user_id",
            denial_timestamp_column="ts",
            denial_label_column="event_type",
            denial_label="error",
        )
        rows = clean.clean_denials(readers.read_denial_audit(self.spark, params), params)
        return rows.select(
            "event_id", "event_label", "user", "user_display_name", "event_timestamp",
            "denial_date", "year", "month", "year_month",
        )

    def scan_named_licences(self) -> DataFrame:
        params = Params(
            named=Source(f"{self.sf_dir}/customer.parquet"),
            named_user_column="c_name",
            named_licence_column="c_mktsegment",
        )
        return readers.read_named_licences(self.spark, params)

    def scan_technicians(self) -> DataFrame:
        params = Params(
            technicians=Source(f"{self.sf_dir}/supplier.parquet"), technician_name_column="s_name"
        )
        return readers.read_technicians(self.spark, params)

    def scan_exclusions(self) -> DataFrame:
        return exclusions.parse_exclusions(inputs.exclusion_texts(self.spark, self.sf_dir))

    # Cleaning

    def clean_login(self) -> DataFrame:
        return self.login

    def clean_login_lowercase(self) -> DataFrame:
        return clean.clean_login(self.login_audit, replace(PARAMS, lowercase_users=True)).select(
            "user", "user_display_name", "event_timestamp"
        )

    def clean_denials(self) -> DataFrame:
        return self.denied_rows

    def cleaning_report(self) -> DataFrame:
        return self.report

    def _login_without(self, excluded: Exclusions) -> DataFrame:
        rows = clean.clean_login(self.login_audit, replace(PARAMS, exclusions=excluded))
        return rows.select("user", "event_timestamp")

    def exclude_exact(self) -> DataFrame:
        return self._login_without(Exclusions(exact=PARAMS.exclusions.exact))

    def exclude_contains(self) -> DataFrame:
        return self._login_without(Exclusions(contains=PARAMS.exclusions.contains))

    def exclude_table(self) -> DataFrame:
        listed = inputs.exclusion_table(self.spark, self.sf_dir)
        return self._login_without(Exclusions(table=listed))

    def exclude_file_list(self) -> DataFrame:
        documents = inputs.exclusion_documents(self.spark, self.sf_dir)
        return self._login_without(Exclusions(table=exclusions.parse_exclusions(documents)))

    def exclude_contains_many(self) -> DataFrame:
        tokens = inputs.contains_tokens(self.spark, self.sf_dir)
        return self._login_without(Exclusions(table=tokens))

    def display_name(self) -> DataFrame:
        user = text.strip(F.col("User Name"))
        return self.login_audit.select(
            user.alias("user"), text.display_name(user).alias("user_display_name")
        )

    def parse_event_time(self) -> DataFrame:
        texts = self.login_audit.select(text.strip(F.col("Event Time")).alias("event_time_text"))
        for suffix in PARAMS.timestamp_suffixes:
            cut = event_time.remove_suffix(F.col("event_time_text"), suffix)
            texts = texts.withColumn("event_time_text", cut)
        return texts.select(
            "event_time_text",
            event_time.parse_event_time(F.col("event_time_text")).alias("event_timestamp"),
        )

    def filter_denial_label(self) -> DataFrame:
        return self.denial_audit.filter(F.col("Event Label") == PARAMS.denial_label).select(
            F.col("User Name").alias("user_name"),
            F.col("Event Time").alias("event_time"),
            F.col("Event Label").alias("event_label"),
        )

    def normalise_person_name(self) -> DataFrame:
        return self.technician_names.select(
            F.col("Full Name").alias("full_name"), text.name_key(F.col("Full Name")).alias("match_key")
        )

    def dedupe_first_by_key(self) -> DataFrame:
        return self.technicians

    # Login activity

    def user_login_counts(self) -> DataFrame:
        return activity.user_activity(self.daily).select(
            "user", "user_display_name", "total_logins", "active_months",
            "first_login_date", "last_login_date",
        )

    def distinct_login_days(self) -> DataFrame:
        return self.daily.groupBy("user").agg(F.count("*").alias("distinct_login_days"))

    def login_gaps(self) -> DataFrame:
        return activity.login_gaps(self.daily)

    def gap_stats(self) -> DataFrame:
        return activity.user_activity(self.daily).select(
            "user", "longest_gap_days", "median_days_between_activity"
        )

    def user_averages(self) -> DataFrame:
        return self.users.select(
            "user", "average_logins_per_month", "average_active_days_per_month",
            "percentage_months_active",
        )

    def categorise_user(self) -> DataFrame:
        return self.users.select("user", "average_active_days_per_month", "usage_category")

    def user_summary(self) -> DataFrame:
        return in_report_order("user_summary", self.users)

    def user_month_days(self) -> DataFrame:
        return activity.user_month_days(self.daily)

    def monthly_activity(self) -> DataFrame:
        """Days are staged, so that finding the months does not read the events twice."""
        daily = StagedTables(self.spark)("daily", self.daily)
        months = activity.months_of(activity.monthly_active_users(daily))
        return in_report_order("monthly_activity", activity.monthly_activity(daily, months))

    def monthly_active_users(self) -> DataFrame:
        return in_report_order("monthly_active_users", self.monthly)

    def month_labels(self) -> DataFrame:
        return self.monthly.select("month_label", "year_month")

    def category_summary(self) -> DataFrame:
        return activity.category_summary(self.flagged)

    def users_by_category(self) -> DataFrame:
        parts = [
            activity.users_by_category(self.users, name).select(F.lit(name).alias("subset"), "*")
            for name in (rules.REGULAR, rules.OCCASIONAL, rules.RARE)
        ]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def most_active_users(self) -> DataFrame:
        return activity.most_active_users(self.flagged)

    def at_risk_rare_users(self) -> DataFrame:
        return activity.at_risk_rare_users(self.flagged)

    def raw_login(self) -> DataFrame:
        return clean.in_time_order(self.login)

    # Denials

    def denial_user_counts(self) -> DataFrame:
        return self.denied.select(
            "user", "adu_denied_attempts", "adu_denied_days", "adu_denied_months",
            "first_adu_denial", "last_adu_denial",
        )

    def denial_recent_counts(self) -> DataFrame:
        return self.denied.select(
            "user", "adu_denied_attempts_last_90_days", "adu_denied_days_last_90_days"
        )

    def repeated_denial_flag(self) -> DataFrame:
        return self.denied.select("user", "is_repeated_adu_denial_user")

    def adu_user_summary(self) -> DataFrame:
        return in_report_order("adu_user_summary", self.denied)

    def adu_monthly_denials(self) -> DataFrame:
        return in_report_order("adu_monthly_denials", denials.adu_monthly_denials(self.denial_daily))

    def ranked_adu_users(self) -> DataFrame:
        return self.ranked

    def adu_user_label_key(self) -> DataFrame:
        return denials.adu_user_label_key(self.ranked)

    def raw_denials(self) -> DataFrame:
        return clean.in_time_order(self.denied_rows)

    # Matching

    def flag_technicians(self) -> DataFrame:
        return matching.flag_technicians(self.users, self.technicians).select(
            "user", "is_production_technician", "production_technician_name"
        )

    def join_users_denials(self) -> DataFrame:
        joined = matching.add_denial_flags(self.users, self.denied, PARAMS)
        return joined.select("user", *matching.FLAG_COLUMNS[2:])

    def dedicated_candidate_flag(self) -> DataFrame:
        return self.flagged.select("user", "usage_category", "adu_denied_days", "is_dedicated_licence_candidate")

    def user_summary_flagged(self) -> DataFrame:
        return in_report_order("user_summary", self.flagged)

    def highlight_flags(self) -> DataFrame:
        return with_highlight(self.flagged).select("user", "row_highlight")

    def join_technicians_users(self) -> DataFrame:
        return self.matches.select("production_technician_name", "matched_user", "user_display_name")

    def technician_review_status(self) -> DataFrame:
        return self.matches.select(
            "production_technician_name", "match_status", "usage_category", "review_status"
        )

    def technician_matches(self) -> DataFrame:
        return in_report_order("production_technician_matches", self.matches)

    def technician_review_summary(self) -> DataFrame:
        return in_report_order(
            "production_technician_review_summary", matching.technician_review_summary(self.matches)
        )

    def join_named_users(self) -> DataFrame:
        return self.analysis.select("named_user", "matched_login_user", "distinct_login_days", "active_months")

    def named_review_status(self) -> DataFrame:
        return self.analysis.select(
            "named_user", "match_status", "usage_category", "named_licence_review_status"
        )

    def named_licence_analysis(self) -> DataFrame:
        return in_report_order("named_licence_analysis", self.analysis)

    def named_licence_summary(self) -> DataFrame:
        return self.named_summary

    def named_licence_review_summary(self) -> DataFrame:
        return in_report_order(
            "named_licence_review_summary", matching.named_licence_review_summary(self.analysis)
        )

    def named_licence_no_login(self) -> DataFrame:
        return in_report_order("named_licence_no_login", matching.named_licence_no_login(self.analysis))

    def assigned_with_denials(self) -> DataFrame:
        return metrics.assigned_with_denials(self.analysis, self.denied, PARAMS)

    # Recommendations

    def recommendation_keys(self) -> DataFrame:
        subjects = recommend.review_subjects(self.flagged, self.denied, self.matches)
        return subjects.select(
            F.col("_name_key").alias("match_key"),
            "login_name",
            "denial_name",
            "technician_name",
            "technician_status",
        )

    def classify_recommendation(self) -> DataFrame:
        return self.advice.select("user", "recommendation", "rationale")

    def user_group_label(self) -> DataFrame:
        return self.advice.select("user", "user_group")

    def evidence_summary(self) -> DataFrame:
        return self.advice.select("user", "evidence_summary")

    def format_count(self) -> DataFrame:
        return self.denied.select(
            "user",
            text.count_phrase(F.col("adu_denied_attempts"), "time").alias("attempts_text"),
            text.count_phrase(F.col("adu_denied_days"), "day").alias("days_text"),
        )

    def licence_recommendations(self) -> DataFrame:
        return in_report_order("licence_recommendations", self.advice)

    def dedicated_licence_candidates(self) -> DataFrame:
        return in_report_order(
            "dedicated_licence_candidates", recommend.dedicated_licence_candidates(self.advice)
        )

    def unused_licence_evidence(self) -> DataFrame:
        return recommend.unused_licence_evidence(self.advice)

    def licence_balance(self) -> DataFrame:
        return recommend.licence_balance(self.advice)

    def recommendation_summary(self) -> DataFrame:
        return in_report_order("recommendation_summary", recommend.recommendation_summary(self.advice))

    # Metric tables

    def executive_summary(self) -> DataFrame:
        return metrics.executive_summary(
            self.daily, self.flagged, self.denied, self.matches, self.advice
        )

    def overview_metrics(self) -> DataFrame:
        return metrics.overview_metrics(self.daily, self.flagged, self.report)

    def estate_metrics(self) -> DataFrame:
        return metrics.estate_metrics(
            self.analysis, self.denied, self.advice, self.monthly, PARAMS
        )

    def named_vs_average(self) -> DataFrame:
        return metrics.named_vs_average(self.analysis, self.monthly)

    def named_vs_adu_status(self) -> DataFrame:
        return metrics.named_vs_adu_status(self.analysis, PARAMS)

    def named_allocation_comparison(self) -> DataFrame:
        return metrics.named_allocation_comparison(self.named_summary)

    def adu_executive_summary(self) -> DataFrame:
        return metrics.adu_executive_summary(self.denied, self.advice)


QUERY_NAMES = (
    "scan_login_audit", "scan_denial_audit", "scan_named_licences", "scan_technicians",
    "scan_exclusions", "clean_login", "clean_login_lowercase", "clean_denials", "cleaning_report",
    "exclude_exact", "exclude_contains", "exclude_table", "exclude_file_list", "exclude_contains_many", "display_name", "parse_event_time",
    "filter_denial_label", "normalise_person_name", "dedupe_first_by_key", "user_login_counts",
    "distinct_login_days", "login_gaps", "gap_stats", "user_averages", "categorise_user",
    "user_summary", "user_month_days", "monthly_activity", "monthly_active_users", "month_labels",
    "category_summary", "users_by_category", "most_active_users", "at_risk_rare_users",
    "raw_login", "denial_user_counts", "denial_recent_counts", "repeated_denial_flag",
    "adu_user_summary", "adu_monthly_denials", "ranked_adu_users", "adu_user_label_key",
    "raw_denials", "flag_technicians", "join_users_denials", "dedicated_candidate_flag",
    "user_summary_flagged", "highlight_flags", "join_technicians_users",
    "technician_review_status", "technician_matches", "technician_review_summary",
    "join_named_users", "named_review_status", "named_licence_analysis", "named_licence_summary",
    "named_licence_review_summary", "named_licence_no_login", "assigned_with_denials",
    "recommendation_keys", "classify_recommendation", "user_group_label", "evidence_summary",
    "format_count", "licence_recommendations", "dedicated_licence_candidates",
    "unused_licence_evidence", "licence_balance", "recommendation_summary", "executive_summary",
    "overview_metrics", "estate_metrics", "named_vs_average", "named_vs_adu_status",
    "named_allocation_comparison", "adu_executive_summary",
)


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(Review(spark, sf_dir), name)()

    run.__name__ = name
    return run


QUERIES = {name: _query(name) for name in QUERY_NAMES}


def review_inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    """The inputs of a whole run."""
    review = Review(spark, sf_dir)
    return Inputs(review.login_audit, review.denial_audit, review.named, review.technicians)
