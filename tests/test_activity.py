from __future__ import annotations

from datetime import date

from helpers import PLAIN, daily, dicts, executed_plan

from seatscope.operators import activity


def by_user(table):
    return {row["user"]: row for row in dicts(table)}


def test_user_summary_counts_gaps_and_recency(spark):
    days = daily(
        spark,
        [
            ("a (A: x)", "2026-01-01", 2), ("a (A: x)", "2026-01-04", 1), ("a (A: x)", "2026-01-05", 1),
            ("a (A: x)", "2026-03-01", 1), ("a (A: x)", "2026-03-03", 5),
            ("single", "2026-01-31", 3),
            ("cutoff", "2026-02-01", 1),
            ("last", "2026-05-02", 1),
        ],
    )
    rows = by_user(activity.user_summary(days, PLAIN))
    a = rows["a (A: x)"]
    assert a["user_display_name"] == "a"
    assert (a["total_logins"], a["distinct_login_days"], a["active_months"]) == (10, 5, 2)
    # gaps 3, 1, 55, 2: even count, the median lies between 2 and 3
    assert (a["longest_gap_days"], a["median_days_between_activity"]) == (55, 2.5)
    # four observed months: January, February, March, May
    assert (a["average_logins_per_month"], a["average_active_days_per_month"]) == (2.5, 1.25)
    assert a["percentage_months_active"] == 50.0
    assert (a["first_login_date"], a["last_login_date"]) == (date(2026, 1, 1), date(2026, 3, 3))
    single = rows["single"]
    assert (single["longest_gap_days"], single["median_days_between_activity"]) == (0, 0.0)
    # 2026-05-02 less 90 days is 2026-02-01, which still counts
    assert (rows["cutoff"]["last_90_days_active"], single["last_90_days_active"]) == (True, False)


def test_category_thresholds_are_inclusive(spark):
    rows = [("eight", f"2026-01-{day:02d}", 1) for day in range(1, 9)]
    rows += [("two", f"2026-01-{day:02d}", 1) for day in range(1, 3)]
    rows += [("one", "2026-01-01", 1)]
    users = activity.user_summary(daily(spark, rows), PLAIN)
    categories = {row["user"]: row["usage_category"] for row in dicts(users)}
    assert categories == {"eight": "Regular", "two": "Occasional", "one": "Rare"}
    assert dicts(activity.category_summary(users)) == [
        {"category": "Regular", "user_count": 1, "percentage_of_total_users": 33.33},
        {"category": "Occasional", "user_count": 1, "percentage_of_total_users": 33.33},
        {"category": "Rare", "user_count": 1, "percentage_of_total_users": 33.33},
    ]


def test_empty_activity(spark):
    none = daily(spark, [])
    users = activity.user_summary(none, PLAIN)
    assert dicts(users) == []
    assert [row["percentage_of_total_users"] for row in dicts(activity.category_summary(users))] == [None] * 3
    assert dicts(activity.monthly_active_users(none)) == []
    assert activity.monthly_activity(none, []).columns == ["user", "user_display_name", "Total"]
    assert dicts(activity.average_monthly_users(activity.monthly_active_users(none))) == [
        {"average_monthly_users": 0.0}
    ]


def test_months_matrix_and_labels(spark):
    days = daily(
        spark,
        [("u (u: x)", "2026-03-01", 4), ("u (u: x)", "2026-03-02", 1), ("v", "2025-12-31", 1)],
    )
    matrix = activity.monthly_activity(days, activity.months_of(activity.monthly_active_users(days)))
    assert {u: r["Total"] for u, r in by_user(matrix).items()} == {"u (u: x)": 2, "v": 1}
    assert matrix.columns == ["user", "user_display_name", "2025-12", "2026-03", "Total"]
    assert by_user(matrix)["u (u: x)"]["2026-03"] == 2
    assert by_user(matrix)["v"]["2026-03"] == 0
    labels = {row["year_month"]: row["month_label"] for row in dicts(activity.monthly_active_users(days))}
    assert labels == {"2025-12": "M1", "2026-03": "M2"}


def test_top_tables_sort_without_a_full_sort(spark):
    rows = [(f"user{n:03d}", f"2026-01-{1 + d:02d}", 1) for n in range(60) for d in range(1 + n % 2)]
    users = activity.user_summary(daily(spark, [*rows, ("late", "2026-12-01", 1)]), PLAIN)
    most = activity.most_active_users(users)
    assert len(dicts(most)) == 50
    assert "TakeOrderedAndProject" in executed_plan(most)
    at_risk = dicts(activity.at_risk_rare_users(users, limit=40))
    assert len(at_risk) == 40
    assert at_risk[0]["user_display_name"] == "user000"
    assert at_risk[30]["user_display_name"] == "user001"
    assert not any(row["last_90_days_active"] for row in at_risk)


def test_a_hot_user_is_combined_before_the_shuffle(spark):
    events = spark.range(20000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('u', id % 50)) AS user", "date'2026-01-01' AS login_date"
    )
    rows = by_user(activity.daily_activity(events))
    assert rows["hot"]["event_count"] == 6667
    plan = executed_plan(activity.daily_activity(events))
    assert plan.index("partial_count") > plan.index("Exchange hashpartitioning")
