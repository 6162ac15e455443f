from __future__ import annotations

from dataclasses import replace
from datetime import date

from helpers import PLAIN, daily, dicts, executed_plan, values
from pyspark.sql import functions as F

from seatscope.operators import activity, clean, denials, matching, metrics, recommend
from seatscope.operators.reshape import first_per_key
from seatscope.plans.review import in_report_order
from seatscope.sources import readers

TECHNICIANS = "production_technician_name string, production_technician_match_key string"
NAMED = "named_user string, allocated_licence string, named_user_match_key string"


def technicians(spark, *names):
    return spark.createDataFrame([(n, " ".join(n.split()).lower()) for n in names], TECHNICIANS)


def named(spark, *rows):
    return spark.createDataFrame([(n, a, " ".join(n.split()).lower()) for n, a in rows], NAMED)


def users_of(spark, *names):
    """One user per (user, active days) pair, all active in one month."""
    rows = [(user, f"2026-01-{1 + d:02d}", 1) for user, days in names for d in range(days)]
    return activity.user_summary(daily(spark, rows), PLAIN)


def denied_of(spark, *rows):
    days = [
        (user, f"2026-01-{1 + d:02d}", attempts) for user, count, attempts in rows for d in range(count)
    ]
    return denials.adu_user_summary(daily(spark, days), PLAIN)


def test_technician_flag_keeps_the_list_spelling(spark):
    users = users_of(spark, ("Andy Self (Andy Self: Acme)", 1), ("Cara Smith (Cara Smith: Acme)", 9))
    flagged = matching.flag_technicians(users, technicians(spark, "andy  self"))
    flags = {r["user_display_name"]: (r["is_production_technician"], r["production_technician_name"]) for r in dicts(flagged)}
    assert flags == {"Andy Self": (True, "andy  self"), "Cara Smith": (False, None)}


def test_match_report(spark):
    report = in_report_order(
        "production_technician_matches",
        matching.technician_matches(
            technicians(spark, "Beth Jones", "Andy Self"), users_of(spark, ("Andy Self (x)", 1))
        ),
    )
    rows = dicts(report)
    assert [row["match_status"] for row in rows] == ["Matched", "Unmatched"]
    assert [row["production_technician_name"] for row in rows] == ["Andy Self", "Beth Jones"]
    assert [row["review_status"] for row in rows] == [
        "Candidate for licence removal/reallocation",
        "No observed PLM authentication",
    ]


def test_shared_names_fan_out_in_joins(spark):
    users = users_of(spark, ("Kim Lee (1)", 9), ("Kim Lee (2)", 2), ("Other", 1))
    denied = denied_of(spark, ("kim  lee (a)", 3, 1), ("KIM LEE (b)", 1, 1))
    matches = matching.technician_matches(technicians(spark, "Kim Lee", "Nobody"), users)
    assert sorted(str(row["matched_user"]) for row in dicts(matches)) == ["Kim Lee (1)", "Kim Lee (2)", "None"]
    flagged = matching.flag_users(users, technicians(spark, "Kim Lee"), denied, PLAIN)
    assert flagged.count() == 5
    apart = matching.add_denial_flags(
        matching.flag_technicians(users, technicians(spark, "Kim Lee")), denied, PLAIN
    )
    assert apart.columns == flagged.columns
    assert sorted(map(str, dicts(apart))) == sorted(map(str, dicts(flagged)))


def test_heavy_names_are_dealt_into_parts(spark):
    """A third of users and of denied users have one name; the result is that of counting by hand."""
    params = replace(PLAIN, name_part_rows=5)
    user_names = [("Kim Lee" if i % 3 == 0 else f"Person {i}", i) for i in range(90)]
    denied_names = [("KIM  lee" if i % 3 == 0 else f"Person {i}", i) for i in range(60, 150)]
    users = users_of(spark, *((f"{name} ({i})", 1) for name, i in user_names))
    denied = denied_of(spark, *((f"{name} (d{i})", 1 + i % 4, 1 + i % 2) for name, i in denied_names))
    days = {}
    for name, i in denied_names:
        days.setdefault(" ".join(name.lower().split()), []).append((1 + i % 4) * (1 + i % 2))
    expected = sorted(
        (f"{name} ({i})", attempts) for name, i in user_names for attempts in days.get(name.lower(), [0])
    )
    flagged = matching.flag_users(users, technicians(spark, "Kim Lee"), denied, params)
    assert sorted((r["user"], r["adu_denied_attempts"]) for r in dicts(flagged)) == expected
    assert all(r["has_adu_denials"] == (r["adu_denied_attempts"] > 0) for r in dicts(flagged))
    whole = matching.flag_users(users, technicians(spark, "Kim Lee"), denied, PLAIN)
    assert sorted(map(str, dicts(whole))) == sorted(map(str, dicts(flagged)))
    apart = matching.add_denial_flags(
        matching.flag_technicians(users, technicians(spark, "Kim Lee")), denied, params
    )
    assert sorted(map(str, dicts(apart))) == sorted(map(str, dicts(flagged)))


def test_no_part_of_a_heavy_name_is_much_larger_than_the_others(spark):
    params = replace(PLAIN, name_part_rows=50)
    denied = denied_of(spark, *((f"{'Kim Lee' if i % 3 == 0 else f'P {i}'} ({i})", 1, 1) for i in range(3000)))
    users = matching.with_name_key(users_of(spark, ("Kim Lee (1)", 1), ("Other", 1)))
    left, right = matching.dealt_by_part(users, matching._denial_side(denied), params)
    sizes = {tuple(r[:2]): r[2] for r in right.groupBy("_name_key", "_name_part").count().collect()}
    heavy = [n for (name, _), n in sizes.items() if name == "kim lee"]
    assert sum(heavy) == 1000 and len(heavy) == 20 and max(heavy) < 2 * 50
    copies = {r[0]: r[1] for r in left.groupBy("_name_key").count().collect()}
    assert copies == {"kim lee": 20, "other": 1}


def test_empty_parts_of_a_heavy_name_make_no_rows(spark):
    params = replace(PLAIN, name_part_rows=1)
    denied = denied_of(spark, *((f"Kim Lee ({i})", 1, 1) for i in range(12)))
    users = users_of(spark, ("Kim Lee (x)", 1), ("Other", 1))
    flagged = matching.add_denial_flags(users, denied, params)
    assert sorted((r["user"], r["adu_denied_attempts"]) for r in dicts(flagged)) == [
        *[("Kim Lee (x)", 1)] * 12, ("Other", 0),
    ]


def test_recommendations_take_the_first_row_of_each_source(spark):
    users = users_of(spark, ("Kim Lee (1)", 3), ("Kim Lee (2)", 9))
    denied = denied_of(spark, ("kim  lee (a)", 3, 1), ("KIM LEE (b)", 1, 1))
    matches = matching.technician_matches(technicians(spark), users)
    advice = dicts(recommend.licence_recommendations(users, denied, matches, PLAIN))
    assert len(advice) == 1
    row = advice[0]
    # "Occasional" sorts before "Regular"; most denied days first
    assert (row["usage_category"], row["distinct_login_days"]) == ("Occasional", 3)
    assert (row["adu_denied_days"], row["user"]) == (3, "Kim Lee")


def test_recommendations_combine_denials_and_technicians(spark):
    users = users_of(spark, ("Ada Lovelace (Ada Lovelace: Acme)", 9), ("Tom Tech", 9))
    denied = denied_of(spark, ("Ada Lovelace (Ada Lovelace: Acme)", 10, 2), ("Tom Tech", 12, 1), ("Gone", 1, 1))
    matches = matching.technician_matches(technicians(spark, "Andy Self", "tom tech"), users)
    advice = recommend.licence_recommendations(users, denied, matches, PLAIN)
    rows = {row["user"]: row for row in dicts(advice)}
    assert {user: row["recommendation"] for user, row in rows.items()} == {
        "Ada Lovelace": "Consider dedicated licence allocation",
        "Andy Self": "Candidate for licence removal/reallocation",
        "Tom Tech": "Retain dedicated licence",
        "Gone": "Monitor",
    }
    assert rows["Andy Self"]["usage_category"] == "No observed PLM authentication"
    assert rows["Andy Self"]["last_adu_denial"] is None
    assert rows["Tom Tech"]["user_group"] == "Production Technician + ADU Denied"
    assert rows["Ada Lovelace"]["last_adu_denial"] == date(2026, 1, 10)
    candidates = dicts(recommend.dedicated_licence_candidates(advice))
    assert [row["user"] for row in candidates] == ["Ada Lovelace"]
    assert candidates[0]["justification"].startswith(
        "Regular PLM usage: 9 active days across 1 active month; "
        "ADU access blocked 20 times across 10 days. Provision is justified"
    )
    evidence = [row["count"] for row in dicts(recommend.unused_licence_evidence(advice))]
    assert evidence == [1, 1, 0]
    assert [row["user_count"] for row in dicts(recommend.licence_balance(advice))] == [1, 1]
    summary = values(
        metrics.executive_summary(
            daily(spark, [("Ada Lovelace (Ada Lovelace: Acme)", "2026-01-01", 7)]), users, denied, matches, advice
        )
    )
    assert list(summary.values()) == [7, 2, 2, 0, 0, 3, 2, 1, 1, 1, 0]
    assert values(metrics.adu_executive_summary(denied, advice)) == {
        "Users with ADU denial evidence": 3.0,
        "High-confidence dedicated licence candidates": 1.0,
        "ADU users for review": 0.0,
        "ADU users to monitor": 1.0,
    }


def test_named_licences(spark):
    users = users_of(spark, ("Ann (x)", 9), ("Bob (x)", 2), ("Cy (x)", 1))
    denied = denied_of(spark, ("Ann (x)", 12, 1), ("Bob (y)", 1, 4))
    flagged = matching.flag_users(users, technicians(spark, "Bob"), denied, PLAIN)
    shared = PLAIN.shared_licence
    holders = named(spark, ("ANN", "Full"), ("Bob", shared), ("cy", None), ("Dee", shared))
    analysis = matching.named_licence_analysis(holders, flagged)
    rows = dicts(in_report_order("named_licence_analysis", analysis))
    assert [row["named_user"] for row in rows] == ["ANN", "Dee", "Bob", "cy"]
    assert [row["named_licence_review_status"] for row in rows] == [
        "Retain named licence",
        "No observed login activity",
        "Review named licence",
        "Candidate for named-to-ADU transfer",
    ]
    assert [row["adu_denied_days"] for row in rows] == [12, 0, 1, 0]
    assert [row["is_production_technician"] for row in rows] == [False, False, True, False]
    assert [row["average_active_days_per_month"] for row in rows] == [9.0, 0.0, 2.0, 1.0]
    monthly = activity.monthly_active_users(
        daily(spark, [("a", "2026-01-01", 1), ("a", "2026-02-01", 1), ("b", "2026-02-01", 1)])
    )
    assert list(values(matching.named_licence_summary(analysis, monthly)).values()) == [4, 3, 1, 1, 1, 1, 1.5, 2.5]
    advice = recommend.licence_recommendations(
        users, denied, matching.technician_matches(technicians(spark, "Bob"), users), PLAIN
    )
    estate = metrics.estate_metrics(analysis, denied, advice, monthly, PLAIN)
    assert list(values(estate).values()) == [4, 1, 2, 1, 1, 1.5]
    assert list(values(metrics.named_vs_average(analysis, monthly)).values()) == [4, 1.5, 1]
    assert [tuple(row) for row in metrics.named_vs_adu_status(analysis, PLAIN).collect()] == [
        ("Named users", 1, 1, 1, 1),
        ("ADU-assigned users", 0, 1, 0, 1),
    ]
    no_login = dicts(matching.named_licence_no_login(analysis))
    assert [row["named_user"] for row in no_login] == ["Dee"]


def test_absent_optional_inputs(spark):
    users = users_of(spark, ("Ann (x)", 9))
    none = {
        "technicians": readers.empty_table(spark, readers.TECHNICIAN_COLUMNS),
        "named": readers.empty_table(spark, readers.NAMED_COLUMNS),
    }
    denied = denials.adu_user_summary(
        activity.daily_activity(clean.clean_denials(readers.read_denial_audit(spark, PLAIN), PLAIN), "denial_date"),
        PLAIN,
    )
    flagged = matching.flag_users(users, none["technicians"], denied, PLAIN)
    row = dicts(flagged)[0]
    assert row["adu_denied_attempts"] == 0 and row["last_adu_denial"] is None
    assert row["is_repeated_adu_denial_user"] is False and row["has_adu_denials"] is False
    assert row["is_production_technician"] is False
    matches = matching.technician_matches(none["technicians"], flagged)
    analysis = matching.named_licence_analysis(none["named"], flagged)
    advice = recommend.licence_recommendations(users, denied, matches, PLAIN)
    monthly = activity.monthly_active_users(daily(spark, [("a", "2026-01-01", 1)]))
    assert (dicts(matches), dicts(analysis), dicts(advice)) == ([], [], [])
    # the monthly average counts as 0 in the named table only
    assert list(values(matching.named_licence_summary(analysis, monthly)).values()) == [0] * 8
    assert values(metrics.named_vs_average(analysis, monthly))["Average monthly PLM users"] == 1.0
    assert [row["count"] for row in dicts(recommend.unused_licence_evidence(advice))] == [0, 0, 0]


def test_first_row_per_key_is_limited_before_the_shuffle(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
        (5000 - F.col("id")).alias("n"),
    )
    first = first_per_key(rows, "k", [F.asc("n")])
    assert {row["k"]: row["n"] for row in dicts(first)}["hot"] == 2
    plan = executed_plan(first)
    assert "WindowGroupLimit" in plan
    assert plan.rindex("WindowGroupLimit") > plan.index("Exchange hashpartitioning")


def test_common_names_can_be_split_in_flag_joins(spark):
    users = users_of(spark, ("Ann (x)", 9))
    flagged = matching.flag_users(users, technicians(spark, "Bob"), denied_of(spark, ("Ann (x)", 1, 1)), PLAIN)
    plan = executed_plan(flagged)
    assert "FullOuter" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_assigned_with_denials_counts_without_pairs(spark):
    analysis = spark.createDataFrame([("Kim", "S")] * 300 + [("kim", "S"), ("Lee", "S"), (None, "S"), ("Kim", "T")], "named_user string, allocated_licence string")
    denied = spark.createDataFrame([("Kim",)] * 200 + [("LEE",), (None,)], "user_display_name string")
    counted = metrics.assigned_with_denials(analysis, denied, replace(PLAIN, shared_licence="S"))
    assert dicts(counted) == [{"assigned_with_denials": 300 * 200 + 1}]
    assert dicts(metrics.assigned_with_denials(analysis.limit(0), denied, PLAIN)) == [{"assigned_with_denials": 0}]
