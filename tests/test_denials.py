from __future__ import annotations

from helpers import PLAIN, daily, denial_audit, dicts

from seatscope.operators import activity, clean, denials


def test_summary_and_months_of_an_audit(spark):
    label = PLAIN.denial_label
    raw = denial_audit(
        spark,
        [
            (label, "2026-04-15 11:00:00 BST", "Ada Lovelace (Ada Lovelace: Acme)"),
            (label, "2026-04-16 12:00:00 BST", "Ada Lovelace (Ada Lovelace: Acme)"),
            ("Other Event", "2026-04-16 12:30:00 BST", "Grace Hopper (Grace Hopper: Acme)"),
        ],
    )
    days = activity.daily_activity(clean.clean_denials(raw, PLAIN), "denial_date")
    summary = dicts(denials.adu_user_summary(days, PLAIN))
    assert len(summary) == 1
    assert summary[0]["user_display_name"] == "Ada Lovelace"
    assert (summary[0]["adu_denied_attempts"], summary[0]["adu_denied_days"]) == (2, 2)
    assert summary[0]["is_repeated_adu_denial_user"] is True
    assert dicts(denials.adu_monthly_denials(days)) == [
        {
            "month_label": "M1",
            "year_month": "2026-04",
            "adu_denied_attempts": 2,
            "adu_denied_users": 1,
            "adu_denied_days": 2,
        }
    ]


def test_recent_counts_and_repeated_flag(spark):
    days = daily(
        spark,
        [
            ("old", "2026-01-30", 2), ("edge", "2026-01-31", 2), ("edge", "2026-01-01", 1),
            ("new", "2026-05-01", 1), ("burst", "2026-05-01", 3),
        ],
    )
    rows = {row["user"]: row for row in dicts(denials.adu_user_summary(days, PLAIN))}
    recent = {
        user: (row["adu_denied_attempts_last_90_days"], row["adu_denied_days_last_90_days"])
        for user, row in rows.items()
    }
    assert recent == {"old": (0, 0), "edge": (2, 1), "new": (1, 1), "burst": (3, 1)}
    repeated = {user: row["is_repeated_adu_denial_user"] for user, row in rows.items()}
    assert repeated == {"old": False, "edge": True, "new": False, "burst": True}
    assert rows["edge"]["adu_denied_months"] == 1


def test_days_of_a_month_are_counted_once(spark):
    rows = [(f"u{n}", f"2026-01-{1 + n % 31:02d}", 1) for n in range(200)]
    month = dicts(denials.adu_monthly_denials(daily(spark, rows)))[0]
    assert (month["adu_denied_attempts"], month["adu_denied_users"], month["adu_denied_days"]) == (200, 200, 31)


def test_ranking(spark):
    rows = [(f"u{n:02d}", f"2026-01-{1 + d:02d}", 1) for n in range(25) for d in range(1 + n % 5)]
    ranked = dicts(denials.ranked_adu_users(denials.adu_user_summary(daily(spark, rows), PLAIN)))
    assert len(ranked) == 20
    by_label = {row["user_label"]: row["user"] for row in ranked}
    assert (by_label["U1"], by_label["U6"], by_label["U20"]) == ("u04", "u03", "u21")
    assert dicts(denials.ranked_adu_users(denials.adu_user_summary(daily(spark, []), PLAIN))) == []
