from __future__ import annotations

import random

from dataclasses import replace
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from helpers import PLAIN, audit, denial_audit, dicts, executed_plan

from seatscope.operators import activity, clean
from seatscope.sources import readers
from seatscope.params import Exclusions, Params

LABEL = Params().denial_label


def test_parses_times_and_derives_fields(spark):
    raw = audit(
        spark,
        [
            ("Alice Smith (Alice Smith: Acme)", "2026-04-15 11:11:26 BST"),
            ("Bob Jones (Bob Jones: Acme)", "2026-01-03 08:05:00 GMT"),
        ],
    )
    rows = sorted(dicts(clean.clean_login(raw, PLAIN)), key=lambda row: row["user"])
    assert [row["event_timestamp"] for row in rows] == [
        datetime(2026, 4, 15, 11, 11, 26),
        datetime(2026, 1, 3, 8, 5),
    ]
    assert [row["login_date"] for row in rows] == [date(2026, 4, 15), date(2026, 1, 3)]
    assert [row["year_month"] for row in rows] == ["2026-04", "2026-01"]
    assert [row["user_display_name"] for row in rows] == ["Alice Smith", "Bob Jones"]
    assert [(row["year"], row["month"]) for row in rows] == [(2026, 4), (2026, 1)]


DIRTY = [
    ("Included User (Included User: Acme)", "2026-04-15 11:11:26 BST"),
    ("WPS Test (WPS Test: Acme)", "2026-04-15 11:08:17 BST"),
    ("Bad Timestamp (Bad Timestamp: Acme)", "not-a-timestamp"),
    ("   ", "2026-04-15 10:58:55 BST"),
]


def test_drops_and_counts_each_row_once(spark):
    params = Params(exclusions=Exclusions(exact=("WPS Test (WPS Test: Acme)",)))
    raw = audit(spark, [*DIRTY, (None, "junk"), ("WPS Test (WPS Test: Acme)", "junk")])
    kept = dicts(clean.clean_login(raw, params))
    assert [row["user"] for row in kept] == ["Included User (Included User: Acme)"]
    expected = {
        "input_rows": 6,
        "output_rows": 1,
        "dropped_missing_user_rows": 2,
        "dropped_invalid_timestamp_rows": 1,
        "dropped_excluded_user_rows": 2,
    }
    assert dicts(clean.cleaning_report(raw, params)) == [expected]
    states = clean.login_day_states(clean.after_exclusions(clean.login_rows(raw, params), params))
    assert dicts(clean.report_of_states(states)) == [expected]
    assert dicts(clean.kept_days(states)) == [
        {
            "user": "Included User (Included User: Acme)",
            "activity_date": date(2026, 4, 15),
            "event_count": 1,
        }
    ]


def test_other_columns_pass_through_in_order(spark):
    raw = spark.createDataFrame(
        [("x.y", "2026-01-01 00:00:00", "u", "10.0.0.1")],
        "`a.b` string, `Event Time` string, `User Name` string, ip string",
    )
    assert clean.clean_login(raw, PLAIN).columns == [
        "a.b", "event_time_raw", "user", "ip", "user_display_name", "event_time_text",
        "event_timestamp", "login_date", "year", "month", "year_month",
    ]


def test_missing_columns_are_named_in_order(spark):
    with pytest.raises(ValueError, match="Missing required columns: Event Time, User Name"):
        clean.clean_login(spark.range(1), PLAIN)
    with pytest.raises(ValueError, match="Missing required ADU columns: Event Label, Event Time"):
        clean.clean_denials(spark.range(1).selectExpr("'u' AS `User Name`"), PLAIN)


def test_exclusions_fold_case_and_take_tokens_literally(spark):
    raw = audit(
        spark,
        [(user, "2026-01-01 00:00:00") for user in ("STRASSE", "a.b test", "axb test", "100% x", "keep")],
    )
    params = replace(PLAIN, exclusions=Exclusions(exact=("straße",), contains=("A.B", "0%")))
    kept = [row["user"] for row in dicts(clean.clean_login(raw, params))]
    assert sorted(kept) == ["axb test", "keep"]


def test_exclusion_table_gives_the_same_rows_as_literals(spark):
    users = ["Straße", "svc-backup", "my SVC account", "keep", "x", "ab", "b", None, " "]
    raw = audit(spark, [(user, "2026-01-01 00:00:00") for user in users for _ in range(3)])
    exact, contains = ("STRASSE", "X"), ("svc", "AB", "longer than any user name here")
    listed = [("exact", value) for value in exact] + [("contains", value) for value in contains]
    table = spark.createDataFrame(listed, "kind string, value string")
    inline = replace(PLAIN, exclusions=Exclusions(exact=exact, contains=contains))
    joined = replace(PLAIN, exclusions=Exclusions(table=table))
    for params in (inline, joined):
        kept = sorted(row["user"] for row in dicts(clean.clean_login(raw, params)))
        assert kept == ["b"] * 3 + ["keep"] * 3
    assert dicts(clean.cleaning_report(raw, inline)) == dicts(clean.cleaning_report(raw, joined))


def test_exclusion_table_with_only_one_kind_or_empty_token(spark):
    raw = audit(spark, [("a", "2026-01-01 00:00:00"), ("b", "2026-01-01 00:00:00")])
    for listed, left in (([("exact", "A")], ["b"]), ([("contains", "")], []), ([], ["a", "b"])):
        table = spark.createDataFrame(listed, "kind string, value string")
        params = replace(PLAIN, exclusions=Exclusions(table=table))
        assert sorted(row["user"] for row in dicts(clean.clean_login(raw, params))) == left


def test_lowercase_option(spark):
    raw = audit(spark, [("  Ann LEE (x)", "2026-01-01 00:00:00")])
    row = dicts(clean.clean_login(raw, replace(PLAIN, lowercase_users=True)))[0]
    assert (row["user"], row["user_display_name"]) == ("ann lee (x)", "ann lee")


def test_typed_times_are_taken_as_they_are(spark):
    raw = spark.createDataFrame(
        [("u", datetime(2026, 1, 1)), ("u", datetime(2026, 1, 2, 3, 4, 5, 600))],
        "`User Name` string, `Event Time` timestamp_ntz",
    )
    stamps = sorted(row["event_timestamp"] for row in dicts(clean.clean_login(raw, PLAIN)))
    assert stamps == [datetime(2026, 1, 1), datetime(2026, 1, 2, 3, 4, 5, 600)]


def test_denials_keep_the_exact_label_only(spark):
    raw = denial_audit(
        spark,
        [
            (LABEL, "2026-04-15 11:00:00 BST", "Ada Lovelace (Ada Lovelace: Acme)"),
            (LABEL, "bad", "Ada Lovelace (Ada Lovelace: Acme)"),
            (LABEL.upper(), "2026-04-15 11:00:00 BST", "Grace Hopper (Grace Hopper: Acme)"),
            (f" {LABEL}", "2026-04-15 11:00:00 BST", "Grace Hopper (Grace Hopper: Acme)"),
            (None, "2026-04-15 11:00:00 BST", "Grace Hopper (Grace Hopper: Acme)"),
            (LABEL, "2026-04-15 11:00:00 BST", " "),
        ],
    )
    rows = dicts(clean.clean_denials(raw, PLAIN))
    assert [row["user_display_name"] for row in rows] == ["Ada Lovelace"]
    assert rows[0]["denial_date"] == date(2026, 4, 15)


def test_input_columns_named_like_results_pass_through(spark):
    raw = spark.createDataFrame(
        [("u", "2026-01-01 00:00:00", "r", 1, "f")],
        "`User Name` string, `Event Time` string, row_state string, is_excluded int, _folded_user string",
    )
    params = replace(PLAIN, exclusions=Exclusions(exact=("x",)))
    row = dicts(clean.clean_login(raw, params))[0]
    assert (row["row_state"], row["is_excluded"], row["_folded_user"]) == ("r", 1, "f")
    with pytest.raises(ValueError, match="Reserved column names: __seatscope_row_state"):
        clean.clean_login(raw.withColumnRenamed("row_state", "__seatscope_row_state"), params)


def test_denials_in_the_shape_of_results_are_cleaned_too(spark):
    raw = denial_audit(spark, [(LABEL, "2026-04-15 11:00:00", "Ada"), ("Other", "2026-04-15 11:00:00", "Ada")])
    shaped = clean.clean_denials(raw, PLAIN)
    again = replace(
        PLAIN, denial_user_column="user", denial_timestamp_column="event_time_raw", denial_label_column="event_label"
    )
    blank = shaped.withColumn("user", F.lit(" "))
    assert clean.clean_denials(shaped.unionByName(blank), again).count() == 1
    with pytest.raises(ValueError, match="Missing required ADU columns"):
        clean.clean_denials(shaped, PLAIN)


def test_instants_are_read_in_the_named_zone(spark):
    rows = spark.sql("SELECT 'u' AS `User Name`, TIMESTAMP'2026-07-01 23:30:00Z' AS `Event Time`")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for session_zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", session_zone)
            for zone, hour in (("UTC", 23), ("Europe/Paris", 1)):
                row = clean.clean_login(rows, replace(PLAIN, time_zone=zone)).first()
                assert row["event_timestamp"].hour == hour
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_denials_do_not_lowercase(spark):
    raw = denial_audit(spark, [(LABEL, "2026-04-15 11:00:00", "Ada")])
    assert dicts(clean.clean_denials(raw, replace(PLAIN, lowercase_users=True)))[0]["user"] == "Ada"
    absent = clean.clean_denials(readers.read_denial_audit(spark, PLAIN), PLAIN)
    assert absent.columns == [
        "event_label", "event_time_raw", "user", "user_display_name", "event_time_text",
        "event_timestamp", "denial_date", "year", "month", "year_month",
    ]
    assert absent.isEmpty()


def test_rows_in_time_order_keep_input_order_among_equals(spark):
    raw = spark.createDataFrame(
        [("b", "2026-01-02 00:00:00", 1), ("a", "2026-01-02 00:00:00", 2), ("b", "2026-01-01 00:00:00", 3),
         ("a", "2026-01-02 00:00:00", 4)],
        "`User Name` string, `Event Time` string, n int",
    ).coalesce(1)
    rows = dicts(clean.in_time_order(clean.clean_login(raw, PLAIN)))
    assert [row["n"] for row in rows] == [3, 2, 4, 1]


def test_each_time_is_parsed_once_per_row(spark, tmp_path):
    audit(spark, DIRTY).write.parquet(str(tmp_path / "audit"))
    raw = spark.read.parquet(str(tmp_path / "audit"))
    plan = executed_plan(activity.daily_activity(clean.clean_login(raw, PLAIN)))
    parsing = [line for line in plan.splitlines() if "RLIKE" in line]
    assert len(parsing) == 1 and "Generate inline" in parsing[0]
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_contains_by_rarest_part_equals_a_plain_search(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("abcdéß 東") for _ in range(rng.randrange(0, 14))) for _ in range(300)]
    tokens = [name[i : i + n] for name in names[::9] for n in (1, 2, 3, 4, 7) for i in (0, 2)]
    tokens = sorted({t for t in tokens if t} - set("abcdé 東")) + ["zz", "longer than any of the texts"]
    users = spark.createDataFrame([(n,) for n in names] + [(None,)], "user string")
    for some in (tokens, tokens[::7], ["ab"], ["é"], [""], []):
        table = spark.createDataFrame([("contains", t) for t in some], "kind string, value string")
        got = {row["user"] for row in clean.excluded_users(users, table).collect()}
        assert got == {n for n in names if any(t.casefold() in n.casefold() for t in some)}


def test_contains_keeps_rows_linear_in_the_text(spark):
    """However many lengths the tokens have, a text is listed under its characters only."""
    users = spark.createDataFrame([("x" * 40 + f"{i:09d}" + "y" * 40,) for i in range(50)], "user string")
    table = spark.createDataFrame([("contains", "x" * n + "000000007") for n in range(3, 41)], "kind string, value string")
    result = clean.excluded_users(users, table)
    assert result.count() == 1
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "CartesianProduct" not in plan
