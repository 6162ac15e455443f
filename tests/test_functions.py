from __future__ import annotations

import re
import unicodedata
from datetime import datetime

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seatscope.functions import event_time, rules, text
from seatscope.params import Params

FORMAT = "%Y-%m-%d %H:%M:%S"
TIMES = [
    "2026-04-05 01:02:03", "2026-4-5 1:2:3", "2026-04-05  01:02:03", "2026-04-05\t01:02:03",
    "2026-04-05T01:02:03", "2026-04-05 01:02:60", "2026-12-31 23:59:61", "2026-04-05 01:02:62",
    "2026-04-05 24:00:00", "9999-01-01 00:00:00", "1677-09-21 00:12:43", "1677-09-21 00:12:44",
    "2262-04-11 23:47:16", "2262-04-11 23:47:17", "2026-02-30 00:00:00", "2026-04-05 01:02:03Z",
    "2026-04-05 01:02:03+01:00", "+2026-04-05 01:02:03", "2026-04-05 01:02", "2026-04-05",
    "2026-04-05 010203", "2026-04-05 01:02:03.5", "26-04-05 01:02:03", "2026-004-05 01:02:03",
    " 2026-04-05 01:02:03", "2026-04-05 01:02:03 ", "", "2026/04/05 01:02:03", "1969-12-31 23:59:59",
    "2026-03-29 01:30:00", "not-a-timestamp",
]


def column(spark, items, kind="string"):
    return spark.createDataFrame(list(enumerate(items)), f"i int, c {kind}").orderBy("i")


def evaluate(spark, items, function, kind="string"):
    return [row[0] for row in column(spark, items, kind).select(function(F.col("c"))).collect()]


@pytest.mark.parametrize("zone", ["UTC", "Europe/London"])
def test_event_times_follow_strict_parsing_in_any_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        parsed = evaluate(spark, TIMES, event_time.parse_event_time)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    expected = pd.to_datetime(pd.Series(TIMES, dtype="string"), format=FORMAT, errors="coerce")
    assert parsed == [None if pd.isna(value) else value.to_pydatetime() for value in expected]


def test_suffixes_are_removed_once_in_order(spark):
    def cut(column):
        for suffix in (" BST", " GMT"):
            column = event_time.remove_suffix(column, suffix)
        return column

    given_texts = ["X BST", "X GMT", "X GMT BST", "X BST GMT", "X BST BST", "X", None]
    assert evaluate(spark, given_texts, cut) == ["X", "X", "X", "X BST", "X BST", "X", None]


def test_display_name(spark):
    names = [
        "Jane Doe (Jane Doe: Acme)", "siteadmin", "A (b) (c)", "x(y)", "a\nb (x)", "a \t(x", "(foo) (x)",
    ]

    def expected(value):
        match = re.match(r"^(.*?)\s+\(", value)
        return match.group(1).strip() if match else value.strip()

    assert evaluate(spark, names, text.display_name) == [expected(name) for name in names]


def test_name_key_is_case_and_spacing_insensitive(spark):
    names = [
        "  Andy   Self ", "ANDY SELF", "Straße", "STRASSE", "ẞx", "ſtop", "ﬁn", "ΣΑΣ", "\x1c a\x1fb",
        " a 　b ", "µ",
    ]
    expected = [re.sub(r"\s+", " ", name.strip().casefold()) for name in names]
    assert evaluate(spark, names, text.name_key) == expected
    assert evaluate(spark, [None], text.name_key) == [""]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="aB 1\t  \x1dé!~\x7f", max_size=6), min_size=1, max_size=30))
def test_strip_matches_python(spark, items):
    assert evaluate(spark, items, text.strip) == [item.strip() for item in items]


def test_whitespace_set_and_class_agree():
    everything = {chr(code) for code in range(0x110000) if chr(code).isspace()}
    assert set(text.WHITESPACE) == everything
    assert {c for c in everything if re.fullmatch(text.WHITESPACE_CLASS, c)} == everything


def test_fold_of_parameter_equals_fold_of_column(spark):
    items = ["Straße", "ẞ", "ﬃ", "ΣΑΣ", "Plain Text", "ꭰ", "ŉa", "ᾳ", "ẘx ﬓ"]
    assert evaluate(spark, items, text.fold) == [text.fold_text(item) for item in items]


def test_every_character_folds_as_in_python(spark):
    every = [chr(code) for code in range(1, 0x110000) if not 0xD800 <= code <= 0xDFFF]
    assert [c for c in every if text.fold_text(c) != c.casefold()] == []
    known = [c for c in every if unicodedata.category(c) != "Cn"]  # a newer Java knows some more letters
    folded = evaluate(spark, known, text.fold)
    wrong = [c for c, f in zip(known, folded) if f != c.casefold()]
    assert wrong == []


def test_round2_is_half_even_after_scaling(spark):
    numbers = [1.015, 2.675, 0.125, 0.135, 33.333333, -1.005]
    expected = pd.Series(numbers).round(2).tolist()
    assert evaluate(spark, numbers, text.round2, "double") == expected


def test_count_phrase(spark):
    assert evaluate(spark, [0, 1, 2], lambda c: text.count_phrase(c, "day"), "long") == [
        "0 days", "1 day", "2 days",
    ]


def test_usage_category_boundaries(spark):
    averages = [8.0, 7.99, 2.0, 1.99]
    assert evaluate(spark, averages, lambda c: rules.usage_category(c, Params()), "double") == [
        "Regular", "Occasional", "Occasional", "Rare",
    ]


def test_month_of(spark):
    stamps = [datetime(2026, 1, 31, 23, 59, 59), datetime(1999, 12, 1)]
    assert evaluate(spark, stamps, event_time.month_of, "timestamp_ntz") == ["2026-01", "1999-12"]


RULES = [
    # category, technician, status, denials, attempts, days -> recommendation
    ((None, True, "Unmatched", True, 20, 15), rules.REMOVE_OR_REALLOCATE),
    ((None, True, None, False, 0, 0), rules.REMOVE_OR_REALLOCATE),
    (("Rare", True, "Matched", True, 20, 15), rules.REMOVE_OR_REALLOCATE),
    (("Occasional", True, "Matched", True, 20, 15), rules.REVIEW_BUSINESS_NEED),
    (("Regular", True, "Matched", True, 20, 15), rules.RETAIN_DEDICATED),
    (("Regular", False, None, True, 15, 10), rules.ALLOCATE_DEDICATED),
    (("Occasional", False, None, True, 15, 10), rules.ALLOCATE_DEDICATED),
    (("Rare", False, None, True, 15, 10), rules.REVIEW_NEED),
    ((None, False, None, True, 15, 10), rules.REVIEW_NEED),
    (("Regular", False, None, True, 3, 1), rules.REVIEW_NEED),
    (("Regular", False, None, True, 2, 2), rules.REVIEW_NEED),
    (("Regular", False, None, True, 2, 1), rules.MONITOR),
    (("Regular", False, None, False, 0, 0), rules.NO_ACTION),
]


def test_recommendation_rule_order(spark):
    table = spark.createDataFrame(
        [(i, *case) for i, (case, _) in enumerate(RULES)],
        "i int, c string, t boolean, s string, d boolean, a long, n long",
    )
    outcome = rules.recommendation(
        category=F.col("c"), is_technician=F.col("t"), technician_status=F.col("s"),
        has_denials=F.col("d"), denied_attempts=F.col("a"), denied_days=F.col("n"), params=Params(),
    )
    got = [row[0] for row in table.orderBy("i").select(outcome["recommendation"]).collect()]
    assert got == [label for _, label in RULES]


def test_evidence_and_group_wording(spark):
    table = spark.createDataFrame(
        [
            (0, "Rare", 1, 1, 1, 1, None),
            (1, None, 0, 0, 3, 2, "Unmatched"),
            (2, None, 0, 0, 0, 0, None),
        ],
        "i int, c string, l long, m long, a long, d long, s string",
    ).orderBy("i")
    evidence = rules.evidence_summary(
        category=F.col("c"), login_days=F.col("l"), active_months=F.col("m"),
        denied_attempts=F.col("a"), denied_days=F.col("d"), technician_status=F.col("s"),
    )
    assert [row[0] for row in table.select(evidence).collect()] == [
        "Rare PLM usage: 1 active day across 1 active month; ADU access blocked 1 time across 1 day",
        "ADU access blocked 3 times across 2 days; "
        "No matching PLM authentication record found for Production Technician",
        "",
    ]
    flags = spark.createDataFrame([(True, True), (True, False), (False, True)], "t boolean, d boolean")
    groups = [row[0] for row in flags.select(rules.user_group(F.col("t"), F.col("d"))).collect()]
    assert groups == ["Production Technician + ADU Denied", "Production Technician", "ADU Denied"]


def test_highlight_precedence(spark):
    flags = spark.createDataFrame([(True, True), (True, False), (False, False)], "t boolean, d boolean")
    marks = [row[0] for row in flags.select(rules.row_highlight(F.col("t"), F.col("d"))).collect()]
    assert marks == ["dedicated", "technician", None]
