from __future__ import annotations

from dataclasses import replace
from pathlib import Path

import pandas as pd
import pytest
from helpers import audit, denial_audit, dicts
from pyspark.sql import functions as F

from seatscope.params import Exclusions, Params, Source
from seatscope.plans import review
from seatscope.plans.rules_text import category_rules, rules_and_assumptions, threshold_explanation
from seatscope.session import StagedTables, shared_folder
from seatscope.sources.writers import current_run, read_result

CANDIDATE = "Ada Lovelace (Ada Lovelace: Acme)"


@pytest.fixture(scope="module")
def params(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("review")
    logins = [(CANDIDATE, f"2026-01-{day:02d} 08:00:00 GMT") for day in range(1, 10)]
    logins += [("Andy Self", "2026-02-03 08:00:00 GMT"), (" ", "2026-01-01 00:00:00"), ("x", "junk")]
    audit(spark, logins).coalesce(1).write.csv(str(base / "login"), header=True)
    label = Params().denial_label
    denials = [(label, f"2026-01-{day:02d} 09:00:00 GMT", CANDIDATE) for day in range(1, 13)]
    denial_audit(spark, denials).coalesce(1).write.csv(str(base / "denials"), header=True)
    (base / "technicians.csv").write_text("Full Name\nAndy Self\nBeth Jones\n")
    (base / "named.csv").write_text("User,Allocated License\nAda Lovelace,Full\nNobody,Full\n")
    return Params(
        login=Source(str(base / "login"), "csv"),
        denials=Source(str(base / "denials"), "csv"),
        technicians=Source(str(base / "technicians.csv")),
        named=Source(str(base / "named.csv")),
        output_path=str(base / "out"),
        exclusions=Exclusions(),
        occasional_min_active_days=2.0,
        regular_min_active_days=4.5,
    )


@pytest.fixture(scope="module")
def written(spark, params):
    review.run_review(spark, params)
    return lambda name: read_result(spark, params.output_path, name)


def test_every_section_table_is_written(spark, params, written):
    names = {name for tables in review.REPORT_SECTIONS.values() for name in tables}
    for name in sorted(names | set(review.REPORT_ORDER)):
        assert written(name).columns


def test_written_results(written):
    assert [row.asDict() for row in written("cleaning_report").collect()] == [
        {
            "input_rows": 12,
            "output_rows": 10,
            "dropped_missing_user_rows": 1,
            "dropped_invalid_timestamp_rows": 1,
            "dropped_excluded_user_rows": 0,
        }
    ]
    users = {row["user_display_name"]: row for row in dicts(written("user_summary"))}
    assert users["Ada Lovelace"]["usage_category"] == "Regular"
    assert users["Ada Lovelace"]["row_highlight"] == "dedicated"
    assert users["Andy Self"]["row_highlight"] == "technician"
    advice = {row["user"]: row["recommendation"] for row in dicts(written("licence_recommendations"))}
    assert advice == {
        "Ada Lovelace": "Consider dedicated licence allocation",
        "Andy Self": "Candidate for licence removal/reallocation",
        "Beth Jones": "Candidate for licence removal/reallocation",
    }
    overview = {row["metric"]: row["value"] for row in dicts(written("overview_metrics"))}
    assert overview["date_range_start"] == "2026-01-01" and overview["date_range_end"] == "2026-02-03"
    assert overview["average_logins_per_user"] == "5.0" and overview["input_rows"] == "12"
    assert written("overall_metrics").count() == 5
    assert written("raw_login").count() == 10 and written("raw_denials").count() == 12
    assert written("monthly_activity").columns == ["user", "user_display_name", "2026-01", "2026-02", "Total"]


def test_unstaged_tables_equal_written_ones(spark, params, written):
    tables = review.build_tables(spark, review.read_inputs(spark, params), params)
    for name in ("named_licence_analysis", "licence_recommendations", "executive_summary", "estate_metrics"):
        assert sorted(map(str, tables[name].collect())) == sorted(map(str, written(name).collect()))


def test_login_only_review(spark, params):
    alone = Params(login=params.login, exclusions=Exclusions())
    tables = review.build_tables(spark, review.read_inputs(spark, alone), alone)
    assert tables["user_summary"].count() == 2
    assert tables["licence_recommendations"].isEmpty()
    assert tables["adu_monthly_denials"].isEmpty()
    assert tables["named_licence_summary"].count() == 8


def test_rules_carry_the_parameters(spark):
    rules = dicts(category_rules(spark, Params(regular_min_active_days=9.5)))
    assert [row["threshold_value"] for row in rules] == [9.5, 2.0, 2.0]
    text = dicts(rules_and_assumptions(spark, Params()))
    assert len(text) == 8
    assert text[1]["rule_or_assumption"] == "Regular: average_active_days_per_month >= 8.0"
    assert "at least 2 denied days or at least 3 denied attempts" in text[4]["rule_or_assumption"]


def test_threshold_text_carries_the_parameter(spark):
    text = dicts(threshold_explanation(spark, Params(dedicated_denied_days=7)))
    assert len(text) == 2 and all(" 7 " in row["details"] for row in text)


def test_staged_tables_use_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == named
    staged = StagedTables(spark)("numbers", spark.range(3))
    assert sorted(row["id"] for row in staged.collect()) == [0, 1, 2]
    assert staged.inputFiles()[0].startswith(f"file://{named}/seatscope-")


def test_a_run_removes_what_it_staged(spark, params, written):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("seatscope-*"))
    review.run_review(spark, replace(params, output_path=f"{params.output_path}-again"))
    with pytest.raises(ValueError):
        review.run_review(spark, params, "xlsx")
    assert set(folder.glob("seatscope-*")) == before


def test_source_rows_are_written_by_month_in_order(spark, params, written):
    folder = Path(current_run(spark, params.output_path), "raw_login")
    months = sorted(path.name for path in folder.glob("year_month=*"))
    assert months == ["year_month=2026-01", "year_month=2026-02"]
    (part,) = Path(folder, months[0]).glob("*.parquet")
    stamps = pd.read_parquet(part)["event_timestamp"].tolist()
    assert len(stamps) == 9 and stamps == sorted(stamps)


def test_a_run_stopped_midway_leaves_the_published_review(spark, params, written, monkeypatch):
    folder = Path(params.output_path)
    run, files = current_run(spark, params.output_path), sorted(map(str, folder.rglob("*")))

    def fail(*_):
        return spark.range(5).select(F.raise_error(F.lit("no such table")).alias("metric"))

    monkeypatch.setattr(review.metrics, "adu_executive_summary", fail)
    with pytest.raises(Exception, match="no such table"):
        review.run_review(spark, params)
    assert current_run(spark, params.output_path) == run
    assert sorted(map(str, folder.rglob("*"))) == files
    assert written("user_summary").count() == 2
    with pytest.raises(FileNotFoundError):
        current_run(spark, f"{params.output_path}-none")


@pytest.mark.parametrize("listed", [None, [("contains", "ANDY"), ("exact", "nobody")]])
def test_a_run_reads_each_raw_audit_once(spark, params, listed):
    """Every table of a staged run is built without the raw files, but for the one staged pass over each."""
    table = listed and spark.createDataFrame(listed, "kind string, value string")
    given = replace(params, exclusions=Exclusions(table=table))
    staged, reading = StagedTables(spark), []

    def stage(name, rows):
        reading.extend(name for path in rows.inputFiles() if "/login/" in path or "/denials/" in path)
        return staged(name, rows)

    tables = review.build_tables(spark, review.read_inputs(spark, given), given, stage)
    assert sorted(set(reading)) == ["denial_rows", "login_rows"]
    for name, result in tables.items():
        assert not [path for path in result.inputFiles() if "/login/" in path or "/denials/" in path], name
    report = tables["cleaning_report"].first()
    assert report["dropped_excluded_user_rows"] == (1 if listed else 0) and report["input_rows"] == 12
    assert tables["raw_login"].count() == report["output_rows"] == (9 if listed else 10)
    staged.remove()
