"""Plan checks over every registered query."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from helpers import executed_plan

from harness.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
# Operators that pair every row with every row, or leave the JVM.
UNWANTED = (
    "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
    "MapInPandas", "FlatMapGroupsInPandas", "Scan ExistingRDD",
)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_pairing_and_no_python(spark, name):
    plan = executed_plan(QUERIES[name](spark, SF_DIR))
    assert [word for word in UNWANTED if word in plan] == []


def test_only_needed_columns_and_rows_are_scanned(spark):
    plan = executed_plan(QUERIES["scan_denial_audit"](spark, SF_DIR))
    assert "EqualTo(event_type,error)" in plan
    schema = re.search(r"ReadSchema: (\S+)", executed_plan(QUERIES["user_summary"](spark, SF_DIR))).group(1)
    assert schema == "struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>"


def test_daily_shuffle_is_reused_within_a_query(spark):
    table = QUERIES["executive_summary"](spark, SF_DIR)
    table.collect()
    assert "ReusedExchange" in executed_plan(table)


def test_sources_keep_to_dataframes():
    root = Path(__file__).resolve().parent.parent / "seatscope"
    paths = [path for path in root.rglob("*.py") if "llm" not in path.parts]
    code = "\n".join(path.read_text(encoding="utf-8") for path in paths)
    for word in ("localCheckpoint", "crossJoin", ".rdd", "toPandas", "broadcast(", "udf("):
        assert word not in code
