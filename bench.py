"""Time the headline queries and one whole review run; prints one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid
from dataclasses import replace
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from harness import inputs  # noqa: E402
from harness.queries import QUERIES, review_inputs  # noqa: E402
from seatscope.plans.review import write_review  # noqa: E402
from seatscope.session import configure, shared_folder  # noqa: E402

HEADLINE = (
    "clean_login", "cleaning_report", "exclude_table", "login_gaps", "user_summary",
    "monthly_activity", "monthly_active_users", "most_active_users", "adu_user_summary",
    "adu_monthly_denials", "user_summary_flagged", "technician_matches",
    "named_licence_analysis", "licence_recommendations", "executive_summary", "estate_metrics",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def consume(table) -> None:
    table.write.format("noop").mode("overwrite").save()


def whole_review(spark: SparkSession, sf_dir: str) -> None:
    """Every table of a run, written to a folder of its own."""
    output_path = f"{shared_folder(spark)}/bench-{uuid.uuid4().hex}"
    params = replace(inputs.PARAMS, output_path=output_path)
    write_review(spark, review_inputs(spark, sf_dir), params)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    consume(spark.read.parquet(f"{sf_dir}/events.parquet"))
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        consume(QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - started, 3)
    started = time.perf_counter()
    whole_review(spark, sf_dir)
    seconds["whole_review"] = round(time.perf_counter() - started, 3)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
