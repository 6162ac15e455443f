"""The four review inputs, derived from the driver tables ``events``, ``customer`` and ``supplier``.

Every row of those tables takes part; FIXTURES.md describes the derivation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatscope.params import Exclusions, Params

PARAMS = Params(
    shared_licence="ADU",
    exclusions=Exclusions(
        exact=("customer 000000003 (CUSTOMER 000000003: acme)",),
        contains=("CUSTOMER 000000007",),
    ),
)
SHARED_LICENCE_SEGMENT = "AUTOMOBILE"


# Stated, so that reading a table does not start a job to find its schema.
SCHEMAS = {
    "events": (
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ),
    "customer": (
        "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a user text and an event-time text, both with some unusable values.

    Users differ in how many months they spread over and in how coarse their active days are, so
    that all usage categories occur. Every fifth user shares the display name of the one before.
    """
    events = table(spark, sf_dir, "events")
    steps = events.selectExpr(
        "*",
        "'Customer ' || lpad(cast(user_id AS string), 9, '0') AS name",
        "'Customer ' || lpad(cast(user_id - if(user_id % 5 = 4, 1, 0) AS string), 9, '0') AS shown",
        "datediff(cast(ts AS date), DATE'2024-01-01') AS base_day",
        "((user_id div 4) % 10) * ((user_id div 4) % 10) div 2 + 1 AS step",
    ).selectExpr("*", "base_day + 30 * (event_id % (1 + user_id % 4)) AS day")
    moved = steps.selectExpr(
        "*", "ts + make_dt_interval(cast(day - day % step - base_day AS int)) AS moved_ts"
    )
    return moved.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.when(F.col("event_id") % 97 == 0, F.lit("   "))
        .otherwise(F.concat("shown", F.lit(" ("), "name", F.lit(": Acme)")))
        .alias("User Name"),
        F.when(F.col("event_id") % 89 == 0, F.lit("not-a-timestamp"))
        .otherwise(
            F.concat(
                F.left(F.col("moved_ts").cast("string"), F.lit(19)),
                F.when(F.col("event_id") % 2 == 0, F.lit(" BST")).otherwise(F.lit(" GMT")),
            )
        )
        .alias("Event Time"),
    )


def login_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = _audit(spark, sf_dir)
    return audit.select("User Name", "Event Time", F.col("event_type").alias("Event Label"))


def denial_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events; errors that are not small, by a bound that differs per user, are denials."""
    audit = _audit(spark, sf_dir)
    is_denial = (F.col("event_type") == "error") & (F.col("value") >= 15 * (F.col("user_id") % 7))
    label = F.when(is_denial, F.lit(PARAMS.denial_label)).otherwise(F.lit("Other Event"))
    return audit.select("User Name", "Event Time", label.alias("Event Label"))


def technician_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers under users' names, each in two spellings of which the first is to be kept."""
    people = table(spark, sf_dir, "supplier").selectExpr(
        "'Customer ' || lpad(cast(2 * s_suppkey AS string), 9, '0') AS name"
    )
    shouted = F.upper(F.replace(F.col("name"), F.lit(" "), F.lit("   ")))
    return people.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit(0).alias("ord"),
                    F.concat(F.lit("  "), shouted, F.lit(" ")).alias("Full Name"),
                ),
                F.struct(F.lit(1).alias("ord"), F.col("name").alias("Full Name")),
            )
        )
    )


def named_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers; odd keys are written in lower case."""
    name = F.replace(F.col("c_name"), F.lit("#"), F.lit(" "))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ord"),
        F.when(F.col("c_custkey") % 2 == 0, name).otherwise(F.lower(name)).alias("User"),
        F.when(F.col("c_mktsegment") == SHARED_LICENCE_SEGMENT, F.lit("ADU"))
        .otherwise(F.col("c_mktsegment"))
        .alias("Allocated License"),
    )


def exclusion_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exclusions document per customer, as JSON text."""
    name = F.replace(F.col("c_name"), F.lit("#"), F.lit(" "))
    document = F.struct(
        F.array(name, F.lower(name)).alias("excluded_user_exact_values"),
        F.array(F.col("c_mktsegment")).alias("excluded_user_contains_values"),
    )
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("origin"), F.to_json(document).alias("value")
    )


def exclusion_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exclusion per customer: exact, "contains", or one that fits no user, by segment."""
    name = F.replace(F.col("c_name"), F.lit("#"), F.lit(" "))
    exact = F.concat(F.upper(name), F.lit(" ("), name, F.lit(": Acme)"))
    segment = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        F.when(segment == "BUILDING", "contains").otherwise("exact").alias("kind"),
        F.when(segment == "FURNITURE", exact)
        .when(segment == "BUILDING", F.lower(name))
        .otherwise(F.concat(name, F.lit(" of old")))
        .alias("value"),
    )


def exclusion_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``exclusion_table``, each as a JSON document of its own."""
    value = F.array("value")
    none = F.array().cast("array<string>")
    document = F.struct(
        F.when(F.col("kind") == "exact", value).otherwise(none).alias("excluded_user_exact_values"),
        F.when(F.col("kind") == "contains", value).otherwise(none).alias("excluded_user_contains_values"),
    )
    return exclusion_table(spark, sf_dir).select(
        F.col("value").alias("origin"), F.to_json(document).alias("value")
    )


def contains_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A "contains" exclusion for each customer: the account part, for odd keys with a wrong organisation."""
    name = F.replace(F.col("c_name"), F.lit("#"), F.lit(" "))
    ending = F.when(F.col("c_custkey") % 2 == 0, ": ACME").otherwise(": OTHER")
    return table(spark, sf_dir, "customer").select(
        F.lit("contains").alias("kind"), F.concat(F.lit("("), name, ending).alias("value")
    )
