"""Cleaning of the login audit and the denial audit."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatscope.functions.event_time import month_of, parse_event_time, remove_suffix
from seatscope.functions.text import display_name, fold, fold_text, strip
from seatscope.operators.reshape import compute_once
from seatscope.params import Exclusions, Params
from seatscope.sources.readers import check_columns

# Helper columns. The prefix is reserved: input columns that carry it are refused.
RESERVED = "__seatscope_"
FOLDED_USER = f"{RESERVED}folded_user"
EXCLUDED_USER = f"{RESERVED}excluded_user"
IS_EXCLUDED = f"{RESERVED}is_excluded"
ROW_STATE = f"{RESERVED}row_state"


def is_listed(folded_user: Column, exclusions: Exclusions) -> Column:
    """Whether a case-folded user is on the short exclusion lists."""
    listed = F.lit(False)
    if exclusions.exact:
        listed = listed | folded_user.isin(sorted({fold_text(value) for value in exclusions.exact}))
    if exclusions.contains:
        # One flat array: a chain of "or" would grow as deep as the list.
        tokens = F.array(*[F.lit(t) for t in sorted({fold_text(v) for v in exclusions.contains})])
        listed = listed | F.exists(tokens, lambda token: folded_user.contains(token))
    return listed


_PART = 3  # characters of the parts that "contains" is looked up by


def _parts(text: Column, length: int | Column) -> Column:
    """The distinct substrings of one length."""
    places = F.sequence(F.lit(1), F.char_length(text) - length + 1)
    parts = F.transform(places, lambda place: F.substring(text, place, length))
    return F.when(F.char_length(text) >= length, F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


def _containing(users: DataFrame, tokens: DataFrame) -> DataFrame:
    """The ``user`` rows whose ``folded`` text contains a ``token``.

    An inverted index: users are listed under their parts of ``_PART`` characters, and of one and two if a
    token is as short. Each token is looked up under one part only, that of the fewest users, and what it
    meets is verified. The rows are those of the texts' characters, however many lengths tokens have.
    """
    short = tokens.filter(F.char_length("token") < _PART).agg(F.collect_set(F.char_length("token"))).scalar()
    by_length = [
        F.when(F.array_contains("short_lengths", n), _parts(F.col("folded"), n)).otherwise(F.array().cast("array<string>"))
        for n in range(1, _PART)
    ]
    index = users.withColumn("short_lengths", F.coalesce(short, F.array().cast("array<int>"))).select(
        "user", "folded", F.explode(F.concat(_parts(F.col("folded"), _PART), *by_length)).alias("part")
    )
    whole = F.char_length("token") < _PART
    offered = tokens.select(
        "token", F.explode(F.when(whole, F.array("token")).otherwise(_parts(F.col("token"), _PART))).alias("part")
    )
    held = index.join(offered.select("part").distinct(), "part", "left_semi").groupBy("part").agg(F.count("*").alias("users"))
    # A part that no user has rules the token out.
    rarest = offered.join(held, "part", "left").groupBy("token").agg(
        F.min(F.struct(F.coalesce("users", F.lit(0)).alias("users"), "part")).alias("least")
    )
    keyed = rarest.filter("least.users > 0").select("token", F.col("least.part").alias("token_part"))
    met = index.join(keyed, F.col("part") == F.col("token_part")).filter(F.col("folded").contains(F.col("token")))
    any_user = F.coalesce(tokens.agg(F.max(F.col("token") == "")).scalar(), F.lit(False))
    anyone = users.filter(any_user & F.col("user").isNotNull())  # an empty token is in every text
    return met.select("user").unionByName(anyone.select("user"))


def excluded_users(table: DataFrame, exclusion_table: DataFrame) -> DataFrame:
    """Distinct users of a table that a ``(kind, value)`` exclusion table rules out.

    Both tests run once per distinct user and as equi-joins.
    """
    users = table.select("user").distinct().withColumn("folded", fold(F.col("user")))
    values = exclusion_table.select("kind", fold(F.col("value")).alias("folded_value")).distinct()
    exact = users.join(
        values.filter(F.col("kind") == "exact"), F.col("folded") == F.col("folded_value"), "left_semi"
    )
    tokens = values.filter((F.col("kind") == "contains") & F.col("folded_value").isNotNull())
    containing = _containing(users, tokens.select(F.col("folded_value").alias("token")))
    return exact.select("user").unionByName(containing).distinct()


def _with_exclusion_mark(table: DataFrame, exclusions: Exclusions) -> tuple[DataFrame, Column]:
    """The table with what the exclusion test needs, and the test."""
    listed = F.lit(False)
    if exclusions.exact or exclusions.contains:
        table = table.withColumn(FOLDED_USER, fold(F.col("user")))
        listed = is_listed(F.col(FOLDED_USER), exclusions)
    if exclusions.table is not None:
        ruled_out = excluded_users(table, exclusions.table).select(
            F.col("user").alias(EXCLUDED_USER)
        )
        table = table.join(ruled_out, F.col("user") == F.col(EXCLUDED_USER), "left")
        listed = listed | F.col(EXCLUDED_USER).isNotNull()
    return table, listed


def _with_state(table: DataFrame, params: Params) -> DataFrame:
    """Every row with ``event_time_text``, ``event_timestamp`` and its state.

    The state is ``missing``, ``excluded``, ``invalid`` or ``kept``, the first that applies. Typed
    times are taken as they are; instants become wall-clock times of ``params.time_zone``.
    """
    kind = dict(table.dtypes)["event_time_raw"]
    table = table.withColumn("event_time_text", strip(F.col("event_time_raw").cast("string")))
    for suffix in params.timestamp_suffixes:
        table = table.withColumn("event_time_text", remove_suffix(F.col("event_time_text"), suffix))
    table, excluded = _with_exclusion_mark(table, params.exclusions)
    if kind == "timestamp":
        session_clock = F.col("event_time_raw").cast("timestamp_ntz")
        stamp = F.convert_timezone(F.current_timezone(), F.lit(params.time_zone), session_clock)
    elif kind in ("timestamp_ntz", "date"):
        stamp = F.col("event_time_raw").cast("timestamp_ntz")
    else:
        stamp = parse_event_time(F.col("event_time_text"))
    timed = compute_once(
        table,
        {
            "user": F.col("user"),
            IS_EXCLUDED: excluded,
            "event_timestamp": stamp,
        },
    )
    state = (
        F.when(F.col("user").isNull() | (F.col("user") == ""), "missing")
        .when(F.col(IS_EXCLUDED), "excluded")
        .when(F.col("event_timestamp").isNull(), "invalid")
        .otherwise("kept")
    )
    return timed.withColumn(ROW_STATE, state)


def _with_calendar(table: DataFrame, date_column: str) -> DataFrame:
    stamp = F.col("event_timestamp")
    return table.withColumns(
        {
            date_column: stamp.cast("date"),
            "year": F.year(stamp),
            "month": F.month(stamp),
            "year_month": month_of(stamp),
        }
    )


def _stripped_user(lowercase: bool) -> Column:
    user = strip(F.col("user").cast("string"))
    return F.lower(user) if lowercase else user


def _refuse_reserved(raw: DataFrame) -> None:
    clash = [name for name in raw.columns if name.startswith(RESERVED)]
    if clash:
        raise ValueError(f"Reserved column names: {', '.join(clash)}")


def _login_rows(raw: DataFrame, params: Params) -> DataFrame:
    """Every raw login row with its state."""
    check_columns(raw, [params.user_column, params.timestamp_column])
    _refuse_reserved(raw)
    rows = raw.withColumnsRenamed(
        {params.user_column: "user", params.timestamp_column: "event_time_raw"}
    )
    return _with_state(rows.withColumn("user", _stripped_user(params.lowercase_users)), params)


def _kept_rows(rows: DataFrame, date_column: str) -> DataFrame:
    """Rows in state ``kept``, with display name and calendar columns after the input columns."""
    derived = [
        "user_display_name", "event_time_text", "event_timestamp",
        date_column, "year", "month", "year_month",
    ]
    passed = [
        f"`{name}`" for name in rows.columns if name not in derived and not name.startswith(RESERVED)
    ]
    kept = rows.filter(F.col(ROW_STATE) == "kept")
    named = kept.withColumn("user_display_name", display_name(F.col("user")))
    return _with_calendar(named, date_column).select(*passed, *derived)


def clean_login(raw: DataFrame, params: Params) -> DataFrame:
    """Login rows with a user, not excluded, with a valid time; other input columns pass through."""
    return _kept_rows(_login_rows(raw, params), "login_date")


def _report(states: DataFrame, state: Column, rows: Column) -> DataFrame:
    """One row of counters from states and numbers of rows."""

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, rows)), F.lit(0)).cast("long")

    return states.agg(
        total(F.lit(True)).alias("input_rows"),
        total(state == "kept").alias("output_rows"),
        total(state == "missing").alias("dropped_missing_user_rows"),
        total(state == "invalid").alias("dropped_invalid_timestamp_rows"),
        total(state == "excluded").alias("dropped_excluded_user_rows"),
    )


def cleaning_report(raw: DataFrame, params: Params) -> DataFrame:
    """One row of counters. A dropped row counts once: missing, then excluded, then invalid."""
    return _report(_login_rows(raw, params), F.col(ROW_STATE), F.lit(1))


def _without_table(params: Params) -> Params:
    return replace(params, exclusions=replace(params.exclusions, table=None))


def _stated(rows: DataFrame) -> DataFrame:
    helpers = [name for name in rows.columns if name.startswith(RESERVED) and name != ROW_STATE]
    return rows.drop(*helpers)


def login_rows(raw: DataFrame, params: Params) -> DataFrame:
    """Every login row with its state, the exclusion table left aside: the one pass over a raw audit.

    Once written, the table yields the cleaned rows, the per-day activity and the cleaning report.
    """
    return _stated(_login_rows(raw, _without_table(params)))


def denial_rows(raw: DataFrame, params: Params) -> DataFrame:
    """As ``login_rows`` for the rows of a denial audit that carry the label."""
    return _stated(_denial_rows(raw, _without_table(params)))


def after_exclusions(rows: DataFrame, params: Params) -> DataFrame:
    """Rows with states, those of users on the exclusion table now excluded; kept or invalid before."""
    if params.exclusions.table is None:
        return rows
    known = rows.filter(F.col(ROW_STATE).isin("kept", "invalid"))
    ruled_out = excluded_users(known, params.exclusions.table).select(F.col("user").alias(EXCLUDED_USER))
    joined = rows.join(ruled_out, F.col("user") == F.col(EXCLUDED_USER), "left")
    now = F.col(EXCLUDED_USER).isNotNull() & F.col(ROW_STATE).isin("kept", "invalid")
    state = F.when(now, "excluded").otherwise(F.col(ROW_STATE))
    return joined.withColumn(ROW_STATE, state).drop(EXCLUDED_USER)


def kept_logins(rows: DataFrame) -> DataFrame:
    """``clean_login`` from rows with states."""
    return _kept_rows(rows, "login_date")


def kept_denials(rows: DataFrame) -> DataFrame:
    """``clean_denials`` from rows with states."""
    return _kept_rows(rows, "denial_date")


def login_day_states(rows: DataFrame) -> DataFrame:
    """``(row_state, user, activity_date, event_count)`` of rows with states.

    Dropped rows are counted per state only. The table yields both the per-day activity and the
    cleaning report.
    """
    is_kept = F.col(ROW_STATE) == "kept"
    return (
        rows.groupBy(
            F.col(ROW_STATE).alias("row_state"),
            F.when(is_kept, F.col("user")).alias("user"),
            F.when(is_kept, F.col("event_timestamp").cast("date")).alias("activity_date"),
        )
        .agg(F.count("*").alias("event_count"))
    )


def kept_days(states: DataFrame) -> DataFrame:
    """The per-day activity in ``login_day_states``."""
    return states.filter(F.col("row_state") == "kept").select("user", "activity_date", "event_count")


def report_of_states(states: DataFrame) -> DataFrame:
    """The cleaning report in ``login_day_states``."""
    return _report(states, F.col("row_state"), F.col("event_count"))


def clean_denials(raw: DataFrame, params: Params) -> DataFrame:
    """Denial rows: label, then user, then exclusions, then time, whatever the input's columns."""
    return _kept_rows(_denial_rows(raw, params), "denial_date")


def _denial_rows(raw: DataFrame, params: Params) -> DataFrame:
    """Every raw denial row with the label, with its state."""
    required = [
        params.denial_user_column,
        params.denial_timestamp_column,
        params.denial_label_column,
    ]
    check_columns(raw, required, "ADU ")
    _refuse_reserved(raw)
    rows = (
        raw.withColumnsRenamed(
            {
                params.denial_user_column: "user",
                params.denial_timestamp_column: "event_time_raw",
                params.denial_label_column: "event_label",
            }
        )
        .filter(F.col("event_label") == params.denial_label)
        .withColumn("user", _stripped_user(lowercase=False))
    )
    return _with_state(rows, params)


def in_time_order_within_months(cleaned: DataFrame) -> DataFrame:
    """Cleaned rows ready to be written by ``year_month``: each task's rows by month, time and user.

    Nothing is shuffled; a reader of one month merges sorted files.
    """
    return cleaned.sortWithinPartitions("year_month", "event_timestamp", "user")


def in_time_order(cleaned: DataFrame) -> DataFrame:
    """Cleaned rows by time, then user.

    Rows equal in both keep their input order, which also lets Spark split a run of equal rows
    over several range partitions.
    """
    return (
        cleaned.withColumn("_row", F.monotonically_increasing_id())
        .orderBy("event_timestamp", "user", "_row")
        .drop("_row")
    )
