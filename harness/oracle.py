"""SQL for DuckDB that states, over the same tables, what each query has to return."""

from __future__ import annotations

from harness.inputs import PARAMS, SHARED_LICENCE_SEGMENT
from seatscope.functions import rules
from seatscope.operators.recommend import EVIDENCE_ROWS

_R = rules.RATIONALE
_EXACT = PARAMS.exclusions.exact[0]
_TOKEN = PARAMS.exclusions.contains[0]


def _round2(expression: str) -> str:
    return f"round_even(({expression}) * 100, 0) / 100"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _cleaned(user: str, kept: str, date_column: str, source: str, label: str) -> str:
    """Rows of an audit that survive cleaning, with the derived columns."""
    return f"""
  SELECT u AS "user", "Event Time" AS event_time_raw, {label}
    CASE WHEN regexp_matches(u, '^.*?\\s+\\(') THEN trim(regexp_extract(u, '^(.*?)\\s+\\(', 1)) ELSE u END
      AS user_display_name,
    event_time_text, stamp AS event_timestamp, CAST(stamp AS DATE) AS {date_column},
    CAST(year(stamp) AS INTEGER) AS "year", CAST(month(stamp) AS INTEGER) AS "month",
    strftime(stamp, '%Y-%m') AS year_month
  FROM (
    SELECT *, try_strptime(event_time_text, '%Y-%m-%d %H:%M:%S') AS stamp
    FROM (
      SELECT *, {user} AS u,
        regexp_replace(regexp_replace(trim("Event Time"), ' BST$', ''), ' GMT$', '') AS event_time_text
      FROM {source}
    )
  )
  WHERE u <> '' AND stamp IS NOT NULL AND {kept}"""


_KEPT = f"lower(u) <> {_quoted(_EXACT.lower())} AND NOT contains(lower(u), {_quoted(_TOKEN.lower())})"
_ACCOUNT = """regexp_extract("user", '\\(([^:]*):', 1)"""
_LISTED = f"""WHERE lower("user") NOT IN (
    SELECT lower(replace(c_name || ' (' || c_name || ': Acme)', '#', ' ')) FROM customer WHERE c_mktsegment = 'FURNITURE')
  AND user_display_name NOT IN (SELECT replace(c_name, '#', ' ') FROM customer WHERE c_mktsegment = 'BUILDING')
  AND {_ACCOUNT} NOT IN (SELECT replace(c_name, '#', ' ') FROM customer WHERE c_mktsegment = 'BUILDING')"""
_DISPLAY = "CASE WHEN regexp_matches({u}, '^.*?\\s+\\(') THEN trim(regexp_extract({u}, '^(.*?)\\s+\\(', 1)) ELSE {u} END"
_KEY = "lower(regexp_replace(trim({0}), '\\s+', ' ', 'g'))"
_TECHNICIAN_STATUS = f"""CASE WHEN match_status <> 'Matched' THEN {_quoted(rules.NO_AUTHENTICATION)}
      WHEN usage_category = 'Regular' THEN {_quoted(rules.RETAIN_DEDICATED)}
      WHEN usage_category = 'Occasional' THEN {_quoted(rules.REVIEW_BUSINESS_NEED)}
      ELSE {_quoted(rules.REMOVE_OR_REALLOCATE)} END"""

_INPUTS = f"""
steps AS (
  SELECT *, 'Customer ' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS "name",
    'Customer ' || lpad(CAST(CASE WHEN user_id % 5 = 4 THEN user_id - 1 ELSE user_id END AS VARCHAR), 9, '0') AS shown,
    date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS base_day,
    ((user_id // 4) % 10) * ((user_id // 4) % 10) // 2 + 1 AS step
  FROM events
), moved AS (
  SELECT *, base_day + 30 * (event_id % (1 + user_id % 4)) AS "day" FROM steps
), audit AS (
  SELECT event_id, user_id, event_type, value,
    CASE WHEN event_id % 97 = 0 THEN '   ' ELSE shown || ' (' || "name" || ': Acme)' END AS "User Name",
    CASE WHEN event_id % 89 = 0 THEN 'not-a-timestamp'
      ELSE strftime(ts + to_days(CAST("day" - "day" % step - base_day AS INTEGER)), '%Y-%m-%d %H:%M:%S')
        || CASE WHEN event_id % 2 = 0 THEN ' BST' ELSE ' GMT' END
    END AS "Event Time"
  FROM moved
), login_audit AS (
  SELECT "User Name", "Event Time", event_type AS "Event Label" FROM audit
), denial_audit AS (
  SELECT "User Name", "Event Time",
    CASE WHEN event_type = 'error' AND value >= 15 * (user_id % 7) THEN {_quoted(PARAMS.denial_label)}
      ELSE 'Other Event' END AS "Event Label"
  FROM audit
), technician_people AS (
  SELECT 'Customer ' || lpad(CAST(2 * s_suppkey AS VARCHAR), 9, '0') AS "name" FROM supplier
), technician_names AS (
  SELECT 0 AS ord, '  ' || upper(replace("name", ' ', '   ')) || ' ' AS "Full Name" FROM technician_people
  UNION ALL
  SELECT 1, "name" FROM technician_people
), named_rows AS (
  SELECT c_custkey AS ord,
    CASE WHEN c_custkey % 2 = 0 THEN replace(c_name, '#', ' ') ELSE lower(replace(c_name, '#', ' ')) END
      AS "User",
    CASE WHEN c_mktsegment = {_quoted(SHARED_LICENCE_SEGMENT)} THEN 'ADU' ELSE c_mktsegment END
      AS "Allocated License"
  FROM customer
)"""

_TABLES = f"""
login AS ({_cleaned('trim("User Name")', _KEPT, "login_date", "login_audit", '"Event Label",')}
), denied_rows AS ({_cleaned('trim("User Name")', _KEPT, "denial_date", "denial_audit", '"Event Label" AS event_label,')}
    AND "Event Label" = {_quoted(PARAMS.denial_label)}
), period AS (
  SELECT count(DISTINCT year_month) AS months, max(login_date) AS last_date,
    min(login_date) AS first_date, count(*) AS events FROM login
), days AS (
  SELECT DISTINCT "user", login_date FROM login
), gaps AS (
  SELECT "user", login_date, lag(login_date) OVER w AS previous_login_date,
    CAST(date_diff('day', lag(login_date) OVER w, login_date) AS INTEGER) AS gap_days
  FROM days WINDOW w AS (PARTITION BY "user" ORDER BY login_date)
), gap_stats AS (
  SELECT "user", CAST(coalesce(max(gap_days), 0) AS BIGINT) AS longest_gap_days,
    {_round2("coalesce(median(gap_days), 0.0)")} AS median_days_between_activity
  FROM gaps GROUP BY "user"
), counts AS (
  SELECT "user", min(user_display_name) AS user_display_name, count(*) AS total_logins,
    count(DISTINCT login_date) AS distinct_login_days, count(DISTINCT year_month) AS active_months,
    min(login_date) AS first_login_date, max(login_date) AS last_login_date
  FROM login GROUP BY "user"
), averages AS (
  SELECT counts.*, gap_stats.longest_gap_days, gap_stats.median_days_between_activity,
    total_logins / CAST(months AS DOUBLE) AS average_logins_per_month,
    distinct_login_days / CAST(months AS DOUBLE) AS average_active_days_per_month,
    {_round2("active_months / CAST(months AS DOUBLE) * 100")} AS percentage_months_active,
    last_login_date >= last_date - {PARAMS.recent_days} AS last_90_days_active
  FROM counts JOIN gap_stats USING ("user") CROSS JOIN period
), users AS (
  SELECT "user", user_display_name, total_logins, distinct_login_days, active_months,
    average_logins_per_month, average_active_days_per_month, percentage_months_active,
    first_login_date, last_login_date, longest_gap_days, median_days_between_activity,
    last_90_days_active,
    CASE WHEN average_active_days_per_month >= {PARAMS.regular_min_active_days} THEN 'Regular'
      WHEN average_active_days_per_month >= {PARAMS.occasional_min_active_days} THEN 'Occasional'
      ELSE 'Rare' END AS usage_category
  FROM averages
), denied AS (
  SELECT "user", min(user_display_name) AS user_display_name, count(*) AS adu_denied_attempts,
    count(DISTINCT denial_date) AS adu_denied_days, count(DISTINCT year_month) AS adu_denied_months,
    min(denial_date) AS first_adu_denial, max(denial_date) AS last_adu_denial,
    count(*) FILTER (WHERE recent) AS adu_denied_attempts_last_90_days,
    count(DISTINCT denial_date) FILTER (WHERE recent) AS adu_denied_days_last_90_days,
    count(DISTINCT denial_date) >= {PARAMS.repeated_denied_days}
      OR count(*) >= {PARAMS.repeated_denied_attempts} AS is_repeated_adu_denial_user
  FROM (
    SELECT *, denial_date >= (SELECT max(denial_date) FROM denied_rows) - {PARAMS.recent_days} AS recent
    FROM denied_rows
  ) GROUP BY "user"
), technicians AS (
  SELECT production_technician_name, production_technician_match_key FROM (
    SELECT trim("Full Name") AS production_technician_name,
      {_KEY.format('"Full Name"')} AS production_technician_match_key,
      row_number() OVER (PARTITION BY {_KEY.format('"Full Name"')} ORDER BY ord) AS n
    FROM technician_names
  ) WHERE n = 1
), named AS (
  SELECT named_user, allocated_licence, named_user_match_key FROM (
    SELECT trim("User") AS named_user, trim("Allocated License") AS allocated_licence,
      {_KEY.format('"User"')} AS named_user_match_key,
      row_number() OVER (PARTITION BY {_KEY.format('"User"')} ORDER BY ord) AS n
    FROM named_rows
  ) WHERE n = 1
), user_keys AS (
  SELECT *, {_KEY.format("user_display_name")} AS k FROM users
), denied_keys AS (
  SELECT *, {_KEY.format("user_display_name")} AS k FROM denied
), flagged AS (
  SELECT u.* EXCLUDE (k), t.production_technician_name IS NOT NULL AS is_production_technician,
    t.production_technician_name,
    coalesce(d.adu_denied_attempts, 0) AS adu_denied_attempts,
    coalesce(d.adu_denied_days, 0) AS adu_denied_days,
    coalesce(d.adu_denied_months, 0) AS adu_denied_months,
    d.last_adu_denial,
    coalesce(d.adu_denied_attempts_last_90_days, 0) AS adu_denied_attempts_last_90_days,
    coalesce(d.adu_denied_days_last_90_days, 0) AS adu_denied_days_last_90_days,
    coalesce(d.is_repeated_adu_denial_user, FALSE) AS is_repeated_adu_denial_user,
    coalesce(d.adu_denied_attempts, 0) > 0 AS has_adu_denials,
    coalesce(d.adu_denied_days, 0) >= {PARAMS.dedicated_denied_days}
      AND u.usage_category IN ('Regular', 'Occasional') AS is_dedicated_licence_candidate
  FROM user_keys u
  LEFT JOIN technicians t ON u.k = t.production_technician_match_key
  LEFT JOIN denied_keys d ON u.k = d.k
), matches AS (
  SELECT *, {_TECHNICIAN_STATUS} AS review_status FROM (
    SELECT t.production_technician_name,
      CASE WHEN u."user" IS NULL THEN 'Unmatched' ELSE 'Matched' END AS match_status,
      u."user" AS matched_user, u.user_display_name, u.usage_category,
      u.distinct_login_days, u.last_login_date
    FROM technicians t
    LEFT JOIN flagged u ON t.production_technician_match_key = {_KEY.format("u.user_display_name")}
  )
), analysis AS (
  SELECT *, CASE WHEN match_status <> 'Matched' THEN {_quoted(rules.NO_LOGIN_ACTIVITY)}
      WHEN usage_category = 'Regular' THEN {_quoted(rules.RETAIN_NAMED)}
      WHEN usage_category = 'Occasional' THEN {_quoted(rules.REVIEW_NAMED)}
      ELSE {_quoted(rules.TRANSFER_TO_SHARED)} END AS named_licence_review_status
  FROM (
    SELECT n.named_user, n.allocated_licence,
      CASE WHEN u."user" IS NULL THEN 'Unmatched' ELSE 'Matched' END AS match_status,
      u."user" AS matched_login_user, u.user_display_name, u.usage_category,
      coalesce(u.distinct_login_days, 0) AS distinct_login_days,
      coalesce(u.active_months, 0) AS active_months,
      coalesce(u.average_active_days_per_month, 0) AS average_active_days_per_month,
      u.last_login_date,
      coalesce(u.adu_denied_days, 0) AS adu_denied_days,
      coalesce(u.adu_denied_attempts, 0) AS adu_denied_attempts,
      coalesce(u.is_production_technician, FALSE) AS is_production_technician
    FROM named n
    LEFT JOIN flagged u ON n.named_user_match_key = {_KEY.format("u.user_display_name")}
  )
), first_users AS (
  SELECT * FROM user_keys QUALIFY row_number() OVER (
    PARTITION BY k ORDER BY usage_category, average_active_days_per_month DESC,
      distinct_login_days DESC, user_display_name, "user") = 1
), first_denied AS (
  SELECT * FROM denied_keys QUALIFY row_number() OVER (
    PARTITION BY k ORDER BY adu_denied_days DESC, adu_denied_attempts DESC, last_adu_denial DESC,
      user_display_name, "user") = 1
), first_matches AS (
  SELECT *, {_KEY.format("production_technician_name")} AS k FROM matches QUALIFY row_number() OVER (
    PARTITION BY {_KEY.format("production_technician_name")}
    ORDER BY match_status, production_technician_name) = 1
), subject_keys AS (
  SELECT k FROM first_denied UNION SELECT k FROM first_matches
), subjects AS (
  SELECT s.k AS match_key, u.user_display_name AS login_name, d.user_display_name AS denial_name,
    t.production_technician_name AS technician_name, t.match_status AS technician_status,
    t.k IS NOT NULL AS is_technician, d.k IS NOT NULL AS has_denials,
    u.usage_category AS category, coalesce(u.distinct_login_days, 0) AS login_days,
    coalesce(u.active_months, 0) AS months, u.last_login_date,
    coalesce(d.adu_denied_attempts, 0) AS attempts, coalesce(d.adu_denied_days, 0) AS denied_days,
    d.last_adu_denial
  FROM subject_keys s LEFT JOIN first_users u ON s.k = u.k LEFT JOIN first_denied d ON s.k = d.k
  LEFT JOIN first_matches t ON s.k = t.k
), ruled AS (
  SELECT *, CASE
      WHEN is_technician AND technician_status <> 'Matched' THEN 1
      WHEN is_technician AND category = 'Rare' THEN 2
      WHEN is_technician AND category = 'Occasional' THEN 3
      WHEN is_technician AND category = 'Regular' THEN 4
      WHEN has_denials AND denied_days >= {PARAMS.dedicated_denied_days}
        AND category IN ('Regular', 'Occasional') THEN 5
      WHEN has_denials AND (denied_days >= {PARAMS.repeated_denied_days}
        OR attempts >= {PARAMS.repeated_denied_attempts}) THEN 6
      WHEN has_denials THEN 7 ELSE 8 END AS rule
  FROM subjects
), advice AS (
  SELECT coalesce(login_name, denial_name, technician_name, '') AS "user",
    CASE WHEN is_technician AND has_denials THEN 'Production Technician + ADU Denied'
      WHEN is_technician THEN 'Production Technician' ELSE 'ADU Denied' END AS user_group,
    coalesce(category, {_quoted(rules.NO_AUTHENTICATION)}) AS usage_category,
    login_days AS distinct_login_days, months AS active_months, last_login_date,
    attempts AS adu_denied_attempts, denied_days AS adu_denied_days, last_adu_denial,
    technician_status AS production_technician_match_status,
    CASE rule WHEN 1 THEN {_quoted(rules.REMOVE_OR_REALLOCATE)}
      WHEN 2 THEN {_quoted(rules.REMOVE_OR_REALLOCATE)}
      WHEN 3 THEN {_quoted(rules.REVIEW_BUSINESS_NEED)} WHEN 4 THEN {_quoted(rules.RETAIN_DEDICATED)}
      WHEN 5 THEN {_quoted(rules.ALLOCATE_DEDICATED)} WHEN 6 THEN {_quoted(rules.REVIEW_NEED)}
      WHEN 7 THEN {_quoted(rules.MONITOR)} ELSE {_quoted(rules.NO_ACTION)} END AS recommendation,
    CASE rule WHEN 1 THEN {_quoted(_R["technician_unmatched"])}
      WHEN 2 THEN {_quoted(_R["technician_rare"])} WHEN 3 THEN {_quoted(_R["technician_occasional"])}
      WHEN 4 THEN {_quoted(_R["technician_regular"])} WHEN 5 THEN {_quoted(_R["dedicated"])}
      WHEN 6 THEN {_quoted(_R["repeated"])} WHEN 7 THEN {_quoted(_R["monitor"])}
      ELSE {_quoted(_R["none"])} END AS rationale,
    concat_ws('; ',
      CASE WHEN category IS NOT NULL THEN category || ' PLM usage: ' || login_days || ' active day'
        || CASE WHEN login_days = 1 THEN '' ELSE 's' END || ' across ' || months || ' active month'
        || CASE WHEN months = 1 THEN '' ELSE 's' END END,
      CASE WHEN attempts <> 0 THEN 'ADU access blocked ' || attempts || ' time'
        || CASE WHEN attempts = 1 THEN '' ELSE 's' END || ' across ' || denied_days || ' day'
        || CASE WHEN denied_days = 1 THEN '' ELSE 's' END END,
      CASE WHEN technician_status = 'Unmatched' THEN {_quoted(rules.UNMATCHED_EVIDENCE)} END
    ) AS evidence_summary
  FROM ruled
), positions AS (
  SELECT count(*) FILTER (WHERE recommendation = {_quoted(rules.REMOVE_OR_REALLOCATE)}) AS recoverable,
    count(*) FILTER (WHERE recommendation = {_quoted(rules.ALLOCATE_DEDICATED)}) AS demand,
    recoverable - demand AS remaining
  FROM advice
), monthly AS (
  SELECT 'M' || row_number() OVER (ORDER BY year_month) AS month_label, year_month, active_users
  FROM (SELECT year_month, count(DISTINCT "user") AS active_users FROM login GROUP BY year_month)
), monthly_average AS (
  SELECT coalesce({_round2("avg(active_users)")}, 0.0) AS average FROM monthly
), named_counts AS (
  SELECT count(*) AS named, count(*) FILTER (WHERE match_status = 'Matched') AS matched,
    count(*) FILTER (WHERE match_status <> 'Matched') AS no_login,
    count(*) FILTER (WHERE usage_category = 'Regular') AS regular,
    count(*) FILTER (WHERE usage_category = 'Occasional') AS occasional,
    count(*) FILTER (WHERE usage_category = 'Rare') AS rare,
    count(*) FILTER (WHERE allocated_licence = 'ADU') AS assigned
  FROM analysis
), report AS (
  SELECT count(*) AS input_rows, count(*) FILTER (WHERE reason = 'kept') AS output_rows,
    count(*) FILTER (WHERE reason = 'missing') AS dropped_missing_user_rows,
    count(*) FILTER (WHERE reason = 'invalid') AS dropped_invalid_timestamp_rows,
    count(*) FILTER (WHERE reason = 'excluded') AS dropped_excluded_user_rows
  FROM (
    SELECT CASE WHEN u = '' THEN 'missing' WHEN NOT ({_KEPT}) THEN 'excluded'
      WHEN try_strptime(regexp_replace("Event Time", ' (BST|GMT)$', ''), '%Y-%m-%d %H:%M:%S') IS NULL
        THEN 'invalid' ELSE 'kept' END AS reason
    FROM (SELECT trim("User Name") AS u, "Event Time" FROM login_audit)
  )
), assigned_denied AS (
  SELECT count(*) AS assigned_with_denials FROM denied d
  JOIN analysis a ON d.user_display_name = a.named_user WHERE a.allocated_licence = 'ADU'
), ranked AS (
  SELECT 'U' || row_number() OVER (ORDER BY adu_denied_days DESC, adu_denied_attempts DESC,
    last_adu_denial DESC, user_display_name, "user") AS user_label, *
  FROM denied
  ORDER BY adu_denied_days DESC, adu_denied_attempts DESC, last_adu_denial DESC, user_display_name, "user"
  LIMIT 20
)"""

_WITH = f"WITH {_INPUTS}, {_TABLES}\n"


def _metrics(source: str, *rows: tuple[str, str], cast: str = "DOUBLE") -> str:
    selects = [
        f"SELECT {_quoted(label)} AS metric, CAST({value} AS {cast}) AS value FROM {source}"
        for label, value in rows
    ]
    return "\nUNION ALL ".join(selects)


_CATEGORY_ROWS = "\nUNION ALL ".join(
    f"""SELECT '{name}' AS category, count(*) FILTER (WHERE usage_category = '{name}') AS user_count,
  {_round2(f"count(*) FILTER (WHERE usage_category = '{name}') / CAST(count(*) AS DOUBLE) * 100")}
    AS percentage_of_total_users FROM flagged"""
    for name in ("Regular", "Occasional", "Rare")
)
_CLEANED = f"""event_label, event_time_raw, "user", user_display_name, event_time_text, event_timestamp,
  denial_date, "year", "month", year_month"""
_FLAGS = """adu_denied_attempts, adu_denied_days, adu_denied_months, last_adu_denial,
  adu_denied_attempts_last_90_days, adu_denied_days_last_90_days, is_repeated_adu_denial_user,
  has_adu_denials, is_dedicated_licence_candidate"""
_STATUS = "coalesce(usage_category, 'No observed login')"
_STATUS_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE {_STATUS} = '{name}') AS \"{name}\""
    for name in ("Regular", "Occasional", "Rare", "No observed login")
)
_MONTH_COLUMNS = ", ".join(
    f"count(*) FILTER (WHERE strftime(login_date, '%Y-%m') = '2024-{n:02d}') AS \"2024-{n:02d}\""
    for n in range(1, 5)
)


def _without(condition: str) -> str:
    return _cleaned('trim("User Name")', condition, "login_date", "login_audit", "")


_BODIES = {
    "scan_named_licences": f"""SELECT c_name AS named_user, c_mktsegment AS allocated_licence,
  {_KEY.format("c_name")} AS named_user_match_key FROM customer""",
    "scan_technicians": f"""SELECT s_name AS production_technician_name,
  {_KEY.format("s_name")} AS production_technician_match_key FROM supplier""",
    "scan_login_audit": "SELECT * FROM events",
    "scan_denial_audit": """SELECT event_id, event_type AS event_label, CAST(user_id AS VARCHAR) AS "user",
  CAST(user_id AS VARCHAR) AS user_display_name, ts AS event_timestamp, CAST(ts AS DATE) AS denial_date,
  CAST(year(ts) AS INTEGER) AS "year", CAST(month(ts) AS INTEGER) AS "month",
  strftime(ts, '%Y-%m') AS year_month
FROM events WHERE event_type = 'error'""",
    "scan_exclusions": """SELECT 'exact' AS kind, replace(c_name, '#', ' ') AS value FROM customer
UNION ALL SELECT 'exact', lower(replace(c_name, '#', ' ')) FROM customer
UNION ALL SELECT 'contains', c_mktsegment FROM customer""",
    "clean_login": "SELECT * FROM login",
    "clean_login_lowercase": f"""SELECT lower("user") AS "user", lower(user_display_name) AS user_display_name,
  event_timestamp FROM login""",
    "clean_denials": f"SELECT {_CLEANED} FROM denied_rows",
    "cleaning_report": "SELECT * FROM report",
    "exclude_exact": f"""SELECT "user", event_timestamp FROM (
  {_without(f"lower(u) <> {_quoted(_EXACT.lower())}")})""",
    "exclude_contains": f"""SELECT "user", event_timestamp FROM (
  {_without(f"NOT contains(lower(u), {_quoted(_TOKEN.lower())})")})""",
    "exclude_table": f"""SELECT "user", event_timestamp FROM (
  {_without("TRUE")})
{_LISTED}""",
    "exclude_file_list": f"""SELECT "user", event_timestamp FROM (
  {_without("TRUE")})
{_LISTED}""",
    "exclude_contains_many": f"""SELECT "user", event_timestamp FROM (
  {_without("TRUE")})
WHERE {_ACCOUNT} NOT IN (SELECT replace(c_name, '#', ' ') FROM customer WHERE c_custkey % 2 = 0)""",
    "display_name": f"""SELECT trim("User Name") AS "user", {_DISPLAY.format(u='trim("User Name")')}
  AS user_display_name FROM login_audit""",
    "parse_event_time": """SELECT event_time_text,
  try_strptime(event_time_text, '%Y-%m-%d %H:%M:%S') AS event_timestamp
FROM (SELECT regexp_replace("Event Time", ' (BST|GMT)$', '') AS event_time_text FROM login_audit)""",
    "filter_denial_label": f"""SELECT "User Name" AS user_name, "Event Time" AS event_time,
  "Event Label" AS event_label FROM denial_audit WHERE "Event Label" = {_quoted(PARAMS.denial_label)}""",
    "normalise_person_name": f"""SELECT "Full Name" AS full_name, {_KEY.format('"Full Name"')} AS match_key
FROM technician_names""",
    "dedupe_first_by_key": "SELECT * FROM technicians",
    "user_login_counts": """SELECT "user", user_display_name, total_logins, active_months,
  first_login_date, last_login_date FROM counts""",
    "distinct_login_days": 'SELECT "user", distinct_login_days FROM counts',
    "login_gaps": 'SELECT "user", login_date, previous_login_date, gap_days FROM gaps',
    "gap_stats": "SELECT * FROM gap_stats",
    "user_averages": """SELECT "user", average_logins_per_month, average_active_days_per_month,
  percentage_months_active FROM users""",
    "categorise_user": 'SELECT "user", average_active_days_per_month, usage_category FROM users',
    "user_summary": "SELECT * FROM users",
    "user_month_days": """SELECT "user", user_display_name, year_month,
  count(DISTINCT login_date) AS active_days FROM login GROUP BY ALL""",
    "monthly_activity": f"""SELECT "user", {_DISPLAY.format(u='"user"')} AS user_display_name,
  {_MONTH_COLUMNS}, count(*) AS "Total" FROM days GROUP BY "user" """,
    "monthly_active_users": "SELECT * FROM monthly",
    "month_labels": "SELECT month_label, year_month FROM monthly",
    "category_summary": _CATEGORY_ROWS,
    "users_by_category": "SELECT usage_category AS subset, * FROM users",
    "most_active_users": """SELECT user_display_name, usage_category, average_active_days_per_month,
  distinct_login_days, total_logins, last_login_date FROM flagged
ORDER BY average_active_days_per_month DESC, distinct_login_days DESC, total_logins DESC,
  user_display_name, "user" LIMIT 50""",
    "at_risk_rare_users": """SELECT user_display_name, usage_category, average_active_days_per_month,
  distinct_login_days, total_logins, last_login_date, last_90_days_active FROM flagged
WHERE usage_category = 'Rare' AND NOT last_90_days_active
ORDER BY average_active_days_per_month, distinct_login_days, total_logins, last_login_date,
  user_display_name, "user" LIMIT 50""",
    "raw_login": "SELECT * FROM login ORDER BY event_timestamp, \"user\"",
    "denial_user_counts": """SELECT "user", adu_denied_attempts, adu_denied_days, adu_denied_months,
  first_adu_denial, last_adu_denial FROM denied""",
    "denial_recent_counts": """SELECT "user", adu_denied_attempts_last_90_days,
  adu_denied_days_last_90_days FROM denied""",
    "repeated_denial_flag": 'SELECT "user", is_repeated_adu_denial_user FROM denied',
    "adu_user_summary": "SELECT * FROM denied",
    "adu_monthly_denials": """SELECT 'M' || row_number() OVER (ORDER BY year_month) AS month_label, * FROM (
  SELECT year_month, count(*) AS adu_denied_attempts, count(DISTINCT "user") AS adu_denied_users,
    count(DISTINCT denial_date) AS adu_denied_days FROM denied_rows GROUP BY year_month)""",
    "ranked_adu_users": "SELECT * FROM ranked",
    "adu_user_label_key": "SELECT user_label, user_display_name FROM ranked",
    "raw_denials": f'SELECT {_CLEANED} FROM denied_rows ORDER BY event_timestamp, "user"',
    "flag_technicians": """SELECT u."user", t.production_technician_name IS NOT NULL AS is_production_technician,
  t.production_technician_name FROM user_keys u LEFT JOIN technicians t ON u.k = t.production_technician_match_key""",
    "join_users_denials": f'SELECT "user", {_FLAGS} FROM flagged',
    "dedicated_candidate_flag": """SELECT "user", usage_category, adu_denied_days,
  is_dedicated_licence_candidate FROM flagged""",
    "user_summary_flagged": "SELECT * FROM flagged",
    "highlight_flags": """SELECT "user", CASE WHEN is_dedicated_licence_candidate THEN 'dedicated'
  WHEN is_production_technician THEN 'technician' END AS row_highlight FROM flagged""",
    "join_technicians_users": "SELECT production_technician_name, matched_user, user_display_name FROM matches",
    "technician_review_status": """SELECT production_technician_name, match_status, usage_category,
  review_status FROM matches""",
    "technician_matches": """SELECT production_technician_name, match_status, matched_user,
  user_display_name, usage_category, review_status, distinct_login_days, last_login_date FROM matches""",
    "technician_review_summary": """SELECT review_status, count(*) AS user_count FROM matches
GROUP BY review_status""",
    "join_named_users": """SELECT named_user, matched_login_user, distinct_login_days, active_months
FROM analysis""",
    "named_review_status": """SELECT named_user, match_status, usage_category, named_licence_review_status
FROM analysis""",
    "named_licence_analysis": "SELECT * FROM analysis",
    "named_licence_summary": _metrics(
        "named_counts, monthly_average",
        ("Named licences allocated", "named"),
        ("Named users matched to login audit", "matched"),
        ("Named users with no observed login", "no_login"),
        ("Named users classed as Regular", "regular"),
        ("Named users classed as Occasional", "occasional"),
        ("Named users classed as Rare", "rare"),
        ("Average monthly PLM users", "average"),
        ("Named licences above average monthly PLM users", _round2("named - average")),
    ),
    "named_licence_review_summary": """SELECT named_licence_review_status, count(*) AS user_count
FROM analysis GROUP BY named_licence_review_status""",
    "named_licence_no_login": f"""SELECT * FROM analysis
WHERE named_licence_review_status = {_quoted(rules.NO_LOGIN_ACTIVITY)}""",
    "assigned_with_denials": "SELECT * FROM assigned_denied",
    "recommendation_keys": """SELECT match_key, login_name, denial_name, technician_name,
  technician_status FROM subjects""",
    "classify_recommendation": 'SELECT "user", recommendation, rationale FROM advice',
    "user_group_label": 'SELECT "user", user_group FROM advice',
    "evidence_summary": 'SELECT "user", evidence_summary FROM advice',
    "format_count": """SELECT "user",
  adu_denied_attempts || CASE WHEN adu_denied_attempts = 1 THEN ' time' ELSE ' times' END AS attempts_text,
  adu_denied_days || CASE WHEN adu_denied_days = 1 THEN ' day' ELSE ' days' END AS days_text FROM denied""",
    "licence_recommendations": "SELECT * FROM advice",
    "dedicated_licence_candidates": f"""SELECT "user", usage_category, distinct_login_days, active_months,
  adu_denied_attempts, adu_denied_days, last_adu_denial,
  evidence_summary || {_quoted(rules.JUSTIFICATION_SUFFIX)} AS justification
FROM advice WHERE recommendation = {_quoted(rules.ALLOCATE_DEDICATED)}""",
    "unused_licence_evidence": "\nUNION ALL ".join(
        f"""SELECT {_quoted(measure)} AS measure, {name} AS "count",
  {_quoted(method)} AS confirmation_method FROM positions"""
        for measure, name, method in EVIDENCE_ROWS
    ),
    "licence_balance": """SELECT 'Potential licences recoverable' AS licence_position,
  recoverable AS user_count FROM positions
UNION ALL SELECT 'Potential dedicated licence demand', demand FROM positions""",
    "recommendation_summary": """SELECT recommendation, count(*) AS user_count FROM advice
GROUP BY recommendation""",
    "executive_summary": _metrics(
        """(SELECT (SELECT count(*) FROM login) AS logins, (SELECT count(*) FROM denied) AS denied,
    (SELECT count(*) FROM matches) AS technicians,
    (SELECT count(*) FROM matches WHERE match_status <> 'Matched') AS unmatched,
    count(DISTINCT "user") AS users, count(*) FILTER (WHERE usage_category = 'Regular') AS regular,
    count(*) FILTER (WHERE usage_category = 'Occasional') AS occasional,
    count(*) FILTER (WHERE usage_category = 'Rare') AS rare FROM flagged), positions""",
        ("PLM login records analysed", "logins"),
        ("PLM users analysed", "users"),
        ("Regular PLM users", "regular"),
        ("Occasional PLM users", "occasional"),
        ("Rare PLM users", "rare"),
        ("Users with ADU denial evidence", "denied"),
        ("Production Technicians reviewed", "technicians"),
        ("Production Technicians with no observed PLM authentication", "unmatched"),
        ("Potential licences recoverable", "recoverable"),
        ("Potential dedicated licence demand", "demand"),
        ("Recoverable licences remaining after proposed allocations", "remaining"),
    ),
    "overview_metrics": _metrics(
        f"""(SELECT count(DISTINCT "user") AS users,
    count(*) FILTER (WHERE usage_category = 'Regular') AS regular,
    count(*) FILTER (WHERE usage_category = 'Occasional') AS occasional,
    count(*) FILTER (WHERE usage_category = 'Rare') AS rare,
    {_round2("avg(total_logins)")} AS logins_per_user,
    {_round2("avg(distinct_login_days)")} AS days_per_user FROM flagged), period, report""",
        ("total_login_records", "events"),
        ("total_unique_users", "users"),
        ("date_range_start", "first_date"),
        ("date_range_end", "last_date"),
        ("regular_user_count", "regular"),
        ("occasional_user_count", "occasional"),
        ("rare_user_count", "rare"),
        ("average_logins_per_user", "logins_per_user"),
        ("average_active_days_per_user", "days_per_user"),
        ("input_rows", "input_rows"),
        ("output_rows", "output_rows"),
        ("dropped_missing_user_rows", "dropped_missing_user_rows"),
        ("dropped_invalid_timestamp_rows", "dropped_invalid_timestamp_rows"),
        ("dropped_excluded_user_rows", "dropped_excluded_user_rows"),
        cast="VARCHAR",
    ),
    "estate_metrics": _metrics(
        "named_counts, assigned_denied, positions, monthly_average",
        ("Named licence users", "named"),
        ("Named licence users with no observed login", "no_login"),
        ("ADU-assigned users", "assigned"),
        ("ADU-assigned users with denial evidence", "assigned_with_denials"),
        ("High-confidence dedicated ADU candidates", "demand"),
        ("Average monthly PLM users", "average"),
    ),
    "named_vs_average": _metrics(
        "named_counts, monthly_average",
        ("Named licence users", "named"),
        ("Average monthly PLM users", "average"),
        ("Named users with no observed login", "no_login"),
    ),
    "named_vs_adu_status": f"""SELECT 'Named users' AS "group", {_STATUS_COUNTS} FROM analysis
UNION ALL SELECT 'ADU-assigned users', {_STATUS_COUNTS} FROM analysis WHERE allocated_licence = 'ADU'""",
    "named_allocation_comparison": _metrics(
        "named_counts, monthly_average",
        ("Named licences allocated", "named"),
        ("Average monthly PLM users", "average"),
    ),
    "adu_executive_summary": _metrics(
        f"""(SELECT (SELECT count(*) FROM denied) AS denied,
    count(*) FILTER (WHERE recommendation = {_quoted(rules.ALLOCATE_DEDICATED)}) AS dedicated,
    count(*) FILTER (WHERE recommendation = {_quoted(rules.REVIEW_NEED)}) AS review,
    count(*) FILTER (WHERE recommendation = {_quoted(rules.MONITOR)}) AS monitor FROM advice)""",
        ("Users with ADU denial evidence", "denied"),
        ("High-confidence dedicated licence candidates", "dedicated"),
        ("ADU users for review", "review"),
        ("ADU users to monitor", "monitor"),
    ),
}

ORACLE_SQL = {name: _WITH + body for name, body in _BODIES.items()}
