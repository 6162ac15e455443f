"""Review rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seatscope.functions.text import count_phrase
from seatscope.params import Params

# The labels that appear in the result tables.
REGULAR, OCCASIONAL, RARE = "Regular", "Occasional", "Rare"
MATCHED, UNMATCHED = "Matched", "Unmatched"

NO_AUTHENTICATION = "No observed PLM authentication"
RETAIN_DEDICATED = "Retain dedicated licence"
REVIEW_BUSINESS_NEED = "Review business need"
REMOVE_OR_REALLOCATE = "Candidate for licence removal/reallocation"

NO_LOGIN_ACTIVITY = "No observed login activity"
RETAIN_NAMED = "Retain named licence"
REVIEW_NAMED = "Review named licence"
TRANSFER_TO_SHARED = "Candidate for named-to-ADU transfer"

ALLOCATE_DEDICATED = "Consider dedicated licence allocation"
REVIEW_NEED = "Review licence need"
MONITOR = "Monitor"
NO_ACTION = "No action"

RATIONALE = {
    "technician_unmatched": (
        "No matching PLM authentication record found for this Production Technician in the audit period."
    ),
    "technician_rare": "Production Technician matched to PLM but classified as Rare usage.",
    "technician_occasional": "Production Technician has occasional observed PLM usage.",
    "technician_regular": "Production Technician has regular observed PLM usage.",
    "dedicated": "User has observed PLM usage and ADU denied days above the dedicated-licence threshold.",
    "repeated": (
        "User has repeated ADU denial evidence but is below the high-confidence dedicated-licence threshold."
    ),
    "monitor": "User has ADU denial evidence but not repeated enough for automatic escalation.",
    "none": "No licence review trigger found.",
}
UNMATCHED_EVIDENCE = "No matching PLM authentication record found for Production Technician"
JUSTIFICATION_SUFFIX = (
    ". Provision is justified because the user has observed PLM usage and repeated failed "
    "attempts to obtain an ADU/shared licence."
)


def is_true(condition: Column) -> Column:
    """Three-valued to two-valued: an unknown condition counts as not met."""
    return F.coalesce(condition, F.lit(False))


def usage_category(average_active_days: Column, params: Params) -> Column:
    return (
        F.when(average_active_days >= params.regular_min_active_days, REGULAR)
        .when(average_active_days >= params.occasional_min_active_days, OCCASIONAL)
        .otherwise(RARE)
    )


def match_status(matched_user: Column) -> Column:
    return F.when(matched_user.isNotNull(), MATCHED).otherwise(UNMATCHED)


def technician_review_status(status: Column, category: Column) -> Column:
    return (
        F.when(~is_true(status == MATCHED), NO_AUTHENTICATION)
        .when(category == REGULAR, RETAIN_DEDICATED)
        .when(category == OCCASIONAL, REVIEW_BUSINESS_NEED)
        .otherwise(REMOVE_OR_REALLOCATE)
    )


def named_review_status(status: Column, category: Column) -> Column:
    return (
        F.when(~is_true(status == MATCHED), NO_LOGIN_ACTIVITY)
        .when(category == REGULAR, RETAIN_NAMED)
        .when(category == OCCASIONAL, REVIEW_NAMED)
        .otherwise(TRANSFER_TO_SHARED)
    )


def repeated_denials(denied_days: Column, denied_attempts: Column, params: Params) -> Column:
    return (denied_days >= params.repeated_denied_days) | (
        denied_attempts >= params.repeated_denied_attempts
    )


def dedicated_candidate(denied_days: Column, category: Column, params: Params) -> Column:
    return is_true(
        (denied_days >= params.dedicated_denied_days) & category.isin(REGULAR, OCCASIONAL)
    )


def user_group(is_technician: Column, has_denials: Column) -> Column:
    return F.concat_ws(
        " + ",
        F.when(is_technician, "Production Technician"),
        F.when(has_denials, "ADU Denied"),
    )


def recommendation(
    *,
    category: Column,
    is_technician: Column,
    technician_status: Column,
    has_denials: Column,
    denied_attempts: Column,
    denied_days: Column,
    params: Params,
) -> Column:
    """First rule that holds, as ``struct(recommendation, rationale)``."""

    def outcome(label: str, reason: str) -> Column:
        return F.struct(
            F.lit(label).alias("recommendation"), F.lit(RATIONALE[reason]).alias("rationale")
        )

    return (
        F.when(
            is_technician & ~is_true(technician_status == MATCHED),
            outcome(REMOVE_OR_REALLOCATE, "technician_unmatched"),
        )
        .when(is_technician & (category == RARE), outcome(REMOVE_OR_REALLOCATE, "technician_rare"))
        .when(
            is_technician & (category == OCCASIONAL),
            outcome(REVIEW_BUSINESS_NEED, "technician_occasional"),
        )
        .when(is_technician & (category == REGULAR), outcome(RETAIN_DEDICATED, "technician_regular"))
        .when(
            has_denials & dedicated_candidate(denied_days, category, params),
            outcome(ALLOCATE_DEDICATED, "dedicated"),
        )
        .when(
            has_denials & repeated_denials(denied_days, denied_attempts, params),
            outcome(REVIEW_NEED, "repeated"),
        )
        .when(has_denials, outcome(MONITOR, "monitor"))
        .otherwise(outcome(NO_ACTION, "none"))
    )


def evidence_summary(
    *,
    category: Column,
    login_days: Column,
    active_months: Column,
    denied_attempts: Column,
    denied_days: Column,
    technician_status: Column,
) -> Column:
    """Up to three clauses joined by ``; ``. Clauses that do not apply are NULL and fall away."""
    usage = F.when(
        category != "",
        F.concat(
            category,
            F.lit(" PLM usage: "),
            count_phrase(login_days, "active day"),
            F.lit(" across "),
            count_phrase(active_months, "active month"),
        ),
    )
    denials = F.when(
        denied_attempts != 0,
        F.concat(
            F.lit("ADU access blocked "),
            count_phrase(denied_attempts, "time"),
            F.lit(" across "),
            count_phrase(denied_days, "day"),
        ),
    )
    unmatched = F.when(technician_status == UNMATCHED, UNMATCHED_EVIDENCE)
    return F.concat_ws("; ", usage, denials, unmatched)


def first_filled(*columns: Column) -> Column:
    """First value that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(column, F.lit("")) for column in columns], F.lit(""))


def row_highlight(is_technician: Column, is_candidate: Column) -> Column:
    """Highlight of a user row; the dedicated-candidate colour wins over the technician colour."""
    return F.when(is_candidate, "dedicated").when(is_technician, "technician")
