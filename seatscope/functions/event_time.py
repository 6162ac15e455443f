"""Event-time text: suffix removal and strict parsing to wall-clock timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seatscope.functions.text import WHITESPACE_CLASS

# The accepted shapes. Almost all rows have the first one, which Spark's own cast reads.
# Seconds 60 and 61 are a shape of their own.
_FULL_WIDTH = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-5][0-9]\z"
_DATE = r"([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})"
_MINUTE = r"([0-9]{1,2}:[0-9]{1,2}):"
_ANY_WIDTH = rf"\A(?:{_DATE}{WHITESPACE_CLASS}+{_MINUTE}([0-5]?[0-9])|[\s\S]*)\z"
_LEAP = rf"\A(?:{_DATE}{WHITESPACE_CLASS}+{_MINUTE}6([01])|[\s\S]*)\z"


def remove_suffix(text: Column, suffix: str) -> Column:
    """Remove a suffix once, with no trimming afterwards."""
    shortened = F.left(text, F.char_length(text) - len(suffix))
    return F.when(text.endswith(suffix), shortened).otherwise(text)


def _within_nanosecond_range(stamp: Column) -> Column:
    """NULL for times that a 64-bit count of nanoseconds since 1970 cannot hold."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.try_multiply(stamp - epoch, F.lit(1000)) / 1000


def parse_event_time(text: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` to TIMESTAMP_NTZ, NULL for anything else.

    One- and two-digit parts are accepted, as is a run of whitespace between date and time; seconds
    60 and 61 roll over into the next minute. Fractions, zones, ``T`` and bare dates are refused.
    """
    any_width = F.regexp_replace(text, _ANY_WIDTH, "$1 $2:$3").try_cast("timestamp_ntz")
    leap = F.regexp_replace(text, _LEAP, "$1 $2:0$3").try_cast("timestamp_ntz")
    stamp = F.when(text.rlike(_FULL_WIDTH), text.try_cast("timestamp_ntz")).otherwise(
        F.coalesce(any_width, leap + F.expr("INTERVAL '1' MINUTE"))
    )
    return _within_nanosecond_range(stamp)


def month_of(column: Column) -> Column:
    """``YYYY-MM`` of a date or timestamp."""
    return F.left(column.cast("date").cast("string"), F.lit(7))
