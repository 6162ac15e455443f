"""Run parameters. Plain values; nothing here touches data."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

# Text cells that a spreadsheet or CSV reader takes as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


@dataclass(frozen=True)
class Source:
    """Where an input lives: a path (or catalog table) and how to read it."""

    path: str
    format: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    order_column: str | None = None


@dataclass(frozen=True)
class Exclusions:
    """Users left out of the review.

    ``exact`` and ``contains`` are given in code and become literals in the scan filter. ``table``
    is a ``(kind, value)`` table, such as that of an exclusions file, and is joined.
    """

    exact: tuple[str, ...] = ()
    contains: tuple[str, ...] = ()
    table: DataFrame | None = None


@dataclass(frozen=True)
class Params:
    """Everything a run can vary."""

    login: Source | None = None
    denials: Source | None = None
    named: Source | None = None
    technicians: Source | None = None
    output_path: str = "output/licence_review"

    user_column: str = "User Name"
    timestamp_column: str = "Event Time"
    denial_user_column: str = "User Name"
    denial_timestamp_column: str = "Event Time"
    denial_label_column: str = "Event Label"
    denial_label: str = "Login Denied - Insufficient ADU License"
    named_user_column: str = "User"
    named_licence_column: str = "Allocated License"
    technician_name_column: str = "Full Name"
    shared_licence: str = "PTC Navigate Contributor - ADU"

    lowercase_users: bool = False
    timestamp_suffixes: tuple[str, ...] = (" BST", " GMT")
    missing_tokens: tuple[str, ...] = MISSING_TOKENS
    exclusions: Exclusions = Exclusions()
    time_zone: str = "UTC"  # in which typed instants are read as wall-clock times

    regular_min_active_days: float = 8.0
    occasional_min_active_days: float = 2.0
    recent_days: int = 90
    repeated_denied_days: int = 2
    repeated_denied_attempts: int = 3
    dedicated_denied_days: int = 10
    name_part_rows: int = 1000  # denied users of one name that one task joins with users of that name


def build_params(
    *,
    file_exclusions: Exclusions | None = None,
    **overrides: object,
) -> Params:
    """Defaults with overrides. An empty override keeps the default; ``False`` and ``0`` are values.

    Excluded users are those of the file, if given, and there are no built-in ones.
    """
    known = {f.name for f in fields(Params)}
    unknown = sorted(set(overrides) - known)
    if unknown:
        raise TypeError(f"Unknown parameters: {', '.join(unknown)}")
    kept = {name: value for name, value in overrides.items() if value not in (None, "", ())}
    kept.setdefault("exclusions", file_exclusions or Exclusions())
    return replace(Params(), **kept)
