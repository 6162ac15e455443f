"""Text and number expressions shared by every table. Built-in Spark functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as whitespace in str.strip() and in a regex \s.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)


def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Case folds of lower-case characters that fold further: to one character, and to several."""
    one, several = {}, {}
    for code_point in range(0x80, 0x110000):
        character = chr(code_point)
        folded = character.casefold()
        if character == character.lower() and folded != character:
            (one if len(folded) == 1 else several)[character] = folded
    return one, several


_ONE_TO_ONE, FOLD_EXPANSIONS = _folds()
_FOLD_FROM, _FOLD_TO = "".join(_ONE_TO_ONE), "".join(_ONE_TO_ONE.values())
_EXPANDING = f"[{''.join(FOLD_EXPANSIONS)}]"


def is_ascii(column: Column) -> Column:
    return F.octet_length(column) == F.char_length(column)


def strip(column: Column) -> Column:
    """Remove leading and trailing whitespace, Unicode whitespace included.

    ASCII text that starts and ends above the space character has nothing to remove; telling so is
    cheaper than trimming.
    """
    bare = (column >= "!") & is_ascii(column) & (F.right(column, F.lit(1)) > " ")
    return F.when(bare, column).otherwise(F.btrim(column, F.lit(WHITESPACE)))


def fold(column: Column) -> Column:
    """Case-fold text. ASCII text, by far the most common, takes the short branch."""
    lowered = F.lower(column)
    folded = F.translate(lowered, _FOLD_FROM, _FOLD_TO)
    # Characters that fold to several are looked up one by one, in the few texts that have any.
    longer = F.map_from_arrays(
        F.array(*[F.lit(character) for character in FOLD_EXPANSIONS]),
        F.array(*[F.lit(expansion) for expansion in FOLD_EXPANSIONS.values()]),
    )
    expanded = F.array_join(
        F.transform(F.split(folded, ""), lambda c: F.coalesce(F.element_at(longer, c), c)), ""
    )
    return (
        F.when(is_ascii(column), lowered)
        .when(folded.rlike(_EXPANDING), expanded)
        .otherwise(folded)
    )


def fold_text(value: str) -> str:
    """The same folding for a parameter value on the driver."""
    folded = value.lower().translate(str.maketrans(_FOLD_FROM, _FOLD_TO))
    for character, expansion in FOLD_EXPANSIONS.items():
        folded = folded.replace(character, expansion)
    return folded


def name_key(column: Column) -> Column:
    """Matching key of a person name: stripped, case-folded, whitespace runs made one space."""
    single_spaced = F.regexp_replace(fold(strip(column)), WHITESPACE_CLASS + "+", " ")
    return F.coalesce(single_spaced, F.lit(""))


def display_name(column: Column) -> Column:
    """Name part of ``Name (Name: Organisation)``; the whole value where there is no such part."""
    head_and_rest = rf"\A([^\n]*?){WHITESPACE_CLASS}+\([\s\S]*\z"
    return strip(F.regexp_replace(column, head_and_rest, "$1"))


def round2(column: Column) -> Column:
    """Round to two decimals, ties to even after scaling."""
    return F.rint(column * 100) / 100


def count_phrase(count: Column, noun: str) -> Column:
    """``1 day`` / ``n days``."""
    return F.concat(count.cast("string"), F.lit(f" {noun}"), F.when(count == 1, "").otherwise("s"))
