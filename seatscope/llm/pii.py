"""Format-preserving pseudonyms for personal data.

Validated values are replaced by others of the same format through keyed Feistel permutations: card numbers
stay Luhn-valid, bank accounts keep a right check number, dates stay dates, addresses stay addresses.
Equal values get equal pseudonyms in every document, different values different ones, and who holds
the key can restore them. Numbers that only look the part (a card number with a wrong check digit)
are left alone. The length of a text never changes. Not found, and so left as they are: bank numbers in
small letters or with hyphens, addresses with accents after the ``@``, dates with names of months, IPv6.

Defined results: a null text stays null with no replacements; an empty text stays empty; rows are kept
one to one in any number, repeated rows get equal results; other columns pass through, and a counter
whose name is taken gets underscores.
"""

from __future__ import annotations

import re
import secrets
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from seatscope.llm.feistel import Permutation
from seatscope.llm.frames import free_name

FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()

_PATTERN = re.compile(
    r"""
    (?P<email>(?<![\w.+%-])[\w.+%-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-]))
  | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9]))
  | (?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))
  | (?P<iso>(?<![0-9/-])[0-9]{4}(?P<isosep>[-/])[0-9]{2}(?P=isosep)[0-9]{2}(?![0-9/-]))
  | (?P<day>(?<![0-9./-])[0-9]{1,2}(?P<daysep>[./-])[0-9]{1,2}(?P=daysep)[0-9]{4}(?![0-9/-]))
  | (?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))
  | (?P<card>(?<![0-9.])(?:[0-9]{13,19}|[0-9]{4}(?P<cardsep>[ -])[0-9]{4}(?P=cardsep)[0-9]{4}(?P=cardsep)[0-9]{1,7}
        |[0-9]{4}(?P<amex>[ -])[0-9]{6}(?P=amex)[0-9]{5})(?![0-9]))
  | (?P<phone>(?<![0-9A-Za-z+])(?:\+1(?:[ ./-]?\(?[0-9]\)?){10}|\+[0-9](?:[ ./-]?\(?[0-9]\)?){7,14}
        |(?:\([0-9]{3}\)[ ]?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4})(?![0-9]))
  | (?P<local>(?<![0-9A-Za-z+])(?<![0-9][ ./-])(?:0[1-9](?P<pairsep>[ .])[0-9]{2}(?:(?P=pairsep)[0-9]{2}){3}
        |0[1-9][0-9]{1,3}[ /][0-9]{5,8}|[2-9][0-9]{2}[ ][0-9]{3}[ ][0-9]{4}|[6-9][0-9]{2}[ ][0-9]{3}[ ][0-9]{3}
        |[6-9][0-9]{2}(?:[ ][0-9]{2}){3}|[6-9][0-9][ ][0-9]{3}(?:[ ][0-9]{2}){2})(?![ ./-]?[0-9])(?![A-Za-z]))
    """,
    re.VERBOSE,
)
# Characters of a bank account number by country; of other countries only a whole match is tried.
_IBAN_SIZES = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
        32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_MAY_MATCH = re.compile(r"[0-9@]")

_ALPHABETS = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7),
    "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7),
]
_ALPHABET_OF = {character: alphabet for alphabet in _ALPHABETS for character in alphabet}


def luhn_digit(payload: str) -> int:
    """The check digit that makes ``payload`` plus it valid."""
    doubled = [int(c) * (2 - i % 2) for i, c in enumerate(reversed(payload))]
    return -sum(d - 9 * (d > 9) for d in doubled) % 10


def iban_remainder(country: str, check: str, account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account + country + check)) % 97


def _iban_part(match: str) -> str:
    """The beginning of ``match`` that has the length of its country and ends with a word, else all of it."""
    size = _IBAN_SIZES.get(match[:2])
    ends = [i + 1 for i, c in enumerate(match) if c != " "]
    if size is None or size > len(ends):
        return match
    end = ends[size - 1]
    return match[:end] if match[end : end + 1] in ("", " ") else match


class Pseudonymiser:
    """Replaces and restores values under one key."""

    def __init__(self, key: bytes) -> None:
        if not 16 <= len(key) <= 64:
            raise ValueError("The key must have 16 to 64 bytes")
        self._key = key
        self._kinds: dict[str, Callable[[str, bool], str | None]] = {
            "email": self._email, "iban": self._iban, "ip": self._ip, "iso": self._iso, "day": self._day,
            "ssn": self._ssn, "card": self._card, "phone": self._phone, "local": self._local,
        }
        self._value = lru_cache(maxsize=1 << 14)(self._uncached)

    def __call__(self, text: str, restore: bool = False) -> tuple[str, int]:
        """The text with its values replaced (or restored), and their number."""
        if not _MAY_MATCH.search(text):
            return text, 0
        count, parts, copied, at = 0, [], 0, 0
        while match := _PATTERN.search(text, at):
            kind = next(k for k in self._kinds if match[k] is not None)
            value = _iban_part(match[0]) if kind == "iban" else match[0]
            new = self._value(kind, value, restore)
            at = match.start() + len(value)
            if new is not None:
                parts += [text[copied : match.start()], new]
                copied, count = at, count + 1
            elif kind == "iban":  # what it took may hold another value
                at = match.start() + 1
        return "".join([*parts, text[copied:]]), count

    def _uncached(self, kind: str, value: str, restore: bool) -> str | None:
        return self._kinds[kind](value, restore)

    def _permuted(self, kind: str, value: int, size: int, restore: bool, inside=None) -> int:
        permutation = Permutation(self._key, kind, size, inside)
        return permutation.inverse(value) if restore else permutation(value)

    def _mixed(self, kind: str, places: list[tuple[int, int]], restore: bool, inside=None) -> list[int]:
        """Permute (digit, base) places together as one number."""
        bases = [base for _, base in places]

        def digits(number: int) -> list[int]:
            found = []
            for base in reversed(bases):
                number, digit = divmod(number, base)
                found.append(digit)
            return found[::-1]

        number, size = 0, 1
        for digit, base in places:
            number, size = number * base + digit, size * base
        accept = inside and (lambda n: inside(digits(n)))
        name = f"{kind}:{','.join(map(str, bases))}"
        return digits(self._permuted(name, number, size, restore, accept))

    def _characters(self, kind: str, text: str, restore: bool) -> str:
        """Permute letters and digits within their alphabets; other characters stay."""
        at = [i for i, c in enumerate(text) if c in _ALPHABET_OF]
        alphabets = [_ALPHABET_OF[text[i]] for i in at]
        places = [(a.index(text[i]), len(a)) for i, a in zip(at, alphabets)]
        result = list(text)
        for i, a, digit in zip(at, alphabets, self._mixed(kind, places, restore)):
            result[i] = a[digit]
        return "".join(result)

    def _digits(self, kind: str, value: str, first: int, last: int, restore: bool, inside=None) -> str:
        """Permute digits ``first`` to ``last`` of ``value``, counted without what stands between them."""
        at = [i for i, c in enumerate(value) if c.isdigit()][first:last]
        new = self._mixed(kind, [(int(value[i]), 10) for i in at], restore, inside)
        result = list(value)
        for i, digit in zip(at, new):
            result[i] = str(digit)
        return "".join(result)

    def _email(self, value: str, restore: bool) -> str:
        body, top = value.rsplit(".", 1)
        return f"{self._characters('email', body, restore)}.{top}"

    def _iban(self, value: str, restore: bool) -> str | None:
        compact = value.replace(" ", "")
        country, check, account = compact[:2], compact[2:4], compact[4:]
        if iban_remainder(country, check, account) != 1:
            return None
        account = self._characters(f"iban{country}", account, restore)
        compact = f"{country}{98 - iban_remainder(country, '00', account):02d}{account}"
        left = iter(compact)
        return "".join(c if c == " " else next(left) for c in value)

    def _ip(self, value: str, restore: bool) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or str(int(p)) != p for p in parts):
            return None
        ranges = {1: (0, 10), 2: (10, 90), 3: (100, 156)}  # lowest number and count, by digits written
        lows = [ranges[len(p)][0] for p in parts]
        places = [(int(p) - low, ranges[len(p)][1]) for p, low in zip(parts, lows)]
        return ".".join(str(low + n) for low, n in zip(lows, self._mixed("ip", places, restore)))

    def _date(self, day: date, restore: bool, inside: Callable[[date], bool]) -> date:
        accept = lambda n: inside(date.fromordinal(FIRST_DAY + n))
        size = LAST_DAY - FIRST_DAY + 1
        return date.fromordinal(FIRST_DAY + self._permuted("date", day.toordinal() - FIRST_DAY, size, restore, accept))

    def _iso(self, value: str, restore: bool) -> str | None:
        day = _valid_date(int(value[:4]), int(value[5:7]), int(value[8:]))
        if day is None:
            return None
        new = self._date(day, restore, lambda d: True)
        return f"{new.year:04d}{value[4]}{new.month:02d}{value[7]}{new.day:02d}"

    def _day(self, value: str, restore: bool) -> str | None:
        """Day first, unless only month first makes a date; written places keep their widths."""
        separator = next(c for c in value if not c.isdigit())
        first, second, year = value.split(separator)
        day, day_first = _valid_date(int(year), int(second), int(first)), True
        if day is None:
            day, day_first = _valid_date(int(year), int(first), int(second)), False
        if day is None:
            return None

        def written(d: date) -> str | None:
            a, b = (d.day, d.month) if day_first else (d.month, d.day)
            if not day_first and d.day <= 12:
                return None  # would read as day first
            a, b = str(a).zfill(len(first)), str(b).zfill(len(second))
            return f"{a}{separator}{b}{separator}{d.year}" if (len(a), len(b)) == (len(first), len(second)) else None

        return written(self._date(day, restore, lambda d: written(d) is not None))

    def _ssn(self, value: str, restore: bool) -> str | None:
        def valid(d: list[int]) -> bool:
            area = d[0] * 100 + d[1] * 10 + d[2]
            return area not in (0, 666) and d[0] != 9 and any(d[3:5]) and any(d[5:])

        if not valid([int(c) for c in value if c.isdigit()]):
            return None
        return self._digits("ssn", value, 0, 9, restore, valid)

    def _card(self, value: str, restore: bool) -> str | None:
        digits = "".join(c for c in value if c.isdigit())
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != int(digits[-1]):
            return None
        new = self._digits("card", value, 0, len(digits) - 1, restore)
        return new[:-1] + str(luhn_digit("".join(c for c in new if c.isdigit())[:-1]))

    def _phone(self, value: str, restore: bool) -> str | None:
        """The country code, up to the first sign after ``+``, stays."""
        digits = sum(c.isdigit() for c in value)
        if not 8 <= digits <= 15:
            return None
        code = re.match(r"\+[0-9]{1,3}(?=[ .(-])", value)
        kept = len(code[0]) - 1 if code else (1 if value[0] == "+" else 0)
        return self._digits("phone", value, kept, digits, restore)

    def _local(self, value: str, restore: bool) -> str | None:
        """National forms; what tells them apart, the first digit or after a zero two, stays."""
        digits = sum(c.isdigit() for c in value)
        return self._digits("local", value, 2 if value[0] == "0" else 1, digits, restore)


def _valid_date(year: int, month: int, day: int) -> date | None:
    try:
        found = date(year, month, day)
    except ValueError:
        return None
    return found if FIRST_DAY <= found.toordinal() <= LAST_DAY else None


KEY_SETTING = "spark.seatscope.pseudonym.secret"  # Spark hides values of such names in its logs


@lru_cache
def _drawn_key(application: str) -> bytes:
    return secrets.token_bytes(32)


def session_key(spark: SparkSession) -> bytes:
    """The key in ``KEY_SETTING``, or else one drawn for this application alone.

    Pseudonyms under a drawn key are linked within the application, but nobody can restore them.
    """
    given = spark.conf.get(KEY_SETTING, None)
    return given.encode() if given else _drawn_key(spark.sparkContext.applicationId)


def pseudonymise(
    docs: DataFrame, key: bytes, column: str = "text", count: str | None = "n_replaced", restore: bool = False
) -> DataFrame:
    """All rows and columns of ``docs`` with ``column`` replaced, plus the ``count`` of values unless None."""
    extra = [] if count is None else [free_name(count, docs.columns)]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, T.LongType()) for name in extra)])
    at = docs.columns.index(column)

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swap = Pseudonymiser(key)
        for batch in batches:
            texts, counts = [], []
            for text in batch.column(at).to_pylist():
                new, number = (None, 0) if text is None else swap(text, restore)
                texts.append(new)
                counts.append(number)
            columns = [*batch.columns, *([pa.array(counts, pa.int64())] if extra else [])]
            columns[at] = pa.array(texts, batch.schema.types[at])
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *extra])

    return docs.mapInArrow(replaced, schema)
