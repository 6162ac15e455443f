from __future__ import annotations

import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from seatscope.llm.feistel import Permutation
from seatscope.llm.pii import Pseudonymiser, iban_remainder, luhn_digit, pseudonymise

KEY = b"sixteen bytes or"
SWAP = Pseudonymiser(KEY)


@pytest.mark.parametrize("size", [1, 2, 7, 100, 999])
def test_permutation_is_a_bijection_with_an_inverse(size):
    permutation = Permutation(KEY, "test", size)
    images = [permutation(n) for n in range(size)]
    assert sorted(images) == list(range(size))
    assert [permutation.inverse(n) for n in images] == list(range(size))


def test_permutation_within_a_subset_and_by_key():
    even = Permutation(KEY, "test", 100, lambda n: n % 2 == 0)
    assert sorted(even(n) for n in range(0, 100, 2)) == list(range(0, 100, 2))
    with pytest.raises(ValueError):
        even(3)
    other = Permutation(b"another key here", "test", 10**6)
    assert [other(n) for n in range(9)] != [Permutation(KEY, "test", 10**6)(n) for n in range(9)]


VALUES = [
    "und.34@mail7.example.com", "É.x-1@a.b.org", "4845168114407329", "3782-822463-10005", "4012 8888 8888 1881",
    "97.51.17.173", "+1 (017) 555-7713", "+14155552671", "415-555-2671", "2024-02-29", "1999/12/31", "29.2.2024",
    "12/31/1999", "01.01.1900", "123-45-6789", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432",
]


@pytest.mark.parametrize("value", VALUES)
def test_values_change_within_their_format_and_come_back(value):
    text = f"before {value}, after {value}"
    new, count = SWAP(text)
    assert count == 2 and len(new) == len(text) and value not in new
    swapped = new[7 : 7 + len(value)]
    assert new == f"before {swapped}, after {swapped}"
    assert re.sub("[0-9]", "9", swapped)[:0] == "" and [c.isdigit() for c in swapped] == [c.isdigit() for c in value]
    assert SWAP(new, restore=True) == (text, 2)
    assert SWAP(swapped)[1] == 1  # still a valid value of its kind


@pytest.mark.parametrize(
    "text",
    [
        "9807915762804490", "2024-02-30", "1.2.3.400", "01.2.3.4", "666-12-3456", "DE00 3704 0044 0532 0130 00", "v1.2", "10:30",
        "12345678901234567890", "a@b", "page 12-13", "31/13/1999", "2150-01-01", "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda",
    ],
)
def test_what_is_not_valid_stays(text):
    assert SWAP(text) == (text, 0)


@pytest.mark.parametrize(
    "value,after",
    [
        ("DE89370400440532013000", " BIC COBADEFFXXX"), ("DE89 3704 0044 0532 0130 00", " AND MORE"),
        ("DE89370400440532013000", " 2024"), ("DE89370400440532013000", " GB"), ("GB82WEST12345698765432", " A B1 C"),
    ],
)
def test_bank_accounts_before_capitals_and_digits(value, after):
    new, count = SWAP(f"X {value}{after}")
    swapped = new[2 : 2 + len(value)]
    compact = swapped.replace(" ", "")
    assert count == 1 and new == f"X {swapped}{after}" and swapped != value
    assert iban_remainder(compact[:2], compact[2:4], compact[4:]) == 1
    assert SWAP(new, restore=True) == (f"X {value}{after}", 1)


def test_values_after_what_only_looks_like_a_bank_account():
    text = "AB12 4845168114407329 and DE00 DE89 3704 0044 0532 0130 00 END"
    new, count = SWAP(text)
    assert count == 2 and new[:5] == text[:5] and new[5:21] != text[5:21] and new[-4:] == " END"
    assert SWAP(new, restore=True) == (text, 2)


PHONES = [
    "+33 1 23 45 67 89", "+34 612 34 56 78", "+34 91 123 45 67", "+44 (0)20 7946 0958", "+49 30 1234 5678 90", "+1 415 555 2671",
    "06 12 34 56 78", "01.23.45.67.89", "030 1234567", "0221/123456", "555 123 4567", "612 34 56 78", "91 123 45 67", "612 345 678",
]


@pytest.mark.parametrize("value", PHONES)
def test_phones_of_several_countries(value):
    text = f"call {value}, or {value}."
    new, count = SWAP(text)
    swapped = new[5 : 5 + len(value)]
    assert count == 2 and new == f"call {swapped}, or {swapped}." and swapped != value
    assert SWAP(new, restore=True) == (text, 2)


def test_a_year_after_a_phone_stays():
    new, count = SWAP("+1 (017) 555-7713 2024")
    assert count == 1 and new.endswith(" 2024")


def test_check_numbers():
    new = SWAP("4012 8888 8888 1881")[0].replace(" ", "")
    assert luhn_digit(new[:-1]) == int(new[-1])
    iban = SWAP("GB82WEST12345698765432")[0]
    assert iban_remainder(iban[:2], iban[2:4], iban[4:]) == 1
    assert SWAP("4012888888881881")[0] == new  # the same number in another format


@given(st.text(alphabet="0123456789-/. +()@ae\n", max_size=60))
def test_any_text_keeps_its_length_and_comes_back(text):
    new, count = SWAP(text)
    assert len(new) == len(text)
    if count:
        back, again = SWAP(new, restore=True)
        assert back == text or again != count  # new neighbours may form a value of their own


def test_rows_and_columns_stay(spark, documents, edge_rows):
    rows = [*edge_rows, (10, "ip 97.51.17.173"), (11, "97.51.17.173" * 1), (10, "ip 97.51.17.173")]
    docs = documents(rows, ("N_REPLACED int", 4))
    found = pseudonymise(docs, KEY)
    assert found.columns == [*docs.columns, "n_replaced_"]
    got = sorted(((r["doc_id"], r["text"], r["n_replaced_"], r["N_REPLACED"]) for r in found.collect()), key=str)
    assert got == sorted(((i, None if t is None else SWAP(t)[0], 0 if t is None else SWAP(t)[1], 4) for i, t in rows), key=str)
    back = pseudonymise(found.select(*docs.columns), KEY, count=None, restore=True)
    assert back.columns == docs.columns
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))
    assert pseudonymise(documents([]), KEY).count() == 0


@pytest.mark.parametrize("local,labels", [(64, 4), (64, 8), (9, 4), (40, 6)])
def test_long_addresses_leave_nothing_in_clear(local, labels):
    rng = random.Random(local)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    value = f"{letters(local)}@{'.'.join(letters(62) for _ in range(labels))}.com"
    new, count = SWAP(f"write to {value} now")
    assert count == 1 and SWAP(new, restore=True)[0] == f"write to {value} now"
    changed = new[len("write to ") : -len(" now")]
    assert len(changed) == len(value)
    # A letter stays with a chance of 1 in 26, at the beginning as anywhere.
    for at in range(0, len(value) - 20, 8):
        assert sum(a == b and a.isalpha() for a, b in zip(value[at : at + 16], changed[at : at + 16])) < 9
