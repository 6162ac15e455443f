from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from seatscope.llm.words import ALPHANUMERIC, LOWER, NON_SPACE, blocks, find_words, word_hashes

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB9é \n\t,.|東", max_size=40)), max_size=8)


def words_of(texts, table, lower=False, block_bytes=16):
    found = []
    for block in blocks(pa.array(texts, pa.string()), block_bytes):
        data = LOWER[block.data] if lower else block.data
        words = find_words(data, block.offsets, table)
        raw = data.tobytes()
        for a, b in zip(words.rows[:-1], words.rows[1:]):
            found.append([raw[s:e].decode() for s, e in zip(words.starts[a:b], words.ends[a:b])])
    return found


@given(TEXTS)
def test_words_equal_the_regular_expressions(texts):
    spaced = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert words_of(texts, NON_SPACE) == spaced
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    plain = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) for t in lower]
    assert words_of(texts, ALPHANUMERIC, lower=True) == plain


def test_equal_words_have_equal_hashes_and_no_others():
    texts = ["a b ab ba a", "ab " + "x" * 999 + " " + "x" * 998, "é a"]
    seen = {}
    for block in blocks(pa.array(texts), 10_000):
        words = find_words(block.data, block.offsets, NON_SPACE)
        raw = block.data.tobytes()
        for s, e, h in zip(words.starts, words.ends, word_hashes(block.data, words)):
            seen.setdefault(raw[s:e], set()).add(int(h))
    assert all(len(h) == 1 for h in seen.values())
    assert len({next(iter(h)) for h in seen.values()}) == len(seen)


def test_words_that_collide_under_polynomial_hashes():
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    text = f"{word} {word.translate(str.maketrans('ab', 'ba'))} {word[:128]} {word[128:256]}"
    (block,) = blocks(pa.array([text]), 1 << 20)
    assert len(set(word_hashes(block.data, find_words(block.data, block.offsets, NON_SPACE)).tolist())) == 4


def test_slices_and_empty_columns():
    column = pa.array(["skip", "one two", None, "three"]).slice(1)
    assert words_of(column.to_pylist(), NON_SPACE) == [["one", "two"], [], ["three"]]
    (block,) = blocks(column, 1 << 20)
    assert block.data.tobytes() == b"one twothree" and block.offsets.tolist() == [0, 7, 7, 12]
    assert list(blocks(pa.array([], pa.string()))) == []
    assert np.diff(find_words(np.zeros(0, np.uint8), np.array([0, 0]), NON_SPACE).rows).tolist() == [0]
