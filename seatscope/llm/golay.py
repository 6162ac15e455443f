"""The perfect binary Golay code of length 23, as lookup tables for fuzzy hashing.

Every 23-bit word lies within three errors of exactly one of 4096 codewords. A word with at most two
errors gets that codeword's index; a word with three also gets the five codewords at distance four.
Words that differ in at most two bits then always share an index (checked for all of them in tests).
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH = 23
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_PARITY = 11


def _remainders(words: np.ndarray) -> np.ndarray:
    """Words as polynomials over two elements, modulo the generator."""
    left = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, _PARITY - 1, -1):
        left ^= np.where(left >> bit & 1, _GENERATOR << (bit - _PARITY), 0)
    return left


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By remainder: masks that turn a word into its codewords (2048 x 6), and how many hold (1 or 6)."""
    errors = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(LENGTH), n)])
    leader = np.zeros(1 << _PARITY, np.int64)
    leader[_remainders(errors)] = errors
    messages = np.arange(1 << (LENGTH - _PARITY), dtype=np.int64) << _PARITY
    codewords = messages ^ _remainders(messages)
    sevens = codewords[np.bitwise_count(codewords) == 7]
    masks, held = np.zeros((1 << _PARITY, 6), np.int64), np.ones(1 << _PARITY, np.int64)
    masks[:, 0] = leader
    for place in np.flatnonzero(np.bitwise_count(leader) == 3):
        around = sevens[(sevens & leader[place]) == leader[place]]
        masks[place, 1:] = leader[place] ^ around
        held[place] = 6
    return masks, held


@lru_cache(maxsize=1)
def _remainder_table() -> np.ndarray:
    return _remainders(np.arange(1 << LENGTH)).astype(np.int16)


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the position it came from and one codeword index, once for every index it has."""
    masks, held = tables()
    place = _remainder_table()[words]
    count = held[place]
    row = np.repeat(np.arange(len(words)), count)
    slot = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, (words[row] ^ masks[place[row], slot]) >> _PARITY
