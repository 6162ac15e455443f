"""Whole texts as blocks of bytes, cut into words with numpy.

A block holds the texts of consecutive rows end to end. Blocks are cut by bytes, so the memory of a
task follows ``BLOCK_BYTES`` or the longest single text, not the number of rows in an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20

_SPACES = [0x20, *range(0x09, 0x0E)]
# [^\x20\x09-\x0D]+: every byte of a multi-byte character is outside ASCII, so bytes decide.
NON_SPACE = np.ones(256, bool)
NON_SPACE[_SPACES] = False
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ : digits, lower-case letters, anything outside ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_LANE_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LONG_WORD = 256  # bytes, from which on words are hashed one by one


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@dataclass(frozen=True)
class Block:
    """Rows ``first`` to ``last`` of a batch: ``data`` holds their bytes, ``offsets`` where each begins."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        limit = offsets[first] + block_bytes
        last = max(first + 1, int(np.searchsorted(offsets, limit, "right")) - 1)
        last = min(last, len(column))
        yield Block(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@dataclass(frozen=True)
class Words:
    """Byte ranges of the words of a block; words ``rows[i]`` to ``rows[i + 1]`` are those of row i."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)


def find_words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> Words:
    """Maximal runs of bytes marked in ``in_word``; no word crosses from one row into the next."""
    inside = in_word[data]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begins[first] = inside[first]
    finishes[last] = inside[last]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, words: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands; never zero.

    Eight bytes at a time are mixed into a state by a non-linear bijection, so there are no strings that
    collide by construction of the hash, as there are for polynomials modulo 2**64.
    """
    if not len(words.starts):
        return np.zeros(0, np.uint64)
    padded = np.append(data, np.zeros(8, np.uint8))
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    length = words.ends - words.starts
    hashed = mix(length.astype(np.uint64) * _LANE_MULTIPLIER + np.uint64(seed + 1))
    left, at, which = length, words.starts, np.arange(len(length))
    short = length < _LONG_WORD
    if not short.all():
        raw = data.tobytes()
        for i in np.flatnonzero(~short).tolist():
            digest = blake2b(raw[words.starts[i] : words.ends[i]], digest_size=8, salt=seed.to_bytes(8)).digest()
            hashed[i] = int.from_bytes(digest)
        left, at, which = left[short], at[short], which[short]
    while len(which):
        lane = lanes[at]
        cut = np.maximum(8 - left, 0).astype(np.uint64) * np.uint64(8)  # bits of the lane beyond the word
        lane = (lane << cut) >> cut
        hashed[which] = mix((hashed[which] ^ lane) * _LANE_MULTIPLIER + np.uint64(1))
        more = left > 8
        left, at, which = left[more] - 8, at[more] + 8, which[more]
    hashed[hashed == 0] = 1
    return hashed
