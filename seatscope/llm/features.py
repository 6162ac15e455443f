"""Shape features of whole texts, the same for every text of equal bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from seatscope.llm.words import LOWER, NON_SPACE, Words, blocks, find_words, mix, word_hashes

NAMES = (
    "log_words", "word_bytes", "symbol_share", "upper_share", "digit_share", "mark_share", "stop_share",
    "pipe_share", "other_ascii_share", "wide_share", "short_words", "lines_per_word", "distinct_words",
    "top_word", "repeated_windows", "repeated_lines",
)
_WINDOW = 5


def _table(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in characters]] = True
    return table


_SYMBOLS, _PIPES, _MARKS, _STOPS = _table("#*$%&<>@^~"), _table("|"), _table("!?"), _table(".,;:")
_UPPER, _DIGITS = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGITS[0x30:0x3A] = True
_LOWER_CASE = np.zeros(256, bool)
_LOWER_CASE[0x61:0x7B] = True
_WIDE = np.arange(256) >= 0x80
_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def _per_row(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(marked))[offsets])


def _group_sizes(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct (row, hash) its row and how often it stands there."""
    _, first, sizes = np.unique(
        mix(hashes + np.uint64(0x9E3779B97F4A7C15) * row.astype(np.uint64)), return_index=True, return_counts=True
    )
    return row[first], sizes


def _repeats(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the largest group and the members of groups of two or more, per row."""
    owner, sizes = _group_sizes(hashes, row)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, owner, sizes)
    many = np.bincount(owner, sizes * (sizes > 1), rows)
    return np.bincount(owner, minlength=rows), top, many


def _windows(hashes: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    row = words.row_of_word()
    if len(hashes) < _WINDOW:
        return hashes[:0], row[:0]
    combined = np.zeros(len(hashes) - _WINDOW + 1, np.uint64)
    for step in range(_WINDOW):
        combined = mix(combined + hashes[step : len(hashes) - _WINDOW + 1 + step])
    whole = row[: len(combined)] == row[_WINDOW - 1 :]
    return combined[whole], row[: len(combined)][whole]


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` per text; a text without words has zeros."""
    parts = [np.zeros((0, len(NAMES)))]
    for block in blocks(texts):
        data, offsets, rows = block.data, block.offsets, block.rows
        words = find_words(data, offsets, NON_SPACE)
        lowered = LOWER[data]
        hashes = word_hashes(lowered, words)
        lines = find_words(data, offsets, _LINE)
        n_words = words.counts
        per_word = 1 / np.maximum(n_words, 1)
        length = words.ends - words.starts
        full = np.append(0, np.cumsum(length))[words.rows]
        inked = np.diff(full)
        per_byte = 1 / np.maximum(inked, 1)
        counts = [
            _per_row(table[data], offsets) for table in (_SYMBOLS, _UPPER, _DIGITS, _MARKS, _STOPS, _PIPES, _LOWER_CASE, _WIDE)
        ]
        symbols, upper, digits, marks, stops, pipes, small, wide = counts
        short = np.diff(np.append(0, np.cumsum(length <= 3))[words.rows])
        row = words.row_of_word()
        distinct, top, _ = _repeats(hashes, row, rows)
        gram, gram_row = _windows(hashes, words)
        _, _, again = _repeats(gram, gram_row, rows)
        line_hashes = word_hashes(data, lines)
        _, _, line_again = _repeats(line_hashes, lines.row_of_word(), rows)
        parts.append(
            np.column_stack([
                np.log1p(n_words), inked * per_word, symbols * per_byte, upper / np.maximum(upper + small, 1),
                digits * per_byte, marks * per_byte, stops * per_byte, pipes * per_byte,
                (inked - sum(counts)) * per_byte * (n_words > 0), wide * per_byte, short * per_word,
                lines.counts * per_word, distinct * per_word, top * per_word, again * per_word,
                line_again / np.maximum(lines.counts, 1),
            ]) * (n_words > 0)[:, None]
        )
    return np.concatenate(parts)
