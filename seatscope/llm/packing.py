"""Packing token sequences by the sum-of-squares rule.

Each task packs its own documents online. ``levels[h]`` counts its open windows with ``h`` tokens. A
document goes to the level, or to a new window, that makes the sum of the squared counts smallest,
so that no fill level piles up and most windows end exactly full. Documents of a window or more
first give off whole windows; only their remainder is placed.

When the input ends, or more than ``max_open`` windows are open, the open windows are settled: the
emptiest give their pieces away to fill the others, cut where needed, and what is then left is cut
into windows whose lengths are powers of two, which need no padding.

Defined results: a null or empty text is one end-of-document token; repeated documents are packed each
on its own; an empty table gives no windows; ids may be null. A task that runs again after a loss
reads the same rows in the same order and so gives the same windows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from seatscope.llm.frames import tidy
from seatscope.llm.words import LOWER, Words, blocks, word_hashes

WINDOW = 4096
END_ID = 2
MAX_OPEN = 1024
_CACHED_SPANS = 300_000
_WORDS_AT_ONCE = 100
_ENCODED_BYTES = 2 << 20
_NOT_BREAK = np.ones(256, bool)
_NOT_BREAK[[0x20, 0x0A]] = False
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_NEVER = 1 << 60


class WordEncoder:
    """Encodes texts in spans, each new span once.

    The vocabulary drops white space and no token crosses it, nor the step from a letter to a
    punctuation mark, so a text's ids are those of its spans in turn. It ignores case, so ASCII is
    lowered first. Blocks with ``<|``, with which special tokens begin, are cut at white space only
    and keep their case. Known spans are found by a 64-bit hash. New ones that are letters only are
    one piece each for the tokenizer and are encoded many at a time; all others go alone.
    """

    def __init__(self, tokenizer_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends_word[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self._known = np.zeros(0, np.uint64)  # hashes in order
        self._number = np.zeros(0, np.int64)
        self._first = np.zeros(1, np.int64)  # the ids of span i: _ids[_first[i] : _first[i + 1]]
        self._ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, spans: list[str]) -> None:
        plain = np.array([span.isalpha() and max(span) < "\u0130" for span in spans], bool)
        words = [span for span, yes in zip(spans, plain) if yes]
        joined = [" ".join(words[at : at + _WORDS_AT_ONCE]) for at in range(0, len(words), _WORDS_AT_ONCE)]
        odd = [span for span, yes in zip(spans, plain) if not yes]
        encode = self._tokenizer.encode_batch_fast
        lengths, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for found in encode(joined, add_special_tokens=False):
            ids.append(np.array(found.ids, np.uint32))
            lengths.append(np.diff(np.flatnonzero(self._ends_word[ids[-1]]), prepend=-1))
        for found in encode(odd, add_special_tokens=False):
            lengths.append(np.array([len(found.ids)]))
            ids.append(np.array(found.ids, np.uint32))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        known = np.append(self._known, hashes[order])
        number = np.append(self._number, len(self._number) + np.arange(len(spans)))
        by_hash = np.argsort(known)
        self._known, self._number = known[by_hash], number[by_hash]
        self._first = np.append(self._first, self._first[-1] + np.cumsum(np.concatenate(lengths)))
        self._ids = np.concatenate([self._ids, *ids])

    def _numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the spans, and which are known."""
        if not len(self._known):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self._known, hashes), len(self._known) - 1)
        return self._number[at], self._known[at] == hashes

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, with the end-of-document id."""
        for block in blocks(texts, _ENCODED_BYTES):
            raw = block.data.tobytes()
            ordinary = b"<|" not in raw
            if ordinary:
                raw = LOWER[block.data].tobytes()
            data = np.frombuffer(raw, np.uint8)
            spans = find_spans(data, block.offsets, cut_words=ordinary)
            hashes, first_seen, which = np.unique(word_hashes(data, spans), return_index=True, return_inverse=True)
            if len(self._known) > _CACHED_SPANS:
                self._forget()
            numbers, known = self._numbers(hashes)
            if not known.all():
                seen = first_seen[~known]
                ranges = zip(spans.starts[seen].tolist(), spans.ends[seen].tolist())
                self._learn(hashes[~known], [raw[a:b].decode() for a, b in ranges])
                numbers, _ = self._numbers(hashes)
            first = self._first[numbers][which]
            length = self._first[numbers + 1][which] - first
            ends = np.cumsum(length)
            ids = self._ids[np.arange(length.sum()) + np.repeat(first - ends + length, length)]
            borders = np.append(0, ends)[spans.rows]
            for a, b in zip(borders[:-1], borders[1:]):
                yield np.append(ids[a:b], np.uint32(END_ID))


def find_spans(data: np.ndarray, offsets: np.ndarray, cut_words: bool = True) -> Words:
    """Runs without space or line feed, cut where a known letter meets an ASCII punctuation mark."""
    inside = _NOT_BREAK[data]
    letter = _ASCII_LETTER[data]
    accented = (data >= 0x80) & (data < 0xC0) & (data != 0x97) & (data != 0xB7)
    letter[1:] |= accented[1:] & (data[:-1] == 0xC3)  # U+00C0 to U+00FF but the two signs
    cut = np.zeros(len(data) + 1, bool)  # a span begins here if inside
    cut[1:-1] = ~inside[:-1] | (cut_words & _PUNCTUATION[data[1:]] & letter[:-1])
    cut[offsets] = True
    cut[0] = True
    starts = np.flatnonzero(inside & cut[:-1])
    finish = inside.copy()
    finish[:-1] &= ~inside[1:] | cut[1:-1]
    return Words(starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets))


@dataclass(slots=True)
class Piece:
    doc: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, length: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc, self.start, self.ids[:length], self.doc_tokens),
            Piece(self.doc, self.start + length, self.ids[length:], self.doc_tokens),
        )


class SumOfSquares:
    """Online packer; ``add`` and ``finish`` give the windows that are complete, as lists of pieces."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN) -> None:
        self.window, self.max_open = window, max_open
        self.levels = np.zeros(window + 1, np.int64)  # places 0 and window stay zero
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0

    def best_level(self, size: int) -> int:
        """The level to place ``size`` tokens at; 0 opens a window. Ties go to the fullest level."""
        last = self.window - size
        change = 2 * (self.levels[size : self.window + 1] - self.levels[: last + 1] + 1)
        change[-1] -= 1  # a full window leaves the sum
        change[self.levels[: last + 1] == 0] = _NEVER
        fresh = 2 * self.levels[size] + 1 if size < self.window else 0
        at = last - int(np.argmin(change[::-1]))
        return at if change[at] <= fresh else 0

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        piece = Piece(doc, 0, ids, len(ids))
        while len(piece.ids) >= self.window:
            whole, piece = piece.cut(self.window)
            yield [whole]
        size = len(piece.ids)
        if not size:
            return
        level = self.best_level(size)
        pieces = self._take(level) if level else []
        pieces.append(piece)
        if level + size == self.window:
            yield pieces
            return
        self._put(level + size, pieces)
        if self.n_open > self.max_open:
            yield from self.settle(keep_rest=True)

    def _take(self, level: int) -> list[Piece]:
        self.levels[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _put(self, level: int, pieces: list[Piece]) -> None:
        self.levels[level] += 1
        self.n_open += 1
        self.open.setdefault(level, []).append(pieces)

    def settle(self, keep_rest: bool = False) -> Iterator[list[Piece]]:
        """Fill the fullest windows with the pieces of the emptiest until one is left at most."""
        order = [level for level in np.flatnonzero(self.levels)[::-1] for _ in range(self.levels[level])]
        windows = [self._take(int(level)) for level in order]
        supply: list[Piece] = []
        while windows:
            pieces = windows.pop(0)
            room = self.window - sum(len(p.ids) for p in pieces)
            while room and (supply or windows):
                if not supply:
                    supply = windows.pop()
                piece = supply.pop()
                if len(piece.ids) > room:
                    piece, rest = piece.cut(room)
                    supply.append(rest)
                pieces.append(piece)
                room -= len(piece.ids)
            if not windows and supply:
                windows, supply = [supply], []
            if not room:
                yield pieces
            elif keep_rest:
                self._put(self.window - room, pieces)
            else:
                yield from self._powers_of_two(pieces)

    def _powers_of_two(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        left = sum(len(p.ids) for p in pieces)
        pieces = pieces[::-1]
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            window: list[Piece] = []
            while room:
                piece = pieces.pop()
                if len(piece.ids) > room:
                    piece, rest = piece.cut(room)
                    pieces.append(rest)
                window.append(piece)
                room -= len(piece.ids)
            yield window

    def finish(self) -> Iterator[list[Piece]]:
        yield from self.settle()


def _rows(windows: Iterable[list[Piece]], base: int) -> Iterator[tuple]:
    for number, window in enumerate(windows):
        offset = 0
        for piece in window:
            ids = np.ascontiguousarray(piece.ids, "<u4")
            yield piece.doc, piece.start, len(ids), zlib.crc32(ids), piece.doc_tokens, base + number, offset, ids
            offset += len(ids)


_NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
SCHEMA = ", ".join(f"{name} long" for name in _NAMES)
_ROWS_OUT = 4096


def _batches(rows: Iterator[tuple], with_ids: bool) -> Iterator[pa.RecordBatch]:
    width = len(_NAMES) + with_ids
    kinds = [pa.int64()] * len(_NAMES) + [pa.list_(pa.int32())] * with_ids
    waiting: list[tuple] = []
    for row in chain(rows, (None,)):
        if row is not None:
            waiting.append(row[:width])
        if waiting and (row is None or len(waiting) >= _ROWS_OUT):
            columns = [pa.array(values, kind) for values, kind in zip(zip(*waiting), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=[*_NAMES, "ids"][:width])
            waiting = []


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = WINDOW,
    max_open: int = MAX_OPEN,
    with_ids: bool = False,
    encoder: Callable[[str], Callable[[pa.Array], Iterator[np.ndarray]]] = WordEncoder,
) -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence; ``with_ids`` adds its ids."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer_path), SumOfSquares(window, max_open)

        def windows() -> Iterator[list[Piece]]:
            for batch in batches:
                for doc, tokens in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text"))):
                    yield from packer.add(doc, tokens)
            yield from packer.finish()

        yield from _batches(_rows(windows(), TaskContext.get().partitionId() << 40), with_ids)

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(tidy(packed), schema)
