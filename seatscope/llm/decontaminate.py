"""Benchmark decontamination with suffix arrays over the training text.

Each task cuts its documents into shards, sorts the word suffixes of a shard by prefix doubling to the
depth that a comparison can reach, and binary-searches every benchmark window in it. Equal suffixes lie
side by side, so one search gives all places where a window occurs; windows that follow each other
along one diagonal join into the longest verbatim match. Documents stay whole and in place: nothing
is shuffled.

The benchmark reaches the tasks in blocks of bounded size (``block_bytes`` of text each); more blocks
mean more passes over a shard, with the hits of earlier ones carried along. Words are compared by a
64-bit hash.

Defined results: null, empty or wordless texts have no words and no hits; a wordless item never occurs;
an item with a null id is listed as empty text; repeated items count once per id; repeated documents
each get a row; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatscope.llm.frames import tidy
from seatscope.llm.words import ALPHANUMERIC, LOWER, blocks, find_words, word_hashes

WINDOW_WORDS = 13
BLOCK_BYTES = 16 << 20

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("longest_item", T.StringType()),
        T.StructField("longest_words", T.LongType()),
        T.StructField("longest_at", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Windows:
    """Distinct windows of a benchmark block, and where each came from."""

    words: np.ndarray  # one row per window, zero-padded
    lengths: np.ndarray
    first: np.ndarray  # origins of window i: items[first[i] : first[i + 1]]
    items: np.ndarray
    offsets: np.ndarray
    names: list[str]


def benchmark_windows(texts: pa.Array, names: list[str], width: int = WINDOW_WORDS) -> Windows:
    rows, lengths, items, offsets = [], [], [], []
    for block in blocks(texts):
        data = LOWER[block.data]
        found = find_words(data, block.offsets, ALPHANUMERIC)
        hashes = word_hashes(data, found)
        for item in range(block.rows):
            own = hashes[found.rows[item] : found.rows[item + 1]]
            if not len(own):
                continue
            size = min(width, len(own))
            cut = np.lib.stride_tricks.sliding_window_view(own, size)
            rows.append(np.pad(cut, ((0, 0), (0, width - size))))
            lengths.append(np.full(len(cut), size))
            items.append(np.full(len(cut), block.first + item))
            offsets.append(np.arange(len(cut)))
    if not rows:
        none = np.zeros(0, np.int64)
        return Windows(np.zeros((0, width), np.uint64), none, np.zeros(1, np.int64), none, none, names)
    words, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    which = which.ravel()
    order = np.argsort(which, kind="stable")
    size = np.zeros(len(words), np.int64)
    size[which] = np.concatenate(lengths)
    first = np.searchsorted(which[order], np.arange(len(words) + 1))
    return Windows(words, size, first, np.concatenate(items)[order], np.concatenate(offsets)[order], names)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, compared over at least ``depth`` words."""
    size = len(words)
    order = np.argsort(words)
    rank, reach = _ranks(order, words[order]), 1
    while reach < depth and rank.max(initial=0) < size - 1:
        follower = np.zeros(size, np.int64)
        follower[: size - reach] = rank[reach:] + 1
        pair = rank * (size + 1) + follower
        order = np.argsort(pair)
        rank, reach = _ranks(order, pair[order]), 2 * reach
    return order


def _ranks(order: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order[:1]] = 0
    rank[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1])
    return rank


def _bound(padded, order, words, lengths, upper: bool) -> np.ndarray:
    """First place in ``order`` whose suffix is not before (or, if ``upper``, is after) each window."""
    low, high = np.zeros(len(words), np.int64), np.full(len(words), len(order))
    columns = np.arange(words.shape[1])
    used = columns < lengths[:, None]
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active]) // 2
        suffix = padded[order[middle][:, None] + columns]
        differs = (suffix != words[active]) & used[active]
        at = differs.argmax(axis=1)
        line = np.arange(len(active))
        ahead = np.where(differs[line, at], suffix[line, at] < words[active][line, at], upper)
        low[active[ahead]] = middle[ahead] + 1
        high[active[~ahead]] = middle[~ahead]
        active = active[low[active] < high[active]]
    return low


def find_windows(words: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Window numbers and positions, one for every occurrence; ``words`` holds zeros between texts."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(words) or not len(windows.words):
        return nothing
    width = windows.words.shape[1]
    order = suffix_array(words, width)
    padded = np.append(words, np.zeros(width, np.uint64))
    known = words[order]  # sorted by first word
    at = np.minimum(np.searchsorted(known, windows.words), len(known) - 1)
    present = (known[at] == windows.words) | (np.arange(width) >= windows.lengths[:, None])
    possible = np.flatnonzero(present.all(axis=1))
    if not len(possible):
        return nothing
    wanted, lengths = windows.words[possible], windows.lengths[possible]
    low = _bound(padded, order, wanted, lengths, upper=False)
    count = _bound(padded, order, wanted, lengths, upper=True) - low
    which = np.repeat(np.arange(len(possible)), count)
    slot = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return possible[which], order[low[which] + slot]


@dataclass
class Hits:
    """What one shard found: word ranges, and for each (row, item) its longest match."""

    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    item_rows: np.ndarray
    item_numbers: np.ndarray
    item_words: np.ndarray
    item_starts: np.ndarray


def shard_hits(hashes: np.ndarray, row_words: np.ndarray, windows: Windows) -> Hits:
    """Search one shard; ``row_words`` are the word offsets of its rows."""
    rows = len(row_words) - 1
    row = np.repeat(np.arange(rows), np.diff(row_words))
    words = np.zeros(len(hashes) + rows, np.uint64)  # one zero after each text
    words[np.arange(len(hashes)) + row] = hashes
    begins = row_words[:-1] + np.arange(rows)
    which, place = find_windows(words, windows)
    hit_row = np.searchsorted(begins, place, "right") - 1
    start = place - begins[hit_row]
    # Every origin of a window, then runs along the diagonal of (row, item).
    copies = np.diff(windows.first)[which]
    source = np.repeat(np.arange(len(which)), copies)
    origin = windows.first[which][source] + np.arange(len(source)) - np.repeat(np.cumsum(copies) - copies, copies)
    item, at = windows.items[origin], start[source]
    diagonal, owner = at - windows.offsets[origin], hit_row[source]
    order = np.lexsort((at, diagonal, item, owner))
    item, at, diagonal, owner = item[order], at[order], diagonal[order], owner[order]
    length = windows.lengths[which][source][order]
    breaks = np.ones(len(at), bool)
    breaks[1:] = (np.diff(at) != 1) | (np.diff(diagonal) != 0) | (np.diff(item) != 0) | (np.diff(owner) != 0)
    heads = np.flatnonzero(breaks)
    tails = np.append(heads[1:], len(at))[: len(heads)] - 1
    run = at[tails] - at[heads] + length[heads]
    best = np.lexsort((at[heads], -run, item[heads], owner[heads]))
    pair_row, pair_item = owner[heads][best], item[heads][best]
    lead = np.ones(len(best), bool)
    lead[1:] = (np.diff(pair_row) != 0) | (np.diff(pair_item) != 0)
    return Hits(
        hit_row, start, start + windows.lengths[which],
        pair_row[lead], pair_item[lead], run[best][lead], at[heads][best][lead],
    )


def _covered(rows: int, row_words: np.ndarray, hit_row, starts, ends) -> np.ndarray:
    """Words of each row inside at least one range."""
    change = np.zeros(row_words[-1] + 1, np.int64)
    np.add.at(change, row_words[hit_row] + starts, 1)
    np.add.at(change, row_words[hit_row] + ends, -1)
    inside = np.cumsum(change[:-1]) > 0
    return np.diff(np.append(0, np.cumsum(inside))[row_words])


def _summarise(texts: pa.Array, parts: list[Windows], width: int) -> list[pa.Array]:
    columns: list[list] = [[] for _ in RESULT]
    for block in blocks(texts):
        data = LOWER[block.data]
        found = find_words(data, block.offsets, ALPHANUMERIC)
        hashes = word_hashes(data, found)
        hits = [shard_hits(hashes, found.rows, windows) for windows in parts]
        row, start, end = (np.concatenate([getattr(h, n) for h in hits]) for n in ("rows", "starts", "ends"))
        n_words = found.counts
        n_hit = _covered(block.rows, found.rows, row, start, end)
        items: list[set[str]] = [set() for _ in range(block.rows)]
        longest: list[tuple] = [(0, 0, None)] * block.rows
        for part, windows in zip(hits, parts):
            for r, i, size, at in zip(part.item_rows, part.item_numbers, part.item_words, part.item_starts):
                name = windows.names[i]
                items[r].add(name)
                best = longest[r]
                if (-size, at, name) < (-best[0], best[1], best[2] or ""):
                    longest[r] = (int(size), int(at), name)
        columns[0] += n_words.tolist()
        columns[1] += n_hit.tolist()
        columns[2] += [len(names) for names in items]
        columns[3] += [hashlib.sha256(",".join(sorted(names)).encode()).hexdigest() for names in items]
        columns[4] += ((n_hit > 0) & (20 * n_hit >= n_words)).tolist()
        columns[5] += [best[2] for best in longest]
        columns[6] += [best[0] for best in longest]
        columns[7] += [best[1] if best[0] else None for best in longest]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]
    return [pa.array(values, kind) for values, kind in zip(columns, kinds)]


def benchmark_parts(benchmark: DataFrame, width: int, block_bytes: int) -> list[Windows]:
    """The benchmark as blocks of at most about ``block_bytes`` of text, fetched one at a time."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    size = items.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    parts = []
    for number in range(count):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == number).toArrow()
        block = block.sort_by([("item_id", "ascending"), ("text", "ascending")]).combine_chunks()
        parts.append(benchmark_windows(block.column("text"), block.column("item_id").to_pylist(), width))
    return parts


def find_contamination(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WINDOW_WORDS,
    block_bytes: int = BLOCK_BYTES,
    prefix: str = "",
) -> DataFrame:
    """All rows and columns of ``docs`` plus those of ``RESULT``, each name after ``prefix``."""
    parts = [spark.sparkContext.broadcast(part) for part in benchmark_parts(benchmark, width, block_bytes)]
    names = [prefix + field.name for field in RESULT]
    added = [T.StructField(name, field.dataType) for name, field in zip(names, RESULT)]
    schema = T.StructType([*docs.schema.fields, *added])
    text_at = docs.columns.index("text")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = [part.value for part in parts]
        for batch in batches:
            values = _summarise(batch.column(text_at), windows, width)
            yield pa.RecordBatch.from_arrays([*batch.columns, *values], names=[*batch.schema.names, *names])

    return docs.mapInArrow(tidy(searched), schema)


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, columns unchanged."""
    prefix = "found_"
    while any((prefix + field.name).lower() in {c.lower() for c in docs.columns} for field in RESULT):
        prefix += "_"
    found = find_contamination(spark, docs, benchmark, prefix=prefix)
    return found.filter(~F.col(f"{prefix}contaminated")).select(*docs.columns)
