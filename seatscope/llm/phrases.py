"""Phrase collocations, mined by dynamic itemset counting.

The words of all texts are staged once, as numbers, in ``shards`` parts. Then the parts are scanned in a
cycle, one a tick, and phrases of different lengths are counted in the same scans: words from the first
tick on, a longer phrase from the tick after both its subphrases, without the last and without the first
word, have reached the threshold in what was counted so far. Every phrase is counted over one full cycle
from its own first tick, so its count is exact; one that then stays below the threshold is dropped.
Scanning ends when no phrase can be open any more.

What has reached the threshold at a tick is told to the tasks as a bit map of ``filter_bits`` bits, which
is all that is ever sent to the driver or broadcast. A wrong bit starts a phrase early; it is counted over a
full cycle all the same, so bit maps too small for a corpus cost time, not counts. Phrases are counted
under 64-bit keys and combined in each task before they are shuffled.

Defined results: a null text is empty; a null group is ``und``, together with a group of that name; repeated
rows and null ids count like any; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seatscope.llm.bitmaps import bitmap_of, bits_of, is_in
from seatscope.llm.frames import discard, staged, tidy
from seatscope.llm.words import LOWER, Words, blocks, find_words, mix, word_hashes
from seatscope.session import shared_folder

_BREAKS = b".,;:!?\n\x0b\f\r"
_BREAK = np.zeros(256, bool)
_BREAK[list(_BREAKS)] = True
_IN_WORD = ~_BREAK
_IN_WORD[[0x20, 0x09]] = False
_ODD = np.uint64(0x9E3779B97F4A7C15)
_NEVER = 127
_WORDS_AT_ONCE = 1 << 19
_SEEN_AT_ONCE = 1 << 20
_PARTS = 64
_SLOTS = 16
_SLOT_ROUNDS = ((0, 0), (1, 4), (5, _SLOTS - 1))


@dataclass(frozen=True)
class PhraseParams:
    """``threshold``: least count of a phrase; ``inside``: percent of a phrase that a longer one may take up."""

    threshold: int = 10
    inside: int = 50
    top: int = 2000
    shards: int = 2
    filter_bits: int = 25  # logarithm of the size of each bit map


def _numbers_of(data: np.ndarray, found: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block, with a zero after each piece, and the row of each."""
    breaks = np.append(0, np.cumsum(_BREAK[data]))
    ends = np.zeros(len(hashes), bool)
    if len(hashes):
        ends[:-1] = breaks[found.starts[1:]] > breaks[found.ends[:-1]]
        ends[found.rows[1:][found.counts > 0] - 1] = True
    numbers = np.zeros(len(hashes) + int(ends.sum()), np.uint64)
    numbers[np.arange(len(hashes)) + np.cumsum(ends) - ends] = hashes
    return numbers, np.repeat(found.row_of_word(), 1 + ends)


def _encoded(shards: int):
    """Texts to rows of numbers, one per group and block, and to the spelling of each word seen."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        turn = TaskContext.get().partitionId()
        names = ["shard", "slot", "lang", "group", "words", "word"]
        for batch in batches:
            groups = batch.column(0).dictionary_encode()
            codes = groups.indices.to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1)):
                data = LOWER[block.data]
                found = find_words(data, block.offsets, _IN_WORD)
                hashes = word_hashes(data, found)
                numbers, row = _numbers_of(data, found, hashes)
                code = codes[block.first : block.last][row]
                order = np.argsort(code, kind="stable")  # one row per group of a block
                kept, begins = np.unique(code[order], return_index=True)
                lists = np.split(numbers[order].view(np.int64), begins[1:]) if len(kept) else []
                turn += 1
                langs = groups.dictionary.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([turn % shards] * len(kept), pa.int32()),
                        pa.array([turn // shards % _SLOTS] * len(kept), pa.int32()),
                        langs,
                        pa.array([_group_key(name) for name in langs.to_pylist()], pa.int64()),
                        pa.array(lists, pa.list_(pa.int64())),
                        pa.nulls(len(kept), pa.string()),
                    ],
                    names=names,
                )
                hashes, first = np.unique(hashes, return_index=True)
                if len(seen) > _SEEN_AT_ONCE:
                    seen.clear()
                new = [(h, i) for h, i in zip(hashes.view(np.int64).tolist(), first.tolist()) if h not in seen]
                seen.update(h for h, _ in new)
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([-1] * len(new), pa.int32()),
                        pa.nulls(len(new), pa.int32()),
                        pa.nulls(len(new), pa.string()),
                        pa.nulls(len(new), pa.int64()),
                        pa.array([[h] for h, _ in new], pa.list_(pa.int64())),
                        pa.array([raw[found.starts[i] : found.ends[i]].decode() for _, i in new], pa.string()),
                    ],
                    names=names,
                )

    return encode


_STAGED = "slot int, lang string, group long, words array<long>, word string"


def staged_words(spark: SparkSession, docs: DataFrame, group: str, shards: int) -> DataFrame:
    """``lang``, its ``group`` key, ``words`` (numbers, zero between pieces) by ``shard`` and ``slot``.

    Shard -1 holds the spelling of each number.
    """
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    given = docs.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("lang"), "text")
    rows = given.mapInArrow(tidy(_encoded(shards)), f"shard int, {_STAGED}")
    rows.write.partitionBy("shard").parquet(path)
    return spark.read.schema(f"{_STAGED}, shard int").parquet(path)


def _group_key(name: str) -> int:
    raw = np.frombuffer(name.encode(), np.uint8)
    if not len(raw):
        return 0
    return int(word_hashes(raw, Words(np.array([0]), np.array([len(raw)]), np.array([0, 1]))).view(np.int64)[0])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of many rows in a piece, and the group key for each; no phrase is cut by a slice."""
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for row in range(batch.num_rows):
            numbers = batch.column(1).slice(row, 1).flatten().to_numpy().view(np.uint64)
            group = keys[row]
            at = 0
            while at < len(numbers):
                upto = min(at + _WORDS_AT_ONCE, len(numbers))
                if upto < len(numbers):  # on to the end of the piece
                    rest = np.flatnonzero(numbers[upto - 1 : upto - 1 + _WORDS_AT_ONCE] == 0)
                    if len(rest):
                        upto += int(rest[0])
                    else:
                        zeros = np.flatnonzero(numbers[upto:] == 0)
                        upto += int(zeros[0]) + 1 if len(zeros) else len(numbers) - upto
                yield numbers[at:upto], np.broadcast_to(group, upto - at)
                at = upto


def _combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _ODD + right)


def phrase_keys(numbers: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For one, two and three words the key of the phrase that begins at each place, and whether one does."""
    found, key, whole = [], mix(group * _ODD + np.uint64(7)), np.ones(len(numbers), bool)
    for size in range(3):
        next_word = np.append(numbers[size:], np.zeros(min(size, len(numbers)), np.uint64))
        whole = whole & (next_word != 0)
        key = _combine(key, next_word)
        found.append((key, whole))
    return found


def _reached(keys: np.ndarray, whole: np.ndarray, bitmaps: dict[int, np.ndarray], bits: int) -> np.ndarray:
    """The first tick whose bit map has the key of each place."""
    tick = np.full(len(keys), _NEVER, np.int16)
    at = np.flatnonzero(whole)
    places = bits_of(keys[at], bits)
    for number in sorted(bitmaps, reverse=True):
        tick[at[is_in(bitmaps[number], places)]] = number
    return tick


def _counter(tick: int, params: PhraseParams, filters):
    """Counts of the phrases that are open at ``tick``: ``size``, ``key``, ``since`` (its first tick), ``n``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = filters.value
        for numbers, group in _slices(batches):
            keys = phrase_keys(numbers, group)
            since = np.zeros(len(numbers), np.int16)
            for size in (1, 2, 3):
                key, whole = keys[size - 1]
                if size > 1:
                    before = _reached(*keys[size - 2], maps[size - 1], params.filter_bits)
                    # The phrase without its first word is the one at the next place.
                    since = np.maximum(before, np.append(before[1:], np.int16(_NEVER))) + 1
                is_open = whole & (since <= tick) & (tick < since + params.shards)
                found, first, n = np.unique(key[is_open], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(found), size, np.int8)),
                        pa.array(found.view(np.int64)),
                        pa.array(since[is_open][first].astype(np.int8)),
                        pa.array(n.astype(np.int64)),
                    ],
                    names=["size", "key", "since", "n"],
                )

    return count


def count_phrases(spark: SparkSession, words: DataFrame, params: PhraseParams) -> DataFrame:
    """``size``, ``key``, ``n`` of all phrases of one to three words that reach the threshold."""
    maps: dict[int, dict[int, np.ndarray]] = {1: {}, 2: {}}
    state = staged(spark, spark.createDataFrame([], "size byte, key long, since byte, n long, reached byte"))
    tick, last = 0, 0
    while tick <= max(params.shards - 1, last + params.shards):
        filters = spark.sparkContext.broadcast(maps)
        shard = words.filter(F.col("shard") == tick % params.shards).select("group", "words")
        rows = shard.mapInArrow(tidy(_counter(tick, params, filters)), "size byte, key long, since byte, n long")
        merged = (
            state.unionByName(rows.withColumn("reached", F.lit(None).cast("byte")))
            .groupBy("size", "key")
            .agg(F.min("since").alias("since"), F.sum("n").alias("n"), F.min("reached").alias("reached"))
        )
        enough = F.col("n") >= params.threshold
        is_open = F.col("since") + params.shards - 1 > tick
        now = F.coalesce("reached", F.when(enough, F.lit(tick).cast("byte")))
        old, state = state, staged(spark, merged.withColumn("reached", now).filter(is_open | enough))
        discard(spark, old)
        filters.destroy()
        for size in (1, 2):
            bitmap = bitmap_of(state.filter((F.col("size") == size) & (F.col("reached") == tick)), params.filter_bits)
            if bitmap.any():
                maps[size][tick] = bitmap
                last = tick
        tick += 1
    return state.select("size", "key", "n")


def _definitions(filters, bits: int):
    """``group``, the words and the parts of every phrase that the bit maps have, once or a few times a task."""

    def define(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = filters.value
        known = np.zeros(0, np.uint64)
        for numbers, group in _slices(batches):
            keys = phrase_keys(numbers, group)
            if len(known) > _SEEN_AT_ONCE:
                known = np.zeros(0, np.uint64)
            for size in (2, 3):
                key, whole = keys[size - 1]
                at = np.flatnonzero(whole)
                at = at[is_in(maps[size], bits_of(key[at], bits))]
                found, first = np.unique(key[at], return_index=True)
                new = ~np.isin(found, known, assume_unique=True)
                at, found = at[first[new]], found[new]
                known = np.concatenate([known, found])
                third = numbers[at + 2] if size == 3 else np.zeros(len(at), np.uint64)
                one_word, shorter = keys[0][0], keys[size - 2][0]
                cut_1, cut_2 = (one_word[at], shorter[at + 1]), (shorter[at], one_word[at + size - 1])
                columns = [found, group[at], numbers[at], numbers[at + 1], third, *cut_1, *cut_2]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], names=_KEYS
                )

    return define


_KEYS = ["key", "group", "w1", "w2", "w3", "left_1", "right_1", "left_2", "right_2"]


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of 38 digits."""
    square = f"(CAST({a} AS DECIMAL(16,0)) * CAST({a} AS DECIMAL(16,0)) * CAST(1000000 AS DECIMAL(7,0)))"
    below = f"(CAST({left} AS DECIMAL(16,0)) * CAST({right} AS DECIMAL(16,0)))"
    return F.expr(f"CAST({square} DIV {below} AS BIGINT)")


def candidates(spark: SparkSession, words: DataFrame, counts: DataFrame, params: PhraseParams) -> DataFrame:
    """Phrases of two and three words with ``a``, ``l``, ``r``, ``score``, those inside longer ones dropped."""
    wanted = counts.filter("size > 1")
    defined, missing = [], wanted
    # Frequent phrases are met in a few slots already; the other slots are searched for the rest only.
    for first, upto in _SLOT_ROUNDS:
        maps = {size: bitmap_of(missing.filter(F.col("size") == size), params.filter_bits) for size in (2, 3)}
        filters = spark.sparkContext.broadcast(maps)
        slots = words.filter((F.col("shard") >= 0) & F.col("slot").between(first, upto)).select("group", "words")
        found = slots.mapInArrow(tidy(_definitions(filters, params.filter_bits)), ", ".join(f"{k} long" for k in _KEYS))
        found = found.groupBy("key").agg(*(F.first(name).alias(name) for name in _KEYS[1:]))
        defined.append(staged(spark, found.join(missing, "key")))
        filters.destroy()
        missing = staged(spark, missing.join(defined[-1].select("key"), "key", "left_anti"))
    groups = words.filter(F.col("shard") >= 0).select("lang", F.col("group").alias("of_group")).distinct()
    whole = reduce(DataFrame.unionByName, defined).withColumnRenamed("n", "a")
    whole = whole.join(groups, F.col("group") == F.col("of_group"))
    of = {size: counts.filter(F.col("size") == size).select(F.col("key").alias(f"key_{size}"), "n") for size in (1, 2)}

    def looked_up(table: DataFrame, size: int, key: str, name: str) -> DataFrame:
        return table.join(of[size].withColumnRenamed("n", name), F.col(key) == F.col(f"key_{size}")).drop(f"key_{size}")

    pairs = looked_up(looked_up(whole.filter("size = 2"), 1, "left_1", "l"), 1, "right_1", "r")
    triples = looked_up(looked_up(whole.filter("size = 3"), 1, "left_1", "l_1"), 2, "right_1", "r_1")
    triples = staged(spark, looked_up(looked_up(triples, 2, "left_2", "l_2"), 1, "right_2", "r_2"))
    longer = triples.select(F.explode(F.array("left_2", "right_1")).alias("inner_key"), "a")
    longer = longer.groupBy("inner_key").agg(F.max("a").alias("longest"))
    pairs = pairs.join(longer, F.col("key") == F.col("inner_key"), "left")
    pairs = pairs.filter(F.coalesce(100 * F.col("longest") < params.inside * F.col("a"), F.lit(True)))
    pairs = pairs.select("lang", "w1", "w2", "w3", "a", "l", "r", _score("a", "l", "r").alias("score"))
    cuts = triples.withColumn("s_1", _score("a", "l_1", "r_1")).withColumn("s_2", _score("a", "l_2", "r_2"))
    first = F.col("s_1") <= F.col("s_2")
    triples = cuts.select(
        "lang", "w1", "w2", "w3", "a",
        F.when(first, F.col("l_1")).otherwise(F.col("l_2")).alias("l"),
        F.when(first, F.col("r_1")).otherwise(F.col("r_2")).alias("r"),
        F.least("s_1", "s_2").alias("score"),
    )
    return pairs.unionByName(triples)


def _spelt(words: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with the ``phrase`` their word numbers stand for."""
    spellings = words.filter(F.col("shard") == -1).select(F.col("words")[0].alias("number"), "word")
    wanted = rows.select(F.explode(F.array("w1", "w2", "w3")).alias("wanted")).distinct()
    spellings = spellings.join(wanted, F.col("number") == F.col("wanted"), "left_semi").distinct()
    is_pair = F.col("w3") == 0
    rows = rows.withColumn("last", F.when(is_pair, F.col("w1")).otherwise(F.col("w3")))  # no key that all pairs share
    for name in ("w1", "w2", "last"):
        own = spellings.select(F.col("number").alias(f"{name}_number"), F.col("word").alias(f"{name}_text"))
        rows = rows.join(own, F.col(name) == F.col(f"{name}_number")).drop(f"{name}_number")
    return rows.withColumn("phrase", F.concat_ws(" ", "w1_text", "w2_text", F.when(~is_pair, F.col("last_text"))))


def mine_phrases(
    spark: SparkSession, docs: DataFrame, group: str = "lang", params: PhraseParams | None = None
) -> DataFrame:
    """The best phrases of each group: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``."""
    params = params or PhraseParams()
    words = staged_words(spark, docs, group, params.shards)
    counts = count_phrases(spark, words, params)
    found = staged(spark, candidates(spark, words, counts, params))
    best = (F.desc("score"), F.desc("a"))
    # In parts first, so that no task ranks a large group alone; equal ones all stay until they are spelt.
    part = F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(_PARTS))
    rank = F.rank().over(Window.partitionBy("lang", "part").orderBy(*best))
    near = found.withColumn("part", part).withColumn("rank", rank).filter(F.col("rank") <= params.top)
    spelt = _spelt(words, staged(spark, near.drop("rank")))
    for keys in (["lang", "part"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*best, "phrase"))
        spelt = spelt.withColumn("rank", rank).filter(F.col("rank") <= params.top)
    texts = words.filter(F.col("shard") >= 0)
    totals = texts.groupBy(F.col("lang").alias("of_lang")).agg(
        F.sum(F.size(F.array_remove("words", F.lit(0).cast("long"))).cast("long")).alias("n")
    )
    joined = spelt.join(totals, F.col("lang") == F.col("of_lang"))
    return joined.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
