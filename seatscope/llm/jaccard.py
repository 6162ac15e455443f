"""N-gram Jaccard join: all links between documents whose shingle sets are similar, without a miss.

Sets with a similarity of 0.9 or more differ in at most a nineteenth of the shingles of both. All shingles are
hashed into segments, of which each band of set sizes has one more than two sets of the band, or one
and a set slightly larger, can differ in shingles. So by the pigeonhole principle two similar sets agree
on some segment entirely, whatever the shingles are. A set is listed under the contents of its segments
(and, for the smallest segments, under what is left without one shingle) in its own band, and looks for
partners of its size or less there and, if such can lie below, in the next lower band.

Which segments a set looks under is chosen by cost. It needs as many as two sets of its size can differ in,
and one; a segment that no other set shares costs nothing and still counts, as it shows a difference. An
empty segment, or one of one shingle together with its one-deletion neighbourhood, counts twice, as it
finds all sets that differ there in one shingle. The cheapest are taken, by their numbers of sets.

Under a key of few sets all pairs are compared, exactly, set against set. Sets of keys with more than
``small_bucket`` are first brought together: all that share such a key are compared with the one of them that
meets most others, and all that share a band of least hashes with one of them. This only saves work: what is then in one component needs no more pairs, and only what is not
goes on under its crowded keys, without a miss. Shingles that no other of these sets has count as
differences, so of a linked pair one set has few of them, and only those with few are joined with the
others of the key. Parity bits of both sets rule out, before sets are fetched, pairs that differ too much.

Equal sets are one class from the start. Keys that no two classes share are dropped by a bit map of fixed
size before anything is joined. Defined results: a null, empty or white text has an empty set and is linked
with nothing; a null id never names a component unless all its ids are null; repeated rows keep a row each;
empty tables give empty tables; other columns are not used. Shingles are equal by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seatscope.llm.bitmaps import bitmap_of, bits_of, is_in
from seatscope.llm.components import component_roots
from seatscope.llm.frames import discard, looked_up, staged, tidy
from seatscope.llm.words import LOWER, NON_SPACE, blocks, find_words, mix, word_hashes

_ODD = np.uint64(0x9E3779B97F4A7C15)
_PAIRS_AT_ONCE = 64  # pairs of one set that are compared in one task
_SHORT = 2  # segments of so many shingles are listed without one of them, too
_SEEN_AT_ONCE = 1 << 18
_COUNTED_AT_ONCE = 2048  # sets whose shingles are counted together
_BAND_COUNT, _BAND_HASHES = 8, 4
_MARKS = 8  # words of 64 parity bits


@dataclass(frozen=True)
class JaccardParams:
    words: int = 3
    small_bucket: int = 32
    filter_bits: int = 25


# Set sizes at which bands begin: each half as large again as the one before.
BANDS = [1, 10]
while BANDS[-1] < 1 << 31:
    BANDS.append(BANDS[-1] * 3 // 2)
_BANDS = np.array(BANDS, np.int64)


def most_differences(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """In how many shingles linked sets of ``n`` and ``m`` can differ: 100 * common >= 90 * united."""
    return (n + m) // 19


# Segments of a band, for its largest set with the largest that can be linked to it.
_SEGMENTS = most_differences(_BANDS[1:] - 1, (_BANDS[1:] - 1) * 10 // 9) + 1


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block its first row, the different shingles of every row, and where each row's begin."""
    for block in blocks(texts):
        data = LOWER[block.data]
        found = find_words(data, block.offsets, NON_SPACE)
        hashes = word_hashes(data, found)
        words = found.counts
        count = np.where(words >= width, words - width + 1, np.minimum(words, 1))
        row = np.repeat(np.arange(block.rows), count)
        first = found.rows[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        value = np.zeros(len(row), np.uint64)
        for place in range(width):
            at = first + place
            within = at < found.rows[1:][row]
            here = hashes[np.minimum(at, len(hashes) - 1)] if len(hashes) else hashes
            value = mix(value * _ODD + np.where(within, here, np.uint64(0)))
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
        new = np.ones(len(row), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        yield block.first, value[new], np.searchsorted(row[new], np.arange(block.rows + 1))


def _digests(values: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """Sixteen bytes that stand for each set."""
    raw = values.tobytes()
    return [blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())]


def _content_key(sums: np.ndarray, counts: np.ndarray, band: np.ndarray, segment: np.ndarray) -> np.ndarray:
    place = mix((band.astype(np.uint64) << np.uint64(32)) + segment.astype(np.uint64) + np.uint64(1))
    return mix(mix(sums + counts.astype(np.uint64) * _ODD) ^ place)


def segment_keys(values: np.ndarray, rows: np.ndarray, chosen: np.ndarray, band: np.ndarray) -> dict[str, np.ndarray]:
    """Keys of the sets ``chosen`` in the segments of ``band`` (one per chosen set).

    ``unit`` is 1 for the contents of a segment, 2 if it is empty, 3 and 4 for what is left of one and of two
    shingles without one; ``units`` is how many differences all segments of the set can show.
    """
    size = np.diff(rows)[chosen]
    many = _SEGMENTS[band]
    owner = np.repeat(np.arange(len(chosen)), size)
    at = np.repeat(rows[:-1][chosen], size) + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    value = values[at]
    spread = mix(value + (band[owner].astype(np.uint64) + np.uint64(1)) * _ODD) >> np.uint64(32)
    segment = ((spread * many[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    begin = np.cumsum(many) - many
    slot = begin[owner] + segment
    counts = np.bincount(slot, minlength=int(many.sum()))
    weight = mix(value ^ _ODD)
    sums = np.zeros(len(counts), np.uint64)
    np.add.at(sums, slot, weight)
    owner_of = np.repeat(np.arange(len(chosen)), many)
    segment_of = np.arange(len(counts)) - begin[owner_of]
    units = np.bincount(owner_of, np.where(counts <= 1, 2, 1), len(chosen)).astype(np.int64)
    short = np.flatnonzero(counts[slot] <= _SHORT)
    of = slot[short]
    left = _content_key(sums[of] - weight[short], counts[of] - 1, band[owner_of[of]], segment_of[of])
    every = np.concatenate([owner_of, owner_of[of]])
    return {
        "key": np.concatenate([_content_key(sums, counts, band[owner_of], segment_of), left]),
        "owner": chosen[every],
        "segment": np.concatenate([segment_of, segment_of[of]]),
        "unit": np.concatenate([np.where(counts == 0, 2, 1), 2 + counts[of]]),
        "units": units[every],
    }


_LISTED = "doc_id long, class binary, hi long, n long, key long, segment int, unit int, units int, below boolean"


def _listed(width: int):
    """A row for each document, without key, and one for each key of each set met for the first time."""
    names = [field.split()[0] for field in _LISTED.split(", ")]

    def rows_of(hi, n, keys, below):
        size = len(keys["key"])
        return pa.RecordBatch.from_arrays(
            [
                pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary()), pa.array(hi[keys["owner"]]),
                pa.array(n[keys["owner"]]), pa.array(keys["key"].view(np.int64)),
                *(pa.array(keys[name].astype(np.int32)) for name in ("segment", "unit", "units")),
                pa.array(np.full(size, below)),
            ],
            names=names,
        )

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for first, values, rows in shingle_sets(batch.column(1), width):
                n, digests = np.diff(rows), _digests(values, rows)
                hi = np.frombuffer(b"".join(d[:8] for d in digests), np.int64)
                size = len(n)
                none = [pa.nulls(size, kind) for kind in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())]
                ids = batch.column(0).slice(first, size)
                known = [ids, pa.array(digests, pa.binary()), pa.array(hi), pa.array(n)]
                yield pa.RecordBatch.from_arrays([*known, *none], names=names)
                if len(seen) > _SEEN_AT_ONCE:
                    seen.clear()
                new = np.zeros(size, bool)
                for row, digest in enumerate(digests):
                    if digest not in seen:
                        seen.add(digest)
                        new[row] = True
                # Smaller sets are linked with equal ones only, which are one class.
                own = np.flatnonzero(new & (n >= 9))
                band = np.searchsorted(_BANDS, n[own], "right") - 1
                yield rows_of(hi, n, segment_keys(values, rows, own, band), False)
                lower = (band > 0) & (-(-9 * n[own] // 10) < _BANDS[band])
                keys = segment_keys(values, rows, own[lower], band[lower] - 1)
                looking = keys["unit"] != 4
                yield rows_of(hi, n, {name: column[looking] for name, column in keys.items()}, True)

    return listed


def _shared(spark: SparkSession, listed: DataFrame, params: JaccardParams) -> DataFrame:
    """The key rows whose key is listed more than once; a few others may stay."""
    keyed = listed.filter(F.col("key").isNotNull()).select("key", "hi", "n", "segment", "unit", "units", "below")
    often = keyed.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1")
    bitmap = spark.sparkContext.broadcast(bitmap_of(often, params.filter_bits))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(is_in(bitmap.value, bits_of(key, params.filter_bits))))

    return staged(spark, keyed.mapInArrow(tidy(kept), keyed.schema).distinct())


def buckets(spark: SparkSession, listed: DataFrame, params: JaccardParams) -> DataFrame:
    """``key``, ``hi``, ``n``, ``looks`` (chosen by this set), ``below``, ``met`` (sets of the key) and ``hub``.

    Only keys that some set has chosen to look under are left, with the sets of sizes that are looked for there.
    Under keys of many sets ``met`` counts those.
    """
    rows = _shared(spark, listed, params)
    listing = ~F.col("below")
    sums = rows.groupBy("key").agg(
        F.count("*").alias("met"), F.min(F.when(listing, F.col("hi"))).alias("hub"),
        F.min("hi").alias("low"), F.max("hi").alias("high"),
    )
    sums = staged(spark, sums.filter("hub IS NOT NULL AND low < high").drop("low", "high"))
    total = rows.count()
    rows = staged(spark, looked_up(rows, sums, "key", total, "met"))
    band_begins = F.array(*(F.lit(b).cast("long") for b in BANDS))
    begin = F.array_max(F.filter(band_begins, lambda b: b <= F.col("n")))
    most = F.when(F.col("below"), F.col("n") + begin - 1).otherwise(2 * F.col("n"))
    offers = rows.filter("unit < 4").withColumn("gain", F.when(F.col("unit") == 2, 2).otherwise(1))
    offers = offers.withColumn("needed", F.floor(most / 19) + 1)
    by_set = Window.partitionBy("hi", "below")
    # What is left of a segment is looked under only after its contents.
    cost = F.max("met").over(Window.partitionBy("hi", "below", "segment"))
    offers = offers.withColumn("cost", F.when(F.col("unit") == 3, cost).otherwise(F.col("met")))
    offers = offers.withColumn("free", F.col("units") - F.sum("gain").over(by_set))
    # Near copies lie under crowded contents; under a crowded empty segment, or one shingle from it, lie strangers.
    offers = offers.withColumn("strangers", (F.col("met") > params.small_bucket) & (F.col("unit") != 1))
    in_turn = by_set.orderBy("strangers", "cost", "segment", "unit").rowsBetween(Window.unboundedPreceding, -1)
    offers = offers.withColumn("before", F.col("free") + F.coalesce(F.sum("gain").over(in_turn), F.lit(0)))
    looks = offers.select("key", "hi", "n", "below", "met", "hub", (F.col("before") < F.col("needed")).alias("looks"))
    rest = rows.filter("unit = 4").select("key", "hi", "n", "below", "met", "hub", F.lit(False).alias("looks"))
    whole = looks.unionByName(rest).filter("looks OR NOT below")
    whole = whole.groupBy("key", "hi").agg(
        F.first("n").alias("n"), F.max("below").alias("below"), F.max("looks").alias("looks"),
        F.first("met").alias("met"), F.first("hub").alias("hub"),
    )
    whole = staged(spark, whole)
    # A set looks for partners of its size or less, so others are of no use under the key.
    used = whole.filter("looks").groupBy("key").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    weights = whole.groupBy("key").agg(F.count("*").alias("rows")).join(used, "key")
    found = looked_up(whole, staged(spark, weights), "key", total, "rows").filter("10 * n >= 9 * low AND n <= high")
    found = found.drop("low", "high", "rows")
    many = staged(spark, found.filter(F.col("met") > params.small_bucket).drop("met"))
    left = staged(spark, many.groupBy("key").agg(F.count("*").alias("met")).filter("met > 1"))
    many = staged(spark, looked_up(many, left, "key", many.count(), "met"))
    found = found.filter(F.col("met") <= params.small_bucket).unionByName(many)
    discard(spark, rows)
    return found


def _could_be_linked(n: Column, m: Column) -> Column:
    return 10 * F.least(n, m) >= 9 * F.greatest(n, m)


def _ordered(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _sets(spark: SparkSession, docs: DataFrame, listed: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``hi``, ``class`` and ``shingles`` of the wanted sets, each from one of its texts."""
    own = listed.filter(F.col("key").isNull()).join(wanted, "hi", "left_semi").groupBy("class")
    ids = own.agg(F.min("doc_id").alias("id")).select("id").distinct()
    few = docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]), "left_semi").select("text")

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, values, rows in shingle_sets(batch.column(0), width):
                digests = _digests(values, rows)
                hi = np.frombuffer(b"".join(d[:8] for d in digests), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hi), pa.array(digests, pa.binary()), lists], names=["hi", "class", "shingles"]
                )

    found = few.mapInArrow(tidy(given), "hi long, class binary, shingles array<long>")
    return staged(spark, found.join(wanted, "hi", "left_semi").dropDuplicates(["class"]))


def _linked(spark: SparkSession, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs ``a``, ``b`` that are similar enough, as classes ``u``, ``v``."""
    # A set of many pairs is copied to several tasks, each with a part of its pairs.
    many = pairs.groupBy("a").agg(F.count("*").alias("rows"))
    many = staged(spark, many.withColumn("parts", F.ceil(F.col("rows") / _PAIRS_AT_ONCE)))
    left = many.join(sets, many["a"] == sets["hi"]).select(
        "a", F.col("class").alias("u"), F.col("shingles").alias("of_a"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
    )
    dealt = looked_up(pairs, many, "a", pairs.count(), "rows").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    right = dealt.join(sets, dealt["b"] == sets["hi"]).select(
        "a", "part", F.col("class").alias("v"), F.col("shingles").alias("of_b")
    )
    common = F.size(F.array_intersect("of_a", "of_b"))
    similar = 19 * common >= 9 * (F.size("of_a") + F.size("of_b"))
    return staged(spark, right.join(left, ["a", "part"]).filter(similar).select("u", "v"))


def _pairs_of_small(found: DataFrame, params: JaccardParams) -> DataFrame:
    few = found.filter(F.col("met") <= params.small_bucket)
    other = few.filter("NOT below").select("key", F.col("hi").alias("other"), F.col("n").alias("m"))
    both = few.filter("looks").join(other, "key").filter("hi <> other AND m <= n")
    return both.filter(_could_be_linked(F.col("n"), F.col("m"))).select(*_ordered("hi", "other"))


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``hi`` and ``band`` for each band of least hashes of a set."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            lists = part.column(1)
            begins = lists.offsets.to_numpy()
            values = lists.flatten().to_numpy().view(np.uint64)
            begins = (begins - begins[0])[:-1]
            for number in range(_BAND_COUNT):
                band = np.full(len(begins), number + 1, np.uint64)
                for place in range(_BAND_HASHES):
                    seed = mix(np.array([number * _BAND_HASHES + place + 1], np.uint64) * _ODD)
                    band = mix(band * _ODD + np.minimum.reduceat(mix(values ^ seed), begins))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(band.view(np.int64))], names=["hi", "band"])


def _named_roots(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """``hi`` and, as a number, ``root`` of the component its class is in so far."""
    named = sets.select("hi", "class").join(roots, sets["class"] == roots["node"], "left")
    return named.select("hi", F.xxhash64(F.coalesce("root", "class")).alias("root"))


def _stars(spark: SparkSession, crowded: DataFrame) -> DataFrame:
    """Pairs of each set with one of those it shares a band with."""
    bands = staged(spark, crowded.select("hi", "shingles").mapInArrow(tidy(_banded), "hi long, band long"))
    hubs = bands.groupBy("band").agg(F.min("hi").alias("hub"), F.count("*").alias("rows"))
    near = looked_up(bands, staged(spark, hubs.filter("rows > 1")), "band", bands.count(), "rows")
    return near.filter("hi <> hub").select(*_ordered("hi", "hub"))


def _middles(spark: SparkSession, crowd: DataFrame) -> DataFrame:
    """Pairs of each set of a crowded key with the one of its sets that meets the most others under such keys."""
    meetings = staged(spark, crowd.groupBy("hi").agg(F.sum("met").alias("meetings")))
    met = staged(spark, crowd.select("key", "hi").join(meetings, "hi"))
    middles = met.groupBy("key").agg(F.max(F.struct("meetings", "hi"))["hi"].alias("middle"), F.count("*").alias("rows"))
    near = looked_up(met, staged(spark, middles), "key", met.count(), "rows")
    return near.filter("hi <> middle").select(*_ordered("hi", "middle"))


def _rest(spark: SparkSession, crowd: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs under crowded keys that are in different components and can still be linked."""
    placed = crowd.join(_named_roots(sets, roots), "hi")
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows"))
    split = staged(spark, split.filter("low < high").select("key", "rows"))
    placed = staged(spark, looked_up(placed, split, "key", crowd.count(), "rows").drop("rows"))
    # Sets of one key lie together, so a task counts the shingles that they have in common before any are sent.
    homes = staged(spark, placed.groupBy("hi").agg(F.min("key").alias("home")))
    own = sets.join(homes, "hi")
    lying = own.select("hi", "shingles", "home").repartitionByRange("home", "hi").sortWithinPartitions("home", "hi")
    counted = lying.select("hi", "shingles").mapInArrow(tidy(_counted), "shingle long, times long, hi long")
    once = counted.groupBy("shingle").agg(F.sum("times").alias("times"), F.min("hi").alias("hi")).filter("times = 1")
    alone = once.groupBy("hi").agg(F.count("*").alias("alone"))
    names = [f"mark_{i}" for i in range(_MARKS)]
    marks = own.select("hi", "shingles").mapInArrow(tidy(_marked), ", ".join(["hi long", *(f"{m} long" for m in names)]))
    placed = placed.join(marks, "hi").join(alone, "hi", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    placed = staged(spark, placed)
    carried = ("hi", "n", "root", "alone", "looks", "below", *names)
    other = placed.select("key", *(F.col(name).alias(f"{name}_2") for name in carried))
    # Of two linked sets one has its alone shingles in at most an eighteenth of its size.
    few = placed.filter(18 * F.col("alone") <= F.col("n"))
    both = few.join(other, "key").filter("root <> root_2 AND (looks OR looks_2) AND NOT (below AND below_2)")
    both = both.filter(_could_be_linked(F.col("n"), F.col("n_2")))
    both = both.filter(19 * (F.col("alone") + F.col("alone_2")) <= F.col("n") + F.col("n_2"))
    differ = sum(F.bit_count(F.col(m).bitwiseXOR(F.col(f"{m}_2"))) for m in names)
    return both.filter(19 * differ <= F.col("n") + F.col("n_2")).select(*_ordered("hi", "hi_2"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each different ``shingle`` of some sets, in how many of them it is, and ``hi`` of one that has it."""
    for batch in batches:
        for at in range(0, batch.num_rows, _COUNTED_AT_ONCE):
            part = batch.slice(at, _COUNTED_AT_ONCE)
            lists = part.column(1)
            row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            values, first, times = np.unique(lists.flatten().to_numpy(), return_index=True, return_counts=True)
            columns = [pa.array(values), pa.array(times.astype(np.int64)), part.column(0).take(pa.array(row[first]))]
            yield pa.RecordBatch.from_arrays(columns, names=["shingle", "times", "hi"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``hi`` and the parity bits of a set: each bit in which two sets differ is a shingle in which they do."""
    for batch in batches:
        lists = batch.column(1)
        values = lists.flatten().to_numpy().view(np.uint64)
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        bits = np.zeros((batch.num_rows, _MARKS), np.uint64)
        place = mix(values ^ _ODD)
        word = (place >> np.uint64(6)).astype(np.int64) % _MARKS
        np.bitwise_xor.at(bits, (row, word), np.uint64(1) << (place & np.uint64(63)))
        columns = [pa.array(np.ascontiguousarray(column).view(np.int64)) for column in bits.T]
        names = ["hi", *(f"mark_{i}" for i in range(_MARKS))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)


def jaccard_join(spark: SparkSession, docs: DataFrame, params: JaccardParams | None = None) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for every document."""
    params = params or JaccardParams()
    docs = docs.select("doc_id", "text")
    listed = staged(spark, docs.mapInArrow(tidy(_listed(params.words)), _LISTED))
    found = buckets(spark, listed, params)
    crowd = found.filter(F.col("met") > params.small_bucket)
    pairs = staged(spark, _pairs_of_small(found, params).distinct())
    crowded_ids = staged(spark, crowd.select("hi").distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("hi")).unionAll(crowded_ids).distinct()
    sets = _sets(spark, docs, listed, staged(spark, wanted), params.words)
    stars = _stars(spark, sets.join(crowded_ids, "hi", "left_semi"))
    links = _linked(spark, sets, staged(spark, pairs.unionAll(stars).unionAll(_middles(spark, crowd)).distinct()))
    roots = component_roots(spark, links)
    rest = staged(spark, _rest(spark, crowd, sets, roots).distinct())
    if not rest.isEmpty():
        roots = component_roots(spark, roots.unionAll(_linked(spark, sets, rest)))
    rows = listed.filter(F.col("key").isNull()).select("doc_id", "class", F.col("n").alias("n_shingles"))
    classes = rows.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    rooted = classes.join(roots, classes["class"] == roots["node"], "left").select(
        "class", "least", "rows", F.coalesce("root", "class").alias("root")
    )
    rooted = staged(spark, rooted)
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(spark, rooted.join(names, "root").select("class", "rows", "component_id"))
    total = rows.count()
    linked = looked_up(rows.filter("n_shingles > 0"), named, "class", total, "rows").drop("rows")
    empty = rows.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return linked.unionByName(empty).select("doc_id", "n_shingles", "component_id")
