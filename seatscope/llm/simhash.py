"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. Two fingerprints with at most two differing bits
agree on some segment entirely and differ by at most one bit in the next one (in a cycle), so three
kinds of keys suffice: the exact bits of a segment together with each Golay codeword index of the next,
17 keys per fingerprint on average. Fingerprints that meet under a key are compared bit by bit.

Equal fingerprints are one class from the start. Keys shared by more than ``small_bucket`` different
fingerprints are not paired: their members are linked through the fingerprints one bit away, 65 each,
under which at most 65 can meet, and which connect exactly those within two bits. So no group
of copies, however large, makes a number of rows that grows with its square.

Defined results: a null or empty text, or one of white space, has fingerprint zero and is linked like
any other; a null id never names a component unless all its ids are null; repeated rows are kept by
``near_duplicates`` and reduced to one by ``keep_one_of_each``; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatscope.llm import golay
from seatscope.llm.components import component_roots
from seatscope.llm.frames import free_name, staged, tidy
from seatscope.llm.words import LOWER, NON_SPACE, blocks, find_words

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2  # the segmentation above proves links up to this distance
SMALL_BUCKET = 32
_SEGMENTS = ((42, 22), (21, 21), (0, 21))  # lowest bit and width
_SHINGLES_AT_ONCE = 1 << 17


def _shingle_spans(starts, ends, rows, width) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every shingle, and how many each row has."""
    words = np.diff(rows)
    count = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(len(count)), count)
    first = rows[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    last = np.minimum(first + width, rows[1:][row]) - 1
    return starts[first], ends[last], count


def _bit_counts(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.add.reduceat(bits, begins, axis=0, dtype=np.int32)


def text_fingerprints(texts: pa.Array, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The fingerprint of every whole text as a signed 64-bit number."""
    results = [np.zeros(0, np.int64)]
    for block in blocks(texts):
        data = LOWER[block.data]
        found = find_words(data, block.offsets, NON_SPACE)
        inside = NON_SPACE[data]
        data[~inside] = 0x20
        kept = inside.copy()
        kept[1:] |= inside[:-1]  # and one separator after each word
        place = np.cumsum(kept) - 1
        joined = data[kept].tobytes()
        starts = place[found.starts] if len(found.starts) else found.starts
        begin, end, count = _shingle_spans(starts, starts + (found.ends - found.starts), found.rows, width)
        digest = xxhash.xxh64_intdigest
        votes = np.zeros((block.rows, 64), np.int64)
        row = np.repeat(np.arange(block.rows), count)
        for at in range(0, len(begin), _SHINGLES_AT_ONCE):
            upto = min(at + _SHINGLES_AT_ONCE, len(begin))
            spans = zip(begin[at:upto].tolist(), end[at:upto].tolist())
            hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, upto - at)
            part = row[at:upto]
            heads = np.flatnonzero(np.diff(part, prepend=-1))
            votes[part[heads]] += _bit_counts(hashes, heads)
        bits = 2 * votes > count[:, None]
        results.append(np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64))
    return np.concatenate(results)


def with_fingerprint(docs: DataFrame, name: str, width: int = SHINGLE_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` plus the fingerprint as a long."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    text_at = docs.columns.index("text")

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array(text_fingerprints(batch.column(text_at), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])

    return docs.mapInArrow(tidy(printed), schema)


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys, one for every key of every fingerprint."""
    whole = fingerprints.view(np.uint64)
    parts = [((whole >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in _SEGMENTS]
    rows, keys = [], []
    for kind, part in enumerate(parts):
        row, index = golay.indices(parts[(kind + 1) % len(parts)])
        rows.append(row)
        keys.append(kind << 34 | part[row] << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False)
        rows, keys = fuzzy_keys(values)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[rows])], names=["key", "f"])


def close_pairs(spark: SparkSession, fingerprints: DataFrame, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Links between different fingerprints (column ``f``, distinct) within two bits of each other.

    Every two such fingerprints are linked, directly or, from crowded keys, through a third.
    """
    keys = fingerprints.select("f").mapInArrow(tidy(_keyed), "key long, f long")
    groups = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("f").alias("a"), F.max("f").alias("b"))
    met = staged(spark, groups.filter("n > 1"))
    members = staged(spark, keys.join(met.filter("n > 2").select("key", "n"), "key"))
    few = members.filter(F.col("n") <= small_bucket)
    other = few.select("key", F.col("f").alias("g"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    pairs = (
        met.filter("n = 2").select("a", "b").filter(near)
        .unionAll(few.join(other, "key").filter("f < g").select(F.col("f").alias("a"), F.col("g").alias("b")).filter(near))
    )
    crowd = members.filter(F.col("n") > small_bucket).select("f").distinct()
    around = crowd.select("f", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("bit")).select(
        "f",
        F.when(F.col("bit") < 0, F.col("f"))
        .otherwise(F.col("f").bitwiseXOR(F.expr("shiftleft(1L, bit)")))
        .alias("centre"),
    )
    least = around.groupBy("centre").agg(F.min("f").alias("a"), F.count("*").alias("n")).filter("n > 1")
    hubs = around.join(least, "centre").filter("f <> a").select("a", F.col("f").alias("b"))
    return pairs.unionAll(hubs).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id``, ``f`` (fingerprint), ``root`` (of the component) and ``component_id`` per row."""
    prints = staged(spark, with_fingerprint(docs.select("doc_id", "text"), "f", width).select("doc_id", "f"))
    classes = staged(spark, prints.groupBy("f").agg(F.min("doc_id").alias("least")))
    roots = component_roots(spark, close_pairs(spark, classes))
    joined = classes.join(roots, classes["f"] == roots["node"], "left").select(
        "f", "least", F.coalesce("root", "f").alias("root")
    )
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(joined.select("f", "root").join(named, "root"), "f")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """One document of each component: that with the smallest id. Columns unchanged."""
    return keep_first(spark, docs, near_duplicates(spark, docs, width), partial(with_fingerprint, width=width))


def keep_first(
    spark: SparkSession, docs: DataFrame, found: DataFrame, with_print: Callable[[DataFrame, str], DataFrame]
) -> DataFrame:
    """Of each component in ``found`` (as from ``near_duplicates``) the document with the smallest id.

    Texts are shuffled once, against the ids that stay. Only rows that share an id are compared
    by fingerprint again, as an id alone does not name them.
    """
    found = staged(spark, found)
    stays = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    ids = found.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    once = stays.join(ids.filter("n = 1"), stays["doc_id"].eqNullSafe(ids["id"]), "left_semi")
    once = once.select(F.col("doc_id").alias("id"))
    single = docs.join(once, docs["doc_id"].eqNullSafe(once["id"]), "left_semi")
    shared = ids.filter("n > 1")
    f, root, id_of, f_of = (free_name(name, docs.columns) for name in ("f", "root", "id_of", "f_of"))
    repeated = with_print(docs.join(shared, docs["doc_id"].eqNullSafe(shared["id"]), "left_semi"), f)
    where = stays.select(F.col("doc_id").alias(id_of), F.col("f").alias(f_of), F.col("root").alias(root)).distinct()
    repeated = repeated.join(where, F.col("doc_id").eqNullSafe(F.col(id_of)) & (F.col(f) == F.col(f_of)))
    return single.unionByName(repeated.dropDuplicates([root]).select(*docs.columns))
