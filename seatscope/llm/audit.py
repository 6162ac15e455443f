"""Filter interaction audit: what each filter removes, in every order of the filters.

Each document becomes a 32-bit word, its truth table over the 32 subsets of five filters: bit ``s`` is set if
no filter of subset ``s`` fails it. Sums of these bits, per part and label, are the survivors of every subset,
and from them follow the counts of all orders of the filters without looking at a document again. The
bits of all positions are counted together by carry-save adders: three words of one weight become one
of that weight and one of twice it, until few are left.

Equal texts are found by their SHA-256. A digest of more than a ten-thousandth of all rows is
resolved in each task by a broadcast table, which by that share has at most ten thousand rows; the others
are joined by a shuffle of digests, in which no key can be large. Texts are read once.

Defined results: a null or empty text has no words; a null part is the empty string; a null id is neither
smaller nor larger than another; repeated rows count each; labels that are null or without a document are
ignored, of repeated ones the largest counts; an empty table has no parts and gives no rows; other columns
are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatscope.llm.frames import let, staged, tidy

FILTERS = "ABCDE"
_SUBSETS = 1 << len(FILTERS)
_COPY = 1 << FILTERS.index("E")
_HEAVY_SHARE = 10_000
_GROUPS_AT_ONCE = 4096


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", " " * 5), " "), "")


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    by_words = let(_words(text), lambda words: F.when(F.size(words) < 200, 1).otherwise(0)
                   + F.when(100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 2).otherwise(0))
    return (
        by_words
        + F.when(100 * capitals.cast("long") > 3 * F.length(text), 4).otherwise(0)
        + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)
    ).cast("int")


def marked(spark: SparkSession, docs: DataFrame, part: str) -> DataFrame:
    """``doc_id``, ``part`` and ``failed`` (bits of the filters failed) of every document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        own_failures(text).alias("own"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    rows = staged(spark, rows)
    met = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    met = staged(spark, met.filter("n > 1"))
    limit = max(100, rows.count() // _HEAVY_SHARE)
    heavy = F.broadcast(met.filter(F.col("n") > limit).select("digest", F.col("first_id").alias("heavy_first")))
    light = met.filter(F.col("n") <= limit).select("digest", F.col("first_id").alias("light_first"))
    known = staged(spark, rows.join(heavy, "digest", "left"))
    rest = known.filter(F.col("heavy_first").isNull()).drop("heavy_first").join(light, "digest", "left")
    found = known.filter(F.col("heavy_first").isNotNull()).withColumnRenamed("heavy_first", "light_first")
    both = rest.unionByName(found)
    copy = F.coalesce(F.col("doc_id") > F.col("light_first"), F.lit(False))
    return both.select("doc_id", "part", (F.col("own") + F.when(copy, _COPY).otherwise(0)).alias("failed"))


def survival_words() -> np.ndarray:
    """By the bits of the filters failed, the word with a bit for each subset that the document survives."""
    failed, subset = np.meshgrid(np.arange(_SUBSETS), np.arange(_SUBSETS), indexing="ij")
    return (((failed & subset) == 0).astype(np.uint32) << subset.astype(np.uint32)).sum(axis=1, dtype=np.uint32)


def positional_popcounts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set, by carry-save adders."""
    totals = np.zeros(32, np.int64)
    levels: list[np.ndarray] = [words.astype(np.uint32)]
    weight = 0
    while weight < len(levels):
        left = levels[weight]
        carries = [np.zeros(0, np.uint32)]
        while len(left) >= 3:
            third = len(left) // 3
            a, b, c = left[:third], left[third : 2 * third], left[2 * third : 3 * third]
            either = a ^ b
            carries.append((a & b) | (either & c))
            left = np.concatenate([either ^ c, left[3 * third :]])
        for word in left.tolist():
            totals += (word >> np.arange(32) & 1) << weight
        carried = np.concatenate(carries)
        if len(carried):
            levels.append(carried)
        weight += 1
    return totals


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``part``, ``label`` and survivors by subset of the rows of a task."""
    table = survival_words()
    groups: dict[tuple[str, int], np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        parts, labels, counts = [k[0] for k in groups], [k[1] for k in groups], list(groups.values())
        groups.clear()
        lists = pa.array([c.tolist() for c in counts], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.string()), pa.array(labels, pa.int32()), lists], names=["part", "label", "survivors"]
        )

    for batch in batches:
        names = batch.column(0).dictionary_encode()
        group = names.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4
        group += batch.column(1).to_numpy(zero_copy_only=False)
        words = table[batch.column(2).to_numpy(zero_copy_only=False)]
        order = np.argsort(group, kind="stable")
        found, begins = np.unique(group[order], return_index=True)
        for key, own in zip(found.tolist(), np.split(words[order], begins[1:])):
            name = (names.dictionary[key // 4].as_py(), key % 4)
            groups[name] = groups.get(name, 0) + positional_popcounts(own)
        if len(groups) > _GROUPS_AT_ONCE:
            yield flush()
    if groups:
        yield flush()


def survivors(failed: DataFrame) -> DataFrame:
    """Per ``part`` arrays ``n_all``, ``n_good`` and ``n_toxic``: documents that survive each subset of filters.

    Reads columns ``part``, ``label`` (1 for good, plus 2 for toxic) and ``failed``.
    """
    counted = failed.select("part", "label", "failed").mapInArrow(
        tidy(_counted), "part string, label int, survivors array<long>"
    )

    def total(bit: int) -> Column:
        wanted = F.col("label").bitwiseAND(bit) > 0 if bit else F.lit(True)
        return F.array(*(F.sum(F.when(wanted, F.col("survivors")[s]).otherwise(0)) for s in range(_SUBSETS)))

    return counted.groupBy("part").agg(total(0).alias("n_all"), total(1).alias("n_good"), total(2).alias("n_toxic"))


def _shapley(filter_bit: int) -> Column:
    """Documents the filter removes, summed over all orders, at whatever step it stands."""
    terms = []
    for subset in range(_SUBSETS):
        if not subset & filter_bit:
            before = subset.bit_count()
            orders = factorial(before) * factorial(len(FILTERS) - 1 - before)
            terms.append(orders * (F.col("n_all")[subset] - F.col("n_all")[subset | filter_bit]))
    return sum(terms[1:], terms[0])


def all_orders(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, which in enumerate(order, 1):
            steps.append(f"('{name}', {step}, {which}, {before}, {before | 1 << which})")
            before |= 1 << which
    listed = "inline(array(" + ", ".join(f"struct{step}" for step in steps) + "))"
    shapley = F.array(*(_shapley(1 << f) for f in range(len(FILTERS)))).alias("by_filter")
    rows = counts.select("*", shapley).select(
        "*", F.expr(listed).alias("filter_order", "step", "which", "before", "after")
    )

    def at(counted: str, subset: str) -> Column:
        return F.get(F.col(counted), F.col(subset))

    bit = F.expr("shiftleft(1, which)")
    everything = _SUBSETS - 1
    removed = at("n_all", "before") - at("n_all", "after")
    return rows.select(
        "part",
        "filter_order",
        "step",
        at("n_all", "after").alias("kept"),
        removed.alias("removed"),
        (F.col("n_all")[0] - F.get("n_all", bit) - removed).alias("redundant"),
        (F.get("n_all", F.lit(everything) - bit) - F.col("n_all")[everything]).alias("unique_fails"),
        (at("n_good", "before") - at("n_good", "after")).alias("good_lost"),
        (at("n_toxic", "before") - at("n_toxic", "after")).alias("toxic_lost"),
        F.get("by_filter", F.col("which")).alias("shapley"),
    )


def audit_filters(spark: SparkSession, docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of the five filters per value of column ``part``."""
    known = labels.groupBy("doc_id").agg(
        (F.max((F.col("quality") == 1).cast("int"))).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    known = known.select(
        "doc_id", (F.coalesce("good", F.lit(0)) + 2 * F.coalesce("toxic", F.lit(0))).cast("int").alias("label")
    ).filter("label > 0")
    joined = marked(spark, docs, part).join(known, "doc_id", "left")
    return all_orders(survivors(joined.withColumn("label", F.coalesce("label", F.lit(0)))))
