"""Quality rules whose cutoffs are chosen with a guarantee.

Each rule compares a share of a text with a cutoff. For every stratum and rule the cutoffs of a fixed grid
are tried from the mildest on: a cutoff is accepted if, among the labelled good documents of the
stratum, so few would be rejected that the exact binomial test refutes a false-rejection rate above
the rule's part of ``risk``. The first one that fails ends the search, so the tests along a grid
need no correction among themselves; across rules and strata the error level is divided by their
number. With probability ``1 - level`` no stratum loses more than ``risk`` of its good documents. A
stratum with too few labels gets no cutoff and loses nothing. Among the accepted cutoffs any choice
is safe; the most useful one on the labelled documents is taken, or none if none helps.

Counting and testing use DataFrame functions only, on whole texts, without a shuffle of texts or words.
Five-word windows are compared by a 64-bit hash within one text.

Defined results: a null or empty text has no words and fails the base rule; a null stratum is one of
its own; labels that are null or without a document are ignored, of repeated ones the largest counts;
repeated documents keep a row each and count once each in the tests; other columns are not carried.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatscope.llm.frames import let, staged

_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
_WINDOW = 5
_GRID = (0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05, 0.03, 0.02)  # mildest first


@dataclass(frozen=True)
class RuleParams:
    """``risk``: good documents a stratum may lose; ``level``: chance that any stratum loses more."""

    risk: float = 0.03
    level: float = 0.05
    grid: tuple[float, ...] = _GRID


# Rule name and the share it looks at.
RULES = {
    "symbols": lambda: F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
    "dup_lines": lambda: F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    "repeats": lambda: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
}


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _SPACES[1:], " " * (len(_SPACES) - 1)), " "), "")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _repeat_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more; each word counts once."""
    size = F.size(words)
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), size - _WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*(F.get(h, i + step) for step in range(_WINDOW))))

    def covered(w: Column) -> Column:
        # Sorted by hash, then place: a window is repeated if a neighbour has its hash.
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(ordered, lambda o: _union_length(F.sort_array(F.filter(
            F.transform(o, lambda x, i: F.when(
                (x["h"] == F.get(o, i - 1)["h"]) | (x["h"] == F.get(o, i + 1)["h"]), x["i"]
            )),
            lambda x: x.isNotNull(),
        ))))

    def _union_length(places: Column) -> Column:
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(_WINDOW)), F.lit(_WINDOW))),
            F.lit(0).cast("long"),
            lambda total, x: total + x,
        ))

    several = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0)
    return F.when(size > _WINDOW, let(hashes, lambda h: let(windows(h), several))).otherwise(0).cast("long")


def _line_counts(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: _without(line, _SPACES) > 0)
    return let(lines, lambda kept: F.struct(
        F.size(kept).cast("long").alias("n_lines"),
        (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"),
    ))


def measure(docs: DataFrame, *carried: str) -> DataFrame:
    """``doc_id``, the counts of each whole text, and the columns in ``carried``."""
    text = F.coalesce("text", F.lit(""))
    by_words = let(_words(text), lambda words: F.struct(
        F.size(words).cast("long").alias("n_words"), _repeat_words(words).alias("n_repeat_words")
    ))
    measured = docs.select("doc_id", *carried, F.struct(
        by_words.alias("by_words"),
        _line_counts(text).alias("by_lines"),
        _without(text, _SPACES).cast("long").alias("word_chars"),
        (F.length(text) - _without(text, _SYMBOLS)).cast("long").alias("n_symbols"),
    ).alias("m"))
    return measured.select(
        "doc_id", *carried, "m.by_words.n_words", "m.word_chars", "m.n_symbols",
        "m.by_lines.n_dup_lines", "m.by_words.n_repeat_words", "m.by_lines.n_lines",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(errors: Column, size: Column, rate: float) -> Column:
    """Chance of at most ``errors`` among ``size`` draws at ``rate``: the exact sum of its terms."""
    odds = math.log(rate / (1 - rate))
    start = F.struct(
        (size * math.log1p(-rate)).alias("term"),  # logarithm of the current term
        F.exp(size * math.log1p(-rate)).alias("total"),
    )

    def add(state: Column, k: Column) -> Column:
        term = state["term"] + F.log((size - k + 1) / k) + odds
        return F.struct(term.alias("term"), (state["total"] + F.exp(term)).alias("total"))

    steps = F.when(errors > 0, F.sequence(F.lit(1).cast("long"), errors)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, add, lambda state: state["total"])


def counted_errors(measured: DataFrame, labels: DataFrame, params: RuleParams) -> DataFrame:
    """Per stratum the labelled good documents (``size``) and, by rule and cutoff, those it would reject
    (``<rule>_good``) and the bad ones (``<rule>_bad``), as arrays along the grid.

    Only documents that pass the base rule take part, as it rejects the others anyway.
    """
    known = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    held = measured.filter(~base_failed()).join(known, "doc_id")
    sums = [
        F.array(*(
            F.sum(((F.col("quality") == wanted) & (share() > cutoff)).cast("long")) for cutoff in params.grid
        )).alias(f"{name}_{side}")
        for name, share in RULES.items()
        for side, wanted in (("good", 1), ("bad", 0))
    ]
    return held.groupBy("stratum").agg(F.sum((F.col("quality") == 1).cast("long")).alias("size"), *sums)


def cutoffs(counted: DataFrame, params: RuleParams) -> DataFrame:
    """One row per stratum: a ``<rule>_cutoff`` for each rule, null where none is proven or of use.

    Of the accepted cutoffs that is taken which rejects most bad documents beyond the good ones.
    """
    strata = counted.agg(F.count("*")).scalar()
    rate = params.risk / len(RULES)
    counted = counted.select("*", (F.lit(params.level) / (len(RULES) * strata)).alias("level"))

    def accepted(name: str) -> Column:
        def passes(errors: Column) -> Column:
            # More errors than the rate expects cannot refute it, so long sums are not made.
            tail = binomial_tail(errors, F.col("size"), rate)
            return F.when(errors > F.col("size") * rate, False).otherwise(tail <= F.col("level"))

        return F.transform(F.col(f"{name}_good"), passes).alias(f"{name}_ok")

    def best(name: str) -> Column:
        options, proven = [], F.lit(True)
        for step, cutoff in enumerate(params.grid):
            proven = proven & F.col(f"{name}_ok")[step]
            gain = F.col(f"{name}_bad")[step] - F.col(f"{name}_good")[step]
            option = F.struct(gain.alias("gain"), F.lit(-step).alias("mild"), F.lit(cutoff).alias("cutoff"))
            options.append(F.when(proven & (gain > 0), option))
        return F.array_max(F.array(*options))["cutoff"].alias(f"{name}_cutoff")

    return counted.select("*", *(accepted(name) for name in RULES)).select("stratum", *(best(name) for name in RULES))


def apply_rules(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, stratum: str = "lang", params: RuleParams | None = None
) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and the ``rejected_by`` rule, if any."""
    params = params or RuleParams()
    measured = staged(spark, measure(docs.select("doc_id", "text", F.col(stratum).alias("stratum")), "stratum"))
    counted = staged(spark, counted_errors(measured, labels, params))
    chosen = cutoffs(counted, params).withColumnRenamed("stratum", "of_stratum")
    judged = measured.join(chosen, F.col("stratum").eqNullSafe(F.col("of_stratum")), "left")
    rejected = F.when(base_failed(), "base")
    for name, share in RULES.items():
        rejected = rejected.when(share() > F.col(f"{name}_cutoff"), name)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), rejected.isNull().alias("kept"), rejected.alias("rejected_by"),
    )
