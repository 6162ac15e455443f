"""Bit maps of fixed size that stand for sets of 64-bit keys; a key in the set is always found."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bits_of(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each key in a map of ``2 ** bits`` bits."""
    mask = np.uint64((1 << bits) - 1)
    return (keys & mask).astype(np.int64), (keys >> np.uint64(64 - bits)).astype(np.int64)


def is_in(bitmap: np.ndarray, places: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    held = np.ones(len(places[0]), bool)
    for place in places:
        held &= (bitmap[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return held


def bitmap_of(keyed: DataFrame, bits: int) -> np.ndarray:
    """The map of column ``key``; at most ``2 ** bits / 64`` rows come to the driver."""
    low = F.col("key").bitwiseAND((1 << bits) - 1)
    high = F.expr(f"shiftrightunsigned(key, {64 - bits})")
    marked = keyed.select(F.explode(F.array(low, high)).alias("bit")).groupBy(F.expr("shiftright(bit, 6)").alias("at"))
    rows = marked.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("word")).toArrow()
    bitmap = np.zeros(max(1, (1 << bits) // 64), np.uint64)
    bitmap[rows["at"].to_numpy()] = rows["word"].to_numpy().view(np.uint64)
    return bitmap
