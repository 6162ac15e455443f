"""Quality scores by a generalised additive model with pairwise interactions.

The model is a sum of lookup tables, one per feature and one for each of a few pairs of features. They
are learned by cyclic boosting: feature after feature, round after round, a shallow tree over the bins
of that feature is fitted to the current error and added to its table with a small step. Pairs are
then chosen by the error that a tree over both can still remove, and boosted in the same way.
Scoring is a table lookup per feature and pair and one addition each, over whole arrays.

Defined results: a null or empty text has all features zero and scores like any such text; labels
without a document, with a null label or a null id are ignored; a document labelled several times takes
the larger label; with no usable label every score is 0.5; rows and other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatscope.llm.features import NAMES, text_features
from seatscope.llm.frames import free_name, one_text_each, tidy


@dataclass(frozen=True)
class QualityParams:
    """``max_rows`` bounds the training sample; scoring has no bound."""

    max_rows: int = 20_000
    bins: int = 48
    pair_bins: int = 12
    pairs: int = 8
    rounds: int = 150
    pair_rounds: int = 60
    step: float = 0.1
    leaves: int = 4
    ridge: float = 5.0


@dataclass(frozen=True)
class QualityModel:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, features: np.ndarray) -> np.ndarray:
        total = np.full(len(features), self.intercept)
        for column, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, features[:, column], "right")]
        if self.pairs:
            coarse = [np.searchsorted(e, features[:, c], "right") for c, e in enumerate(self.pair_edges)]
            for (a, b), table in zip(self.pairs, self.pair_tables):
                total += table[coarse[a], coarse[b]]
        return _logistic(total)


def _logistic(values: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(values, -40, 40)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Bin borders at quantiles, half-way between different values."""
    distinct = np.unique(values)
    if len(distinct) > bins:
        distinct = np.unique(np.quantile(values, np.linspace(0, 1, bins), method="lower"))
    return (distinct[:-1] + distinct[1:]) / 2


def _gain(gradient, weight, ridge):
    return gradient**2 / (weight + ridge)


def _best_cut(gradient: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; place 0 is no cut."""
    if len(gradient) < 2:
        return 0.0, 0
    left_g, left_w = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
    all_g, all_w = gradient.sum(), weight.sum()
    gains = _gain(left_g, left_w, ridge) + _gain(all_g - left_g, all_w - left_w, ridge) - _gain(all_g, all_w, ridge)
    at = int(gains.argmax())
    return (float(gains[at]), at + 1) if gains[at] > 0 else (0.0, 0)


def _line_tree(gradient, weight, leaves: int, ridge: float) -> np.ndarray:
    """A tree over the bins of one feature: the best leaf is cut until there are ``leaves``."""
    parts = [(0, len(gradient))]
    cuts = [_best_cut(gradient, weight, ridge)]
    while len(parts) < leaves:
        best = max(range(len(parts)), key=lambda i: cuts[i][0])
        if not cuts[best][1]:
            break
        low, high = parts[best]
        middle = low + cuts[best][1]
        parts[best : best + 1] = [(low, middle), (middle, high)]
        cuts[best : best + 1] = [_best_cut(gradient[a:b], weight[a:b], ridge) for a, b in ((low, middle), (middle, high))]
    value = np.zeros(len(gradient))
    for low, high in parts:
        value[low:high] = -gradient[low:high].sum() / (weight[low:high].sum() + ridge)
    return value


def _square_tree(gradient, weight, ridge: float) -> tuple[float, np.ndarray]:
    """Two levels over two features: one cut along one, then one along the other in each half."""
    best, value = 0.0, np.zeros_like(gradient)
    for turned in (False, True):
        g, w = (gradient.T, weight.T) if turned else (gradient, weight)
        left_g, left_w = np.cumsum(g, axis=0)[:-1], np.cumsum(w, axis=0)[:-1]
        for at in range(len(left_g)):
            halves = [(slice(0, at + 1), left_g[at], left_w[at])]
            halves.append((slice(at + 1, None), g.sum(axis=0) - left_g[at], w.sum(axis=0) - left_w[at]))
            found = [_best_cut(hg, hw, ridge) for _, hg, hw in halves]
            gain = sum(f[0] + _gain(hg.sum(), hw.sum(), ridge) for f, (_, hg, hw) in zip(found, halves))
            gain -= _gain(g.sum(), w.sum(), ridge)
            if gain > best + 1e-12:
                best, shape = gain, np.zeros_like(g)
                for (_, cut), (part, hg, hw) in zip(found, halves):
                    for across in (slice(0, cut), slice(cut, None)):
                        shape[part, across] = -hg[across].sum() / (hw[across].sum() + ridge)
                value = shape.T if turned else shape
    return best, value


def learn(features: np.ndarray, good: np.ndarray, params: QualityParams) -> QualityModel:
    columns = range(features.shape[1])
    edges = [_edges(features[:, c], params.bins) if len(features) else np.zeros(0) for c in columns]
    coarse_edges = [_edges(features[:, c], params.pair_bins) if len(features) else np.zeros(0) for c in columns]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not len(good):
        return QualityModel(0.0, edges, tables, coarse_edges, [], [])
    share = np.clip(good.mean(), 1e-3, 1 - 1e-3)
    intercept = float(np.log(share / (1 - share)))
    bins = [np.searchsorted(e, features[:, c], "right") for c, e in enumerate(edges)]
    total = np.full(len(good), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        chance = _logistic(total)
        return chance - good, np.maximum(chance * (1 - chance), 1e-6)

    for _ in range(params.rounds):
        for column in columns:
            gradient, weight = slopes()
            size = len(tables[column])
            move = params.step * _line_tree(
                np.bincount(bins[column], gradient, size), np.bincount(bins[column], weight, size), params.leaves, params.ridge
            )
            tables[column] += move
            total += move[bins[column]]

    coarse = [np.searchsorted(e, features[:, c], "right") for c, e in enumerate(coarse_edges)]

    def square(pair: tuple[int, int]) -> tuple[float, np.ndarray]:
        (a, b), (gradient, weight) = pair, slopes()
        shape = len(coarse_edges[a]) + 1, len(coarse_edges[b]) + 1
        flat = coarse[a] * shape[1] + coarse[b]
        size = shape[0] * shape[1]
        return _square_tree(
            np.bincount(flat, gradient, size).reshape(shape), np.bincount(flat, weight, size).reshape(shape), params.ridge
        )

    ranked = sorted(combinations(columns, 2), key=lambda pair: -square(pair)[0])
    pairs = ranked[: params.pairs]
    pair_tables = [np.zeros((len(coarse_edges[a]) + 1, len(coarse_edges[b]) + 1)) for a, b in pairs]
    for _ in range(params.pair_rounds):
        for number, (a, b) in enumerate(pairs):
            move = params.step * square((a, b))[1]
            pair_tables[number] += move
            total += move[coarse[a], coarse[b]]
    return QualityModel(intercept, edges, tables, coarse_edges, pairs, pair_tables)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.array(list(text_features(batch.column("text"))), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("good"), rows], names=["good", "features"])


def fit_quality(docs: DataFrame, labels: DataFrame, training: Column, params: QualityParams | None = None) -> QualityModel:
    """Learn from at most ``max_rows`` labelled documents for which ``training`` (on doc_id) holds."""
    params = params or QualityParams()
    usable = labels.filter(training & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    labelled = usable.groupBy("doc_id").agg(F.max(F.col("quality").cast("double")).alias("good"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.max_rows)
    # At most max_rows rows of two numbers: small by construction.
    texts = one_text_each(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "doc_id", "good")
    table = texts.select("good", "text").mapInArrow(tidy(_featured), "good double, features array<double>").toArrow()
    features = table.column("features").combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES))
    return learn(features, table.column("good").to_numpy(), params)


def score_quality(docs: DataFrame, model: QualityModel, score: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` plus ``score``, from 0 to 1."""
    score = free_name(score, docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    text_at = docs.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array(model.score(text_features(batch.column(text_at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, score])

    return docs.mapInArrow(tidy(scored), schema)
