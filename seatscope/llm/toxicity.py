"""Toxicity scores by non-negative positive-unlabelled learning.

Only confirmed toxic documents and unlabelled text are used for the weights; the class prior is the share
of toxic rows among all labelled rows of the training part, so it also looks at rows labelled clean. A linear model over words
minimises the class-prior-corrected risk

    prior * E_toxic[loss(+)]  +  max(0, E_unlabelled[loss(-)] - prior * E_toxic[loss(-)])

whose second part estimates the risk on clean text; where it falls below zero the step goes back up
that part, which keeps a flexible model from fitting the few toxic examples by heart.

Defined results: a null or empty text has no word and scores by the bias alone; a label row without
a document, or with a null label, is ignored; a document labelled several times is toxic if one row
says so; with no toxic label in the training rows every score is 0. Documents keep their rows and
columns, repeated ids included; a result column whose name is taken replaces none of them, the
caller names it. Of an id that repeats, the training sample takes one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatscope.llm.frames import free_name, one_text_each, tidy
from seatscope.llm.words import ALPHANUMERIC, LOWER, blocks, find_words, word_hashes


@dataclass(frozen=True)
class ToxicityParams:
    """Bounds of the training sample, of the words the model looks at, and of the optimiser; scoring has none.

    ``max_features`` words of at least ``min_documents`` toxic texts are weighed, those that tell most; words
    beyond them have no weight.
    """

    max_toxic: int = 3000
    max_unlabelled: int = 9000
    max_features: int = 512
    min_documents: int = 2
    steps: int = 600
    step_size: float = 0.05
    sparsity: float = 0.004  # L1 strength, divided by the root of the number of toxic examples
    prior_range: tuple[float, float] = (0.002, 0.5)


@dataclass(frozen=True)
class ToxicityModel:
    """Sorted word hashes with a weight each; without words the bias alone decides."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float = field(default=0.0)


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = []
        for block in blocks(batch.column("text")):
            data = LOWER[block.data]
            found = find_words(data, block.offsets, ALPHANUMERIC)
            hashes = word_hashes(data, found).view(np.int64)
            sets += [np.unique(hashes[a:b]) for a, b in zip(found.rows[:-1], found.rows[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), pa.array(sets, pa.list_(pa.int64()))], names=["toxic", "words"]
        )


def training_rows(docs: DataFrame, labels: DataFrame, training: Column, params: ToxicityParams) -> DataFrame:
    """The bounded sample: ids first, by hash order, then the words of those documents only."""
    ids = docs.filter(training).select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
    toxic = labels.filter(F.col("toxic") == 1).select("doc_id").distinct()
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    confirmed = ids.join(toxic, "doc_id", "left_semi").orderBy(*order).limit(params.max_toxic)
    unlabelled = ids.orderBy(F.xxhash64(F.col("doc_id"), F.lit("unlabelled")), "doc_id").limit(params.max_unlabelled)
    chosen = confirmed.withColumn("toxic", F.lit(True)).unionByName(unlabelled.withColumn("toxic", F.lit(False)))
    # At most max_toxic + max_unlabelled ids of eight bytes: small by construction.
    texts = one_text_each(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "doc_id", "toxic")
    texts = texts.select("toxic", "text")
    return texts.mapInArrow(tidy(_word_sets), "toxic boolean, words array<bigint>")


def class_prior(labels: DataFrame, training: Column, params: ToxicityParams) -> float:
    """Share of toxic rows among all labelled rows of the training part."""
    share = labels.filter(training).agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    low, high = params.prior_range
    return float(min(max(share or 0.0, low), high))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, training: Column, params: ToxicityParams | None = None
) -> ToxicityModel:
    """Learn from the documents for which ``training`` (an expression on doc_id) holds."""
    params = params or ToxicityParams()
    prior = class_prior(labels, training, params)
    table = training_rows(docs, labels, training, params).toArrow().combine_chunks()
    toxic = table.column("toxic").to_numpy().astype(bool)
    words = table.column("words").combine_chunks()
    counts = np.diff(words.offsets.to_numpy())
    return learn(toxic, np.repeat(np.arange(len(toxic)), counts), words.flatten().to_numpy(), prior, params)


def learn(
    toxic: np.ndarray, rows: np.ndarray, hashes: np.ndarray, prior: float, params: ToxicityParams
) -> ToxicityModel:
    """``hashes[i]`` is a distinct word of row ``rows[i]``; ``toxic`` marks confirmed rows."""
    n_toxic, n_unlabelled = int(toxic.sum()), int((~toxic).sum())
    empty = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -np.inf, prior)
    if not n_toxic or not n_unlabelled or not len(hashes):
        return empty
    vocabulary, column = np.unique(hashes.view(np.uint64), return_inverse=True)
    with_toxic = np.bincount(column[toxic[rows]], minlength=len(vocabulary))
    with_any = np.bincount(column[~toxic[rows]], minlength=len(vocabulary))
    rate, base = with_toxic / n_toxic, (with_any + 1) / (n_unlabelled + 2)
    gain = np.where(with_toxic >= params.min_documents, rate * np.log(np.maximum(rate, 1e-12) / base), 0)
    chosen = np.argsort(-gain, kind="stable")[: params.max_features]
    chosen = np.sort(chosen[gain[chosen] > 0])
    if not len(chosen):
        return empty
    place = np.full(len(vocabulary), -1)
    place[chosen] = np.arange(len(chosen))
    kept = place[column] >= 0
    weights, bias = _descend(toxic, rows[kept], place[column[kept]], len(chosen), prior, params)
    used = weights != 0
    return ToxicityModel(vocabulary[chosen][used], weights[used], bias, prior)


def _descend(toxic, rows, columns, width, prior, params) -> tuple[np.ndarray, float]:
    """Proximal Adam on the non-negative risk with logistic loss."""
    weights, bias = np.zeros(width), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    n_toxic, n_other = toxic.sum(), (~toxic).sum()
    sparsity = params.sparsity / np.sqrt(n_toxic)
    for step in range(1, params.steps + 1):
        margin = np.bincount(rows, weights[columns], len(toxic)) + bias
        chance = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        clean_loss = np.logaddexp(0, margin)
        negative = clean_loss[~toxic].mean() - prior * clean_loss[toxic].mean()
        on_clean = np.where(toxic, -prior * chance / n_toxic, chance / n_other)
        if negative >= 0:
            slope = on_clean + np.where(toxic, -prior * (1 - chance) / n_toxic, 0)
        else:
            slope = -on_clean
        gradient = np.append(np.bincount(columns, slope[rows], width), slope.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = params.step_size * min(1.0, 2 * (1 - step / (params.steps + 1)))
        size = rate / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        move = size * first / (1 - 0.9**step)
        weights, bias = weights - move[:-1], bias - move[-1]
        weights = np.sign(weights) * np.maximum(np.abs(weights) - size[:-1] * sparsity, 0)
    return weights, float(bias)


def text_scores(texts: pa.Array, model: ToxicityModel) -> np.ndarray:
    """Chance of toxicity of every whole text: distinct known words, one weight each."""
    scores = [np.zeros(0)]
    for block in blocks(texts):
        margin = np.full(block.rows, model.bias)
        if len(model.words):
            data = LOWER[block.data]
            found = find_words(data, block.offsets, ALPHANUMERIC)
            hashes = word_hashes(data, found)
            at = np.minimum(np.searchsorted(model.words, hashes), len(model.words) - 1)
            hit = np.flatnonzero(model.words[at] == hashes)
            row = np.searchsorted(found.rows, hit, "right") - 1
            pairs = np.unique(row * len(model.words) + at[hit])
            margin += np.bincount(pairs // len(model.words), model.weights[pairs % len(model.words)], block.rows)
        scores.append(np.exp(-np.logaddexp(0, -margin)))
    return np.concatenate(scores)


def score_toxicity(docs: DataFrame, model: ToxicityModel, score: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` plus ``score``, from 0 to 1."""
    score = free_name(score, docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    text_at = docs.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array(text_scores(batch.column(text_at), model))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, score])

    return docs.mapInArrow(tidy(scored), schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The documents that score under ``threshold``, columns unchanged."""
    score = free_name("score", docs.columns)
    return score_toxicity(docs, model, score).filter(F.col(score) < threshold).select(*docs.columns)
