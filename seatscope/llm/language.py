"""Language of whole texts by a bidirectional recurrent network over their bytes.

The network labels every byte; the chances of all bytes of a text are averaged, and the language with
the largest average is predicted. Texts are read in windows of fixed length, all bytes of every text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; training rows with a null
text or language are left out; with no training row every text is ``und``; ties go to the language
first in order; rows and other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatscope.llm.frames import free_name, one_text_each, tidy
from seatscope.llm.gru import ByteTagger, GruParams, train
from seatscope.llm.words import Block, blocks

UNDETERMINED = "und"
_PARTS = 64


@dataclass(frozen=True)
class LanguageParams:
    """``per_language`` documents, one window of each, bound the training sample."""

    per_language: int = 1000
    gru: GruParams = GruParams()


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    tagger: ByteTagger | None
    params: GruParams


def training_windows(docs: DataFrame, training: Column, params: LanguageParams) -> DataFrame:
    """``lang`` and ``text``: a window of each sampled document, at a place drawn from its hash."""
    usable = docs.filter(training & F.col("lang").isNotNull() & (F.length("text") > 0))
    ids = usable.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(_PARTS)).alias("part"))
    for keys in (["lang", "part"], ["lang"]):  # parts first, so that no common language meets in one task
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id"))
        ids = ids.withColumn("rank", rank).filter(F.col("rank") <= params.per_language)
    # per_language ids for each language: small by construction.
    chosen = F.broadcast(ids.select("doc_id", "lang").distinct())
    room = F.greatest(F.length("text") - params.gru.window + 1, F.lit(1))
    place = F.pmod(F.xxhash64("doc_id", F.lit("window")), room) + 1
    windows = usable.join(chosen, ["doc_id", "lang"]).select(
        "doc_id", "lang", F.substring("text", place.cast("int"), F.lit(params.gru.window)).alias("text")
    )
    return one_text_each(windows, "doc_id", "lang").select("lang", "text")


def fit_language(docs: DataFrame, training: Column, params: LanguageParams | None = None) -> LanguageModel:
    """Learn from the documents for which ``training`` (an expression on doc_id) holds."""
    params = params or LanguageParams()
    sample = training_windows(docs, training, params).toArrow().sort_by([("lang", "ascending"), ("text", "ascending")])
    texts = [text.encode() for text in sample.column("text").to_pylist()]
    if not texts:
        return LanguageModel([], None, params.gru)
    languages, labels = np.unique(sample.column("lang").to_pylist(), return_inverse=True)
    # A shorter text is repeated to the length of the window.
    size = params.gru.window
    windows = np.stack([np.frombuffer((text * (-(-size // len(text))))[:size], np.uint8) for text in texts])
    return LanguageModel(languages.tolist(), train(windows, labels, len(languages), params.gru), params.gru)


def _block_chances(block: Block, model: LanguageModel) -> np.ndarray:
    """Average class chances of each row of a block; zeros for an empty text."""
    size, lengths = model.params.window, np.diff(block.offsets)
    count = -(-lengths // size)
    row = np.repeat(np.arange(block.rows), count)
    slot = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = block.offsets[:-1][row] + slot * size
    used = np.minimum(block.offsets[1:][row] - start, size)
    sums = np.zeros((len(model.languages), len(row)), np.float32)
    data = np.append(block.data, np.zeros(size, np.uint8))
    for chosen, whole in ((np.flatnonzero(used == size), True), (np.flatnonzero(used < size), False)):
        for at in range(0, len(chosen), model.params.windows_at_once):
            part = chosen[at : at + model.params.windows_at_once]
            longest = size if whole else int(used[part].max())
            codes = np.ascontiguousarray(data[start[part][:, None] + np.arange(longest)].T)
            sums[:, part] = model.tagger.window_sums(codes, None if whole else used[part])
    totals = np.stack([np.bincount(row, one, block.rows) for one in sums])
    return totals / np.maximum(lengths, 1)


def text_languages(texts: pa.Array, model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Predicted language and its average chance for each whole text."""
    found = [UNDETERMINED] * len(texts)
    scores = np.zeros(len(texts))
    if model.tagger is None:
        return found, scores
    lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
    for block in blocks(texts):
        chances = _block_chances(block, model)
        best = chances.argmax(axis=0)
        for row in np.flatnonzero(lettered[block.first : block.last]):
            found[block.first + row] = model.languages[best[row]]
            scores[block.first + row] = min(max(float(chances[best[row], row]), 0.0), 1.0)
    return found, scores


def predict_language(docs: DataFrame, model: LanguageModel, name: str = "lang_pred", score: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` plus the predicted language and its score."""
    name = free_name(name, docs.columns)
    score = free_name(score, [*docs.columns, name])
    added = [T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())]
    text_at = docs.columns.index("text")

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores = text_languages(batch.column(text_at), model)
            columns = [*batch.columns, pa.array(languages, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, name, score])

    return docs.mapInArrow(tidy(predicted), T.StructType([*docs.schema.fields, *added]))
