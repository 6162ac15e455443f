from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seatscope.llm.frames import remainder
from seatscope.llm.gru import ByteTagger, GruParams
from seatscope.llm.language import LanguageModel, LanguageParams, fit_language, predict_language, text_languages

SMALL = GruParams(hidden=6, window=48, batch=48, steps=150)
SYLLABLES = {"aa": ["tion", "the", "ing", "er"], "bb": ["eau", "ré", "ou", "le"], "cc": ["ung", "sch", "ä", "ei"]}


def corpus(count=360, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(6, 60))]
        rows.append((i, " ".join(words), lang))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    return docs, fit_language(docs, remainder(F.col("doc_id"), 3) != 1, LanguageParams(gru=SMALL))


def test_held_out_documents_are_told_apart(fitted):
    docs, model = fitted
    held = predict_language(docs, model).filter(remainder(F.col("doc_id"), 3) == 1).collect()
    assert len(held) > 80 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in held)


def test_gradients_equal_differences():
    params = GruParams(hidden=3, window=7)
    model = ByteTagger([w.astype(np.float64) for w in ByteTagger.fresh(3, params).weights])
    rng = np.random.default_rng(0)
    codes, labels = rng.integers(0, 256, (7, 5)), rng.integers(0, 3, 5)
    _, slopes = model.gradients(codes, labels)
    for weights, slope in zip(model.weights, slopes):
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        kept, ends = weights[at], []
        for step in (1e-2, -1e-2):
            weights[at] = kept + step
            ends.append(model.gradients(codes, labels)[0])
        weights[at] = kept
        assert slope[at] == pytest.approx((ends[0] - ends[1]) / 2e-2, rel=0.02)


def slow_chances(text, model):
    """Every byte labelled on its own, window by window."""
    tagger, size = model.tagger, model.params.window
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    total, raw = np.zeros(len(model.languages)), text.encode()
    for start in range(0, len(raw), size):
        part, states = raw[start : start + size], []
        for direction, order in ((tagger.forward, 1), (tagger.backward, -1)):
            h, n, found = np.zeros(direction.hidden), direction.hidden, {}
            for t in range(len(part))[::order]:
                x, past = direction.table[:, part[t]], direction.recurrent @ h
                z, r = sigmoid(x[:n] + past[:n]), sigmoid(x[n : 2 * n] + past[n : 2 * n])
                new = np.tanh(x[2 * n :] + r * past[2 * n :])
                h = found[t] = new + z * (h - new)
            states.append(found)
        for t in range(len(part)):
            logits = tagger.output @ np.append(states[0][t], states[1][t]) + tagger.bias[:, 0]
            total += np.exp(logits) / np.exp(logits).sum()
    return total / len(raw)


def test_all_bytes_are_labelled_and_averaged(fitted):
    _, model = fitted
    texts = ["the tion " * 20, "x", "eau ré " * 7 + "1", "a" * 48, "b" * 49]
    found, scores = text_languages(pa.array(texts), model)
    for text, language, score in zip(texts, found, scores):
        chances = slow_chances(text, model)
        assert model.languages[int(chances.argmax())] == language
        assert score == pytest.approx(chances.max(), abs=1e-4)


def test_texts_without_letters(fitted, spark, edge_rows):
    _, model = fitted
    rows = [*edge_rows, (20, "12 !? ²½"), (21, "東"), (22, "_1")]
    docs = spark.createDataFrame([(*r, 1, "kept") for r in rows], "doc_id long, text string, SCORE int, lang_pred string")
    found = predict_language(docs, model)
    assert found.columns == [*docs.columns, "lang_pred_", "score_"]
    by_text = {r["text"]: (r["lang_pred_"], r["score_"]) for r in found.collect()}
    assert [by_text[t] for t in (None, "", " \n\t ", "12 !? ²½", "_1")] == [("und", 0.0)] * 5
    assert by_text["東"][0] in SYLLABLES and by_text["word"][0] in SYLLABLES
    assert found.count() == len(rows)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, None, "aa"), (2, "x", None), (3, "", "aa")], "doc_id long, text string, lang string")
    model = fit_language(docs, F.lit(True))
    assert model == LanguageModel([], None, GruParams())
    assert {(r["lang_pred"], r["score"]) for r in predict_language(docs, model).collect()} == {("und", 0.0)}
    assert predict_language(docs.limit(0), model).count() == 0
