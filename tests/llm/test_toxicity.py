from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seatscope.llm.frames import remainder
from seatscope.llm.toxicity import ToxicityModel, ToxicityParams, drop_toxic, fit_toxicity, learn, score_toxicity, text_scores

INSULTS = ["grobian", "tölpel", "schuft"]


def corpus(count=900, seed=2):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(count):
        words = ["".join(rng.choices("abcdef", k=3)) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.15
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS).title())
        rows.append((i, " ".join(words) + "!"))
        marks.append(int(toxic))
    return rows, marks


def test_held_out_documents_are_told_apart(spark, documents, labels):
    rows, marks = corpus()
    known = labels([(i, 1, m) for i, m in enumerate(marks) if i % 3])
    docs = documents(rows)
    training = remainder(F.col("doc_id"), 5) != 0
    scored = score_toxicity(docs, fit_toxicity(docs, known, training)).select("doc_id", "score", (~training).alias("held"))
    held = [r for r in scored.collect() if r["held"]]
    assert len(held) > 100 and all((r["score"] >= 0.5) == bool(marks[r["doc_id"]]) for r in held)


def test_scores_equal_one_text_at_a_time(edge_rows):
    rows, marks = corpus(300)
    texts = [t for _, t in rows]
    hashes = [np.unique(np.frombuffer(np.array([hash(w) for w in t.lower().split()]), np.int64)) for t in texts]
    toxic = np.array(marks, bool)
    model = learn(toxic, np.repeat(np.arange(300), [len(h) for h in hashes]), np.concatenate(hashes), 0.15, ToxicityParams())
    assert len(model.words) and (np.diff(model.words.astype(object)) > 0).all()
    mixed = texts[:20] + [t for _, t in edge_rows]
    together = text_scores(pa.array(mixed, pa.string()), model)
    alone = [text_scores(pa.array([t], pa.string()), model)[0] for t in mixed]
    assert together.tolist() == alone and ((together >= 0) & (together <= 1)).all()


def test_a_step_against_the_clean_risk_keeps_it_from_falling_below_zero():
    # Two toxic rows that are also unlabelled: an unchecked estimate of the clean risk would go negative.
    toxic = np.array([True, True, False, False, False, False])
    rows, words = np.arange(6), np.array([1, 2, 1, 2, 3, 4])
    model = learn(toxic, rows, words, 0.5, ToxicityParams(min_documents=1))
    margins = {int(w): g + model.bias for w, g in zip(model.words, model.weights)}
    assert margins[1] > 0 > model.bias and max(map(abs, margins.values())) < 20


def test_without_labels_nothing_is_toxic(spark, documents, labels, edge_rows):
    docs = documents(edge_rows, ("score int", 9), ("toxic int", 9))
    for known in ([], [(1, 1, 0), (1, None, None), (None, 0, 1), (12345, 0, 1)]):
        model = fit_toxicity(docs, labels(known), F.col("doc_id") >= 0)
        kept = drop_toxic(docs, model)
        assert kept.columns == docs.columns and kept.count() == len(edge_rows)
        assert {r["score_"] for r in score_toxicity(docs, model).collect()} == {0.0} or not known
    assert fit_toxicity(documents([]), labels([]), F.lit(True)).weights.tolist() == []


def test_toxic_documents_go(spark, documents):
    model = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 50.0)
    assert drop_toxic(documents([(1, "x"), (2, None)]), model).count() == 0
