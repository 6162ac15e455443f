from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seatscope.llm.features import NAMES, text_features
from seatscope.llm.frames import remainder
from seatscope.llm.quality import QualityParams, fit_quality, learn, score_quality


def corpus(count=700, seed=4):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(count):
        words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(rng.randrange(12, 90))]
        kind = rng.randrange(4)
        if kind == 0:
            words = [w + rng.choice(["###", "%%", ""]) for w in words]
        elif kind == 1 and rng.random() < 0.5:
            words = [words[0]] * len(words)
        good = not (kind == 0 or len(set(words)) == 1)
        rows.append((i, " ".join(words)))
        marks.append(int(good))
    return rows, marks


def test_held_out_documents_are_told_apart(spark, documents, labels):
    rows, marks = corpus()
    docs = documents(rows)
    training = remainder(F.col("doc_id"), 4) != 2
    model = fit_quality(docs, labels([(i, m, 0) for i, m in enumerate(marks)]), training)
    scored = score_quality(docs, model).filter(~training).collect()
    right = [(r["score"] >= 0.7) == bool(marks[r["doc_id"]]) for r in scored]
    assert len(right) > 100 and np.mean(right) > 0.97


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(1)
    features = rng.normal(size=(3000, 4))
    good = ((features[:, 0] > 0) ^ (features[:, 2] > 0)).astype(float)
    model = learn(features[:2000], good[:2000], QualityParams(rounds=40, pairs=2))
    assert (0, 2) in model.pairs
    assert ((model.score(features[2000:]) > 0.5) == good[2000:]).mean() > 0.9
    alone = learn(features[:2000], good[:2000], QualityParams(rounds=40, pairs=0))
    assert ((alone.score(features[2000:]) > 0.5) == good[2000:]).mean() < 0.65


def test_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(2)
    features, good = rng.normal(size=(400, 3)), (rng.random(400) > 0.4).astype(float)
    model = learn(features, good, QualityParams(rounds=10, pairs=2, pair_rounds=5))
    row = features[7]
    total = model.intercept + sum(t[np.sum(e <= x)] for t, e, x in zip(model.tables, model.edges, row))
    for (a, b), table in zip(model.pairs, model.pair_tables):
        total += table[np.sum(model.pair_edges[a] <= row[a]), np.sum(model.pair_edges[b] <= row[b])]
    assert np.isclose(model.score(row[None])[0], 1 / (1 + np.exp(-total)))


def test_features_of_one_text_do_not_depend_on_others(edge_rows):
    texts = [t for _, t in edge_rows] + ["A b! a b c d\na b c d e a b c d e\n\n| x |", "UPPER 12", "###"]
    together = text_features(pa.array(texts, pa.string()))
    alone = np.concatenate([text_features(pa.array([t], pa.string())) for t in texts])
    assert np.array_equal(together, alone) and np.isfinite(together).all()
    assert not together[:3].any()
    named = dict(zip(NAMES, together[-3]))
    assert named["log_words"] == np.log1p(19) and named["repeated_windows"] == 2 / 19
    row = dict(zip(NAMES, text_features(pa.array(["a b c d e a b c d e\nq\nq"]))[0]))
    assert row["repeated_windows"] == 2 / 12 and row["repeated_lines"] == 2 / 3 and row["top_word"] == 2 / 12


def test_without_labels_scores_are_even(spark, documents, labels, edge_rows):
    docs = documents(edge_rows, ("Score double", 5.0))
    for known in ([], [(None, 1, 0), (999, 1, 1), (1, None, 1)]):
        scored = score_quality(docs, fit_quality(docs, labels(known), F.lit(True)))
        assert scored.columns == [*docs.columns, "score_"]
        assert {r["score_"] for r in scored.collect()} == {0.5} and scored.count() == len(edge_rows)
    repeated = fit_quality(docs, labels([(4, 0, 0), (4, 1, 0), (6, 1, 0)]), F.lit(True))
    assert (repeated.score(np.zeros((1, len(NAMES)))) > 0.9).all()
    assert score_quality(documents([]), repeated).count() == 0
