"""The training samples are bounded in rows, also where one id holds most rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatscope.llm import language, quality, toxicity


def repeated(documents):
    return documents([(1, f"text number {i}") for i in range(500)] + [(2, "two"), (3, "three"), (4, None)])


def test_toxicity_sample(spark, documents, labels):
    params = toxicity.ToxicityParams(max_toxic=1, max_unlabelled=2)
    rows = toxicity.training_rows(repeated(documents), labels([(1, 1, 1)]), F.lit(True), params).collect()
    assert sum(r["toxic"] for r in rows) == 1 and sum(not r["toxic"] for r in rows) == 2


def test_quality_sample(spark, documents, labels, monkeypatch):
    sizes = []
    monkeypatch.setattr(quality, "learn", lambda features, good, params: sizes.append(len(good)))
    given = labels([(i, i % 2, 0) for i in range(1, 5)])
    for bound in (2, 10):
        quality.fit_quality(repeated(documents), given, F.lit(True), quality.QualityParams(max_rows=bound))
    assert sizes == [2, 4]


def test_language_sample(spark, documents):
    params = language.LanguageParams(per_language=2)
    assert language.training_windows(repeated(documents), F.lit(True), params).count() <= 2
