from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from seatscope.llm.phrases import PhraseParams, count_phrases, mine_phrases, staged_words


def brute(docs, params):
    """``lang`` to the rows of its best phrases, by plain counting."""
    counts = {}
    for text, lang in docs:
        own = counts.setdefault(lang or "und" if lang is None else lang, Counter())
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    result = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        kept = {p: a for p, a in f.items() if len(p) > 1 and a >= params.threshold}
        inside = Counter()
        for p, a in kept.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    inside[part] = max(inside[part], a)
        rows = []
        for p, a in kept.items():
            if len(p) == 2 and 100 * inside[p] >= params.inside * a:
                continue
            score, _, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[: params.top], 1):
            result.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(result)


def sample(seed, size=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["É", "Über", "東京"]
    docs = []
    for _ in range(size):
        text = "".join(
            rng.choice(["of THE end", rng.choice(words[: rng.randrange(1, 28)])]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\r"])
            for _ in range(rng.choice([0, 1, 30, 90]))
        )
        docs.append((text, rng.choice(["en", "de", None, "und"])))
    return [*docs, (None, "en"), (None, None), ("", "fr"), ("one two. three", "")]


@pytest.mark.parametrize("params", [
    PhraseParams(), PhraseParams(threshold=3, top=20, shards=3), PhraseParams(threshold=2, inside=101, filter_bits=6, shards=4),
])
def test_phrases_equal_brute_force(spark, params):
    docs = sample(params.shards)
    frame = spark.createDataFrame([(t, g, 1, "x") for t, g in docs], "text string, lang string, n int, shard string")
    frame = frame.repartition(7)
    assert sorted(tuple(r) for r in mine_phrases(spark, frame, params=params).collect()) == brute(docs, params)


def test_each_phrase_is_counted_over_one_cycle(spark):
    """Phrases that reach the threshold late, in one part only, still have whole counts."""
    texts = ["a b c"] * 9 + ["x y"] * 40 + ["a b c d"] * 3
    frame = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(6)
    for shards in (1, 2, 5):
        words = staged_words(spark, frame, "lang", shards)
        counts = count_phrases(spark, words, PhraseParams(shards=shards)).collect()
        assert sorted((r["size"], r["n"]) for r in counts) == [(1, 12)] * 3 + [(1, 40)] * 2 + [(2, 12)] * 2 + [(2, 40), (3, 12)]


def test_long_pieces_and_empty_tables(spark):
    docs = [("long piece " * 60_000, "en"), ("a " * 20, "en")]
    frame = spark.createDataFrame(docs, "text string, lang string")
    params = PhraseParams(inside=101)
    assert sorted(tuple(r) for r in mine_phrases(spark, frame, params=params).collect()) == brute(docs, params)
    assert mine_phrases(spark, frame.limit(0)).count() == 0
