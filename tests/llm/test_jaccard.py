from __future__ import annotations

import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seatscope.llm import jaccard
from seatscope.llm.jaccard import BANDS, JaccardParams, jaccard_join


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} or ({tuple(words)} if words else set())


def brute(rows):
    """Sorted (doc_id, size, component) rows, every pair of different sets compared."""
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 10 * min(len(a), len(b)) >= 9 * max(len(a), len(b)) and 10 * len(a & b) >= 9 * len(a | b):
            parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((doc, len(sets[i]), least.get(root(i))) for i, (doc, _) in enumerate(rows)), key=str)


def found(spark, documents, rows, **params):
    result = jaccard_join(spark, documents(rows, ("key long", 1), ("n long", 2), ("hi long", 3)), JaccardParams(**params))
    return sorted(map(tuple, result.collect()), key=str)


def family(rng, size, copies, edits):
    """Texts of ``size`` words, each with some words of one base text changed."""
    base = [f"b{rng.randrange(10**6)}" for _ in range(size)]
    texts = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [f"x{rng.randrange(10**6)}"][: rng.randrange(2)]
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("small_bucket", [1, 4, 32])
def test_components_equal_brute_force(spark, documents, edge_rows, small_bucket):
    rng = random.Random(small_bucket)
    texts = [t for size in (5, 9, 11, 12, 14, 16, 24, 40, 90, 300) for t in family(rng, size, 14, 1 + size // 40)]
    texts += [t.upper() for t in texts[::9]] + [t + "\n" + t for t in texts[::11]]
    rows = [*edge_rows, *((100 + i, t) for i, t in enumerate(texts)), (None, texts[0]), (100, texts[5]), (None, None)]
    rng.shuffle(rows)
    assert found(spark, documents, rows, small_bucket=small_bucket) == brute(rows)


def test_similarity_at_the_limit(spark, documents):
    """Sets that differ by exactly as much as they may, and by one shingle more, at sizes around the bands."""
    rows, i = [], 0
    for n in [*range(9, 40), *(b + d for b in BANDS[3:8] for d in (-1, 0, 1))]:
        words = [f"n{n}w{k}" for k in range(n + 2)]
        for cut in range(0, 2 + n // 9):  # a set of the first n - cut shingles, and one of the last
            rows += [(i, " ".join(words)), (i + 1, " ".join(words[: n + 2 - cut]))]
            i += 2
            words = [f"{w}_" for w in words]
    assert found(spark, documents, rows) == brute(rows)


def boilerplate(n, own):
    rng = random.Random(n)
    common = [f"c{k}" for k in range(60)]
    return [(i, " ".join(common + [f"o{rng.randrange(10**9)}" for _ in range(own)])) for i in range(n)]


@pytest.mark.parametrize("own", [3, 4, 8])
def test_pairs_grow_with_the_texts_not_their_square(spark, documents, monkeypatch, own):
    """Texts with a long passage in common that are not similar enough give few pairs to compare."""
    compared = []
    linked = jaccard._linked
    monkeypatch.setattr(jaccard, "_linked", lambda s, sets, pairs: (compared.append(pairs.count()), linked(s, sets, pairs))[1])
    totals = []
    for n in (100, 200):
        compared.clear()
        assert found(spark, documents, boilerplate(n, own)) == brute(boilerplate(n, own))
        totals.append(sum(compared) / n)
    assert max(totals) <= 12  # a few for each text, of n / 2 in all


def test_shingles_of_sets_that_lie_together_are_counted_before_they_are_sent():
    """A row for each different shingle, not one for each shingle of each set."""
    sets = [[*range(1, 61), 1000 + 2 * i, 1001 + 2 * i] for i in range(100)]
    batch = pa.RecordBatch.from_pydict(
        {"hi": pa.array(range(100, 200), pa.int64()), "shingles": pa.array([[], *sets[1:]], pa.list_(pa.int64()))}
    )
    (counted,) = jaccard._counted(iter([batch.slice(0, 100)]))
    rows = {r["shingle"]: (r["times"], r["hi"]) for r in counted.to_pylist()}
    assert len(rows) == counted.num_rows == 60 + 2 * 99
    assert {rows[s][0] for s in range(1, 61)} == {99}
    assert all(rows[s] == (1, 100 + i) for i in range(1, 100) for s in sets[i][60:])
    (part,) = jaccard._counted(iter([batch.slice(98, 2)]))
    assert part.num_rows == 60 + 2 * 2


def crowded_keys(spark, docs, params):
    """Keys of many sets with all their (size, looks, met)."""
    docs = docs.select("doc_id", "text")
    listed = jaccard.staged(spark, docs.mapInArrow(jaccard.tidy(jaccard._listed(params.words)), jaccard._LISTED))
    keys = defaultdict(list)
    for r in jaccard.buckets(spark, listed, params).filter(F.col("met") > params.small_bucket).collect():
        keys[r["key"]].append((r["n"], r["looks"], r["met"]))
    return keys


def test_crowded_keys_hold_only_sets_of_sizes_that_are_looked_for(spark, documents):
    """Sets under a key that are too small for all that look there are not fetched, counted or compared."""
    texts = [" ".join([*(f"w{k}" for k in range(n)), f"own{n}_{i}"]) for n in range(24, 60, 2) for i in range(3)]
    rows = list(enumerate(texts))
    keys = crowded_keys(spark, documents(rows), JaccardParams(small_bucket=2))
    assert keys
    for sets in keys.values():
        looking = [n for n, looks, _ in sets if looks]
        assert all(9 * min(looking) <= 10 * n and n <= max(looking) for n, _, _ in sets)
        assert {met for _, _, met in sets} == {len(sets)}
    assert found(spark, documents, rows, small_bucket=2) == brute(rows)


def test_near_copies_of_one_text_are_brought_together_by_it(spark, documents, monkeypatch):
    """Copies that share no band of least hashes need no pairs when all are linked to one of them."""
    left = []
    rest = jaccard._rest
    monkeypatch.setattr(jaccard, "_rest", lambda *a: (left.append((d := rest(*a)).count()), d)[1])
    monkeypatch.setattr(jaccard, "_stars", lambda spark, crowded: spark.createDataFrame([], "a long, b long"))
    rng = random.Random(7)
    words = [f"b{k}" for k in range(120)]
    texts = [" ".join(words)]
    for _ in range(80):
        cut = sorted(rng.sample(range(120), 2))
        texts.append(" ".join(f"x{rng.randrange(10**6)}" if k in cut else w for k, w in enumerate(words)))
    rows = list(enumerate(texts))
    assert found(spark, documents, rows, small_bucket=8) == brute(rows)
    assert left == [0]


def test_groups_of_a_third_of_all_rows(spark, documents):
    rng = random.Random(3)
    texts = ["same text for all of these many rows and more"] * 150 + family(rng, 200, 150, 2)
    rows = list(enumerate(texts + [" ".join(f"s{rng.randrange(99)}" for _ in range(60)) for _ in range(150)]))
    assert found(spark, documents, rows) == brute(rows)


def test_two_similar_sets_share_enough_segments():
    rng = np.random.default_rng(1)
    for n in (9, 10, 14, 15, 60, 500):
        base = rng.integers(1, 1 << 63, n, dtype=np.uint64)
        sets = [np.unique(base), np.unique(base[: n - n // 10])]
        values, rows = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets)])
        band = np.full(2, np.searchsorted(BANDS, len(sets[1]), "right") - 1)
        keys = jaccard.segment_keys(values, rows, np.arange(2), band)
        exact = keys["unit"] < 3
        first, second = (set(keys["key"][exact & (keys["owner"] == i)].tolist()) for i in (0, 1))
        assert first & second


def test_empty_tables(spark, documents):
    assert found(spark, documents, []) == []
    assert found(spark, documents, [(1, None), (2, " ")]) == [(1, 0, 1), (2, 0, 2)]
