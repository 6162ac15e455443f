from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from seatscope.llm import components as component_module
from seatscope.llm import golay
from seatscope.llm.components import component_roots
from seatscope.llm.simhash import close_pairs, fuzzy_keys, keep_one_of_each, near_duplicates, text_fingerprints


def brute_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    shingles = shingles or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_golay_indices_meet_within_two_errors():
    masks, held = golay.tables()
    assert np.bincount(held).tolist() == [0, 277, 0, 0, 0, 0, 1771]
    leaders = masks[:, 0]

    def sets(words):
        rows, found = golay.indices(words)
        result = [set() for _ in words]
        for row, index in zip(rows.tolist(), found.tolist()):
            result[row].add(index)
        return result

    own = sets(leaders)
    for bits in (c for n in (1, 2) for c in combinations(range(23), n)):
        other = sets(leaders ^ sum(1 << b for b in bits))
        assert all(a & b for a, b in zip(own, other))


def test_fingerprints_within_two_bits_share_a_key():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    for bits in [(), (0,), (63,), (20, 21), (41, 42), (0, 1), (22, 50), (5, 62)]:
        near = [f ^ sum(1 << b for b in bits) for f in base]
        both = np.array([*base, *near], np.uint64).view(np.int64)
        rows, keys = fuzzy_keys(both)
        held = [set() for _ in both]
        for row, key in zip(rows.tolist(), keys.tolist()):
            held[row].add(key)
        assert all(held[i] & held[i + len(base)] for i in range(len(base)))


def test_fingerprints_equal_brute_force(edge_rows):
    texts = [t for _, t in edge_rows] + ["A b C d E", "a\x0bb\tc  d", "é É É é", "a b", "x " * 70_000]
    found = text_fingerprints(pa.array(texts, pa.string()))
    assert [int(f) & (2**64 - 1) for f in found] == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("small_bucket", [1, 3, 1000])
def test_close_pairs_connect_as_brute_force(spark, small_bucket):
    rng = random.Random(small_bucket)
    prints = {rng.getrandbits(64) for _ in range(30)}
    for seed in list(prints)[:6]:
        for _ in range(12):  # chains and crowds
            seed ^= 1 << rng.randrange(64)
            prints.add(seed ^ (1 << rng.randrange(64)))
            prints.add(seed)
    signed = sorted(int(np.uint64(f).view(np.int64)) for f in prints)
    pairs = close_pairs(spark, spark.createDataFrame([(f,) for f in signed], "f long"), small_bucket)
    found = [tuple(row) for row in pairs.collect()]
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert found and all(apart(a, b) <= 2 for a, b in found)
    wanted = [(a, b) for a, b in combinations(signed, 2) if apart(a, b) <= 2]
    assert components(found, signed) == components(wanted, signed)


def test_component_roots(spark):
    chain = [(i, i + 1) for i in range(40)]
    links = [*chain, (100, 90), (90, 95), (95, 100), (7, 7), (3, 2), (200, 201)]
    got = {r["node"]: r["root"] for r in component_roots(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for link in links for n in link}
    assert got == {n: r for n, r in components(links, nodes).items() if n != r}
    none = spark.createDataFrame([], "a long, b long")
    assert component_roots(spark, none).count() == 0


def test_component_roots_of_random_links(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    links += [(1000 + a, 1000 + b) for a, b in combinations(range(25), 2)]
    nodes = {n for link in links for n in link}
    got = {r["node"]: r["root"] for r in component_roots(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in components(links, nodes).items() if n != r}


def test_component_roots_of_stars_need_no_round(spark, monkeypatch):
    stars = spark.createDataFrame([(5, 1), (1, 7), (9, 2)], "a long, b long")
    tried = []
    star = component_module._large_star
    monkeypatch.setattr(component_module, "_large_star", lambda edges: (tried.append(1), star(edges))[1])
    roots = component_roots(spark, stars)
    assert sorted(map(tuple, roots.collect())) == [(5, 1), (7, 1), (9, 2)] and not tried
    more = roots.unionAll(spark.createDataFrame([(7, 9), (30, 31)], "a long, b long"))
    assert sorted(map(tuple, component_roots(spark, more).collect())) == [(2, 1), (5, 1), (7, 1), (9, 1), (31, 30)]
    assert tried


def test_near_duplicates_on_edge_rows(spark, documents, edge_rows):
    rows = [*edge_rows, (None, None), (9, "no id here")]
    found = near_duplicates(spark, documents(rows)).collect()
    assert len(found) == len(rows)
    by_text = {(r["doc_id"], r["component_id"]) for r in found}
    assert {(1, 1), (2, 1), (3, 1), (None, 1), (6, 6), (9, 9), (None, 9)} <= by_text
    assert near_duplicates(spark, documents([])).count() == 0


def test_one_of_each_stays(spark, documents):
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(400))
    rows = [(5, text), (3, text), (3, text), (8, text + " end"), (4, None), (6, ""), (7, "alone"), (3, "other text"), (None, "void")]
    clashing = [("f long", 1), ("root string", "r"), ("id int", 2)]
    clashing += [(f"{name} int", 3) for name in ("_id", "_f", "id_of", "f_of", "n", "component_id", "least")]
    docs = documents(rows, *clashing)
    kept = keep_one_of_each(spark, docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"], r["f"], r["root"], r["id"]) for r in kept.collect()), key=str)
    want = [(3, text), (4, None), (7, "alone"), (3, "other text"), (None, "void")]
    assert got == sorted(((i, t, 1, "r", 2) for i, t in want), key=str)
    assert keep_one_of_each(spark, documents([])).count() == 0
