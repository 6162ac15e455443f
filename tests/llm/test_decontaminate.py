from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from seatscope.llm.decontaminate import drop_contaminated, find_contamination, suffix_array


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, width=13):
    windows = {}
    for item, text in items:
        words = words_of(text)
        size = min(width, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[at : at + size]), set()).add("" if item is None else str(item))
    rows = []
    for doc, text in docs:
        words = words_of(text)
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for at in range(len(words) - size + 1):
                names = windows.get(tuple(words[at : at + size]))
                if names:
                    found |= names
                    hit |= set(range(at, at + size))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        rows.append((doc, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(rows, key=str)


def random_corpus(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("a b c d Zé 7 the-x".split()) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 13, 20, 30]))) for i in range(6)]
    items += [(6, items[3][1]), (None, items[2][1]), (7, None), (8, ""), (10, items[0][1].upper())]
    docs = [(i, f"{text(rng.randrange(30))} {rng.choice(items)[1] or ''} {text(rng.randrange(400))}") for i in range(25)]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_hits_equal_brute_force(spark, documents, edge_rows, block_bytes):
    docs, items = random_corpus(block_bytes)
    docs += edge_rows + [(99, items[4][1]), (99, items[4][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = find_contamination(spark, documents(docs).select("doc_id", "text"), benchmark, block_bytes=block_bytes)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=str) == brute(docs, items)


def test_longest_match_and_its_place(spark, documents):
    passage = " ".join(f"w{i}" for i in range(40))
    doc = "x y " + " ".join(passage.split()[3:30]) + " z " + " ".join(passage.split()[20:])
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    row = find_contamination(spark, documents([(5, doc)]), benchmark).first()
    assert (row["longest_item"], row["longest_words"], row["longest_at"]) == ("1", 27, 2)


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 4, 300).astype(np.uint64)
    order = suffix_array(words, 13)
    suffixes = [tuple(words[i : i + 13]) for i in order]
    assert suffixes == sorted(suffixes) and sorted(order.tolist()) == list(range(300))
    assert suffix_array(words[:0], 13).tolist() == []


def test_empty_tables_and_clashing_columns(spark, documents):
    empty = spark.createDataFrame([], "item_id long, text string")
    docs = documents([(1, "a b"), (2, None)], ("found_contaminated boolean", True), ("found_N_hit int", 3))
    kept = drop_contaminated(spark, docs, empty)
    assert kept.columns == docs.columns and kept.count() == 2
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [r["doc_id"] for r in drop_contaminated(spark, docs, items).collect()] == [2]
    assert drop_contaminated(spark, documents([]), items).count() == 0
