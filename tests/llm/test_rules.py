from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seatscope.llm.rules import RuleParams, apply_rules, binomial_tail, counted_errors, cutoffs, measure


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, hit = Counter(windows), set()
    for at, window in enumerate(windows):
        if times[window] > 1:
            hit |= set(range(at, at + 5))
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


MORE = ["a b c d e a b c d e", "a b c d e a b c d e f a b c d e", "x x x x x x", "x x x x x", "a\nb\n a\na\n\n\na ", "## \x0b<|>\r\n&\n&", "q\n" * 3000]


def test_counts_equal_brute_force(spark, documents, edge_rows):
    rows = [*edge_rows, *((100 + i, t) for i, t in enumerate(MORE))]
    found = measure(documents(rows, ("n_words int", 3)).select("doc_id", "text"))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)


@pytest.mark.parametrize("errors,size,rate", [(0, 10, 0.1), (3, 500, 0.02), (0, 0, 0.3), (40, 3000, 0.02), (5, 5, 0.5)])
def test_binomial_tail_is_exact(spark, errors, size, rate):
    tail = spark.range(1).select(binomial_tail(F.lit(errors).cast("long"), F.lit(size).cast("long"), rate)).first()[0]
    exact = sum(math.comb(size, k) * rate**k * (1 - rate) ** (size - k) for k in range(errors + 1))
    assert tail == pytest.approx(exact, rel=1e-9)


def plain(words, symbols):
    return " ".join(f"w{i}" + "#" * (i < symbols) for i in range(words))


def test_cutoffs_hold_the_risk_in_every_stratum(spark, labels):
    rows, marks = [], []
    for i in range(1600):  # good documents have no symbol, bad ones half of their words
        bad = i % 4 == 0
        rows.append((i, plain(30, 15 if bad else 0), "many" if i < 1500 else None))
        marks.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    params = RuleParams(risk=0.03)
    measured = measure(docs.withColumnRenamed("lang", "stratum"), "stratum")
    chosen = {r["stratum"]: r for r in cutoffs(counted_errors(measured, labels(marks), params), params).collect()}
    assert chosen["many"]["symbols_cutoff"] == 0.15  # the mildest that rejects all bad ones
    assert chosen["many"]["repeats_cutoff"] is None  # of no use
    assert chosen[None]["symbols_cutoff"] is None  # too few labels to prove anything
    kept = {r["doc_id"]: r["kept"] for r in apply_rules(spark, docs, labels(marks), params=params).collect()}
    assert all(kept[i] == (i >= 1500 or i % 4 != 0) for i in kept)


def test_no_cutoff_where_good_documents_would_go(spark, labels):
    rows = [(i, plain(30, 15 if i % 20 == 0 else 0), "en") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = apply_rules(spark, docs, labels([(i, 1, 0) for i in range(2000)]))
    assert found.filter("kept").count() == 2000


def test_edge_tables(spark, documents, labels, edge_rows):
    docs = documents(edge_rows, ("kept int", 1), ("N_Words string", "x"))
    known = labels([(1, 1, 0), (1, None, 0), (None, 1, 0), (6, 1, 1), (6, 0, 1)])
    found = apply_rules(spark, docs, known)
    assert found.count() == len(edge_rows)
    assert {r["doc_id"] for r in found.filter("kept").collect()} == set()
    assert apply_rules(spark, docs, labels([])).count() == len(edge_rows)
    assert apply_rules(spark, documents([]), known).count() == 0
    null_ids = documents([(None, plain(20, 0)), (None, plain(20, 0))])
    assert [r["kept"] for r in apply_rules(spark, null_ids, known).collect()] == [True, True]
