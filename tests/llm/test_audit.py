from __future__ import annotations

import random
import re
from itertools import permutations

import numpy as np
import pytest

from seatscope.llm.audit import FILTERS, audit_filters, positional_popcounts, survival_words


def brute(docs, labels):
    """The audit by its definition, one document and order at a time."""
    rows = []
    for i, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": smaller,
        }
        good, toxic = (any(j is not None and j == i and pair[which] == 1 for j, *pair in labels) for which in (0, 1))
        rows.append((lang or "", {f for f in fails if fails[f]}, good, toxic))
    result = set()
    for part in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        found, shapley = [], dict.fromkeys(FILTERS, 0)
        for order in permutations(FILTERS):
            left = own
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[0]]
                left = [d for d in left if name not in d[0]]
                failing = sum(name in d[0] for d in own)
                shapley[name] += len(gone)
                found.append((name, (
                    part, "".join(order), step, len(left), len(gone), failing - len(gone),
                    sum(d[0] == {name} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone),
                )))
        result |= {(*row, shapley[name]) for name, row in found}
    return result


@pytest.mark.parametrize("size", [0, 1, 2, 3, 7, 31, 100, 4097])
def test_positional_popcounts(size):
    words = np.random.default_rng(size).integers(0, 1 << 32, size, dtype=np.uint64).astype(np.uint32)
    assert positional_popcounts(words).tolist() == [int((words >> bit & 1).sum()) for bit in range(32)]


def test_survival_words_are_truth_tables():
    for failed, word in enumerate(survival_words().tolist()):
        assert [word >> s & 1 for s in range(32)] == [int(not failed & s) for s in range(32)]


def test_audit_equals_brute_force(spark, edge_rows):
    rng = random.Random(2)
    texts = []
    for _ in range(60):
        words = [rng.choice(["a", "b", "Zz", "ÄÖ", "x#", "n%d"]).replace("%d", str(rng.randrange(500))) for _ in range(rng.choice([3, 199, 200, 300]))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    docs = [(i, t, "en") for i, t in edge_rows]
    docs += [(rng.randrange(80), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(150)]
    docs += [(None, texts[0], "fr"), (None, texts[0], "fr")]
    labels = [(rng.randrange(80), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)] + [(None, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "p") for d in docs], "doc_id long, text string, lang string, failed int, part string")
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = [tuple(r) for r in audit_filters(spark, frame, given).collect()]
    assert len(found) == len(set(found)) == 120 * 5 * len({d[2] or "" for d in docs})
    assert set(found) == brute(docs, labels)


def test_large_groups_of_copies_and_empty_tables(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "if(id % 3 = 0, 'copy', 'text ' || id) AS text", "'en' AS lang")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = audit_filters(spark, docs, none).filter("filter_order = 'EABCD' AND step = 1").collect()
    assert [(r["kept"], r["removed"], r["unique_fails"]) for r in rows] == [(267, 133, 0)]
    assert audit_filters(spark, docs.limit(0), none).count() == 0
