from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from seatscope.llm.packing import SumOfSquares, WordEncoder, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD_TEXTS = [
    "", "it's  the\tEND, isn't 'sup ''re...", "naïve café—été… ÀÉ×÷x·y", "Iİ ŉ ſ Σας ΑΣ", "é ́ a b c",
    "<|endoftext|>X<|EndOfText|> a<|startoftext|>", "日本語 テスト 123 ١٢٣ x²½", "\U0001f600\U0001f600 !!??", "a\rb\x0bc\x00d", "^ a^b ^^",
    "क़ ﬁ Å", "foo's'll BAR'D",
]


def plain_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def test_ids_equal_those_of_the_tokenizer(edge_rows):
    texts = [*ODD_TEXTS, *(t for _, t in edge_rows), " ".join(ODD_TEXTS), "\n".join(ODD_TEXTS[:5] + ODD_TEXTS[6:])]
    encode = WordEncoder(PATH)
    for _ in range(2):  # new words, then known ones
        assert [ids.tolist() for ids in encode(pa.array(texts, pa.string()))] == [plain_ids(t) for t in texts]


def test_words_that_collide_under_polynomial_hashes_keep_their_ids():
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba"))]
    assert [ids.tolist() for ids in WordEncoder(PATH)(pa.array(texts))] == [plain_ids(t) for t in texts]


@pytest.mark.parametrize("window,max_open", [(16, 1000), (16, 3), (64, 8)])
def test_every_token_lies_in_one_window(window, max_open):
    rng = random.Random(window + max_open)
    packer, windows, docs = SumOfSquares(window, max_open), [], {}
    for doc in range(300):
        docs[doc] = np.arange(rng.choice([0, 1, 5, window // 2 + 1, window, 3 * window + 2, rng.randrange(40)]), dtype=np.uint32)
        windows += packer.add(doc, docs[doc])
        assert packer.n_open <= max_open + 1
    windows += packer.finish()
    found = defaultdict(list)
    for pieces in windows:
        size = sum(len(p.ids) for p in pieces)
        assert size == window or size.bit_count() == 1
        for p in pieces:
            assert len(p.ids)
            found[p.doc].append((p.start, p.ids))
    for doc, ids in docs.items():
        joined = [p for _, p in sorted(found[doc], key=lambda x: x[0])]
        assert (np.concatenate(joined) if joined else ids[:0]).tolist() == ids.tolist()


def test_best_level_gives_the_smallest_sum_of_squares():
    rng = np.random.default_rng(0)
    packer = SumOfSquares(12)
    for _ in range(200):
        packer.levels[1:12] = rng.integers(0, 4, 11)
        size = int(rng.integers(1, 12))

        def after(level):
            levels = packer.levels.copy()
            levels[level] -= level > 0
            if level + size < 12:
                levels[level + size] += 1
            return int((levels**2).sum())

        options = [0, *(h for h in range(1, 13 - size) if packer.levels[h])]
        assert after(packer.best_level(size)) == min(map(after, options))


def test_pieces_tell_their_place(spark, documents, edge_rows):
    rows = [*edge_rows, (20, "many words " * 3000)]
    docs = documents(rows, ("start int", 1), ("ids string", "x")).repartition(3)
    pieces = pack_documents(docs, PATH, with_ids=True).collect()
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.array(p["ids"], "<u4")
        assert p["length"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids.tobytes())
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"]].append((p["start"], p["doc_tokens"], ids.tolist()))
    for spans in sequences.values():
        place = 0
        for offset, length in sorted(spans):
            assert offset == place
            place += length
        assert place == 4096 or place.bit_count() == 1
    for doc, text in rows:
        ids = plain_ids(text)
        parts = sorted(by_doc[doc])
        copies = sum(d == doc for d, _ in rows)
        assert {tokens for _, tokens, _ in parts} == {len(ids)}
        if copies == 1:
            assert sum((part for _, _, part in parts), []) == ids
        assert sum(len(part) for _, _, part in parts) == copies * len(ids)
    assert pack_documents(documents([]), PATH).count() == 0
