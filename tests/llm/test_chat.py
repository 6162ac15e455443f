from __future__ import annotations

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from seatscope.llm.chat import INSTRUCTION_TEMPLATE, format_turns, read_back

TURNS = "conv_id long, turn long, role string, text string, segments int, place string"
PIECES = st.lists(st.sampled_from([*INSTRUCTION_TEMPLATE.controls, "\\", "<", "s>", "[", "INST]", "a", "\n", " ", "é"]), max_size=8)


@given(PIECES.map("".join), st.sampled_from(["system", "user", "assistant", "tool", "", "[:]"]))
def test_texts_come_back_and_hold_no_control_string(text, role):
    template = INSTRUCTION_TEMPLATE
    written = template.escape(text)
    assert not any(control in written for control in template.controls)
    segments = template.segments(role, text)
    assert template.read("".join(t for t, _ in segments)) == (role, text)
    assert [template.unescape(t) for t, loss in segments if loss] == ([text] if role == "assistant" else [])


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_conversations_read_back(spark):
    rows = [
        (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", None), (1, 2, "user", "x\\"), (1, 3, "assistant", "é" * 9),
        (2, 0, "system", "s"), (2, 1, "assistant", "too early"), (2, 2, None, "who"), (2, 2, "tool", "t"),
        (None, 0, "user", "no id"), (3, None, "user", "first"), (3, 5, "assistant", "z"), (3, 5, "assistant", "z"),
        (4, 0, "user", "long " * 50_000),
    ]
    found = {r["conv_id"]: r for r in read_back(format_turns(frame(spark, rows))).collect()}
    assert set(found) == {1, 2, 3, 4, None}
    for conversation, row in found.items():
        own = sorted((r for r in rows if r[0] == conversation), key=lambda r: [(x is not None, x or 0) if i == 1 else (x or "") for i, x in enumerate(r) if i])
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        said = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in own)
        answers = "".join(text or "" for _, _, role, text in own if role == "assistant")
        assert (row["n_turns"], row["turns_sha256"]) == (len(own), digest(said))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(answers), digest(answers))
        template = INSTRUCTION_TEMPLATE
        assert row["formatted_chars"] == sum(len(t) for r in own for t, _ in template.segments(r[2], r[3]))
    assert [found[c]["violations"] for c in (1, 2, 3, 4, None)] == [0, 3, 1, 0, 0]
    assert [found[c]["accepted"] for c in (1, 2, 3, 4, None)] == [True, False, False, False, False]


def test_segments_and_states(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b")]
    turns = sorted(format_turns(frame(spark, rows)).collect(), key=lambda r: r["place"])
    assert [(r["valid"], r["state"]) for r in turns] == [(True, "user"), (True, "assistant"), (False, "assistant")]
    assert [(s["text"], s["loss"]) for s in turns[1]["segments"]] == [("<s>", False), ("a", True), ("</s>", False)]


@pytest.mark.parametrize("rows", [[], [(5, 0, "user", "")]])
def test_small_tables(spark, rows):
    assert read_back(format_turns(frame(spark, rows))).count() == len(rows)
