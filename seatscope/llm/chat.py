"""Chat formatting: a state machine over roles and a declarative template.

The machine walks through the turns of a conversation and notes every turn that its state does not allow;
the template says how a turn of each role is written and which part carries the training loss. Every turn
becomes a few segments of text with a loss flag each; a conversation is the segments of its turns in order.
Control strings inside a text are broken by a backslash after their first character, and backslashes are
doubled, so the written form can be read back without doubt.

Turns are dealt by conversation and sorted within each task, and pass through as a stream: memory
does not grow with the length of a conversation.

Defined results: rows are taken in the order of turn, role, text, nulls first, repeated rows each being a
turn; a null text is empty; a null or unknown role is written in full with the template's general form,
never carries loss and counts as a violation; rows with a null id form one conversation; an empty table
gives none; other columns are not carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Form:
    """How a turn is written; ``loss`` marks its text."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``allowed[state]`` names the roles that may follow; the state is the last role, first ``""``."""

    forms: dict[str, Form]
    allowed: dict[str, frozenset[str]]
    final: frozenset[str]
    general: tuple[str, str, str] = ("[ROLE]", "[:]", "[/ROLE]")  # around role and text

    @cached_property
    def controls(self) -> list[str]:
        marks = {mark.strip() for form in self.forms.values() for mark in (form.before, form.after)}
        return sorted(marks | set(self.general), key=lambda mark: (-len(mark), mark))

    @cached_property
    def _control(self) -> re.Pattern:
        return re.compile(f"(?=(?:{'|'.join(map(re.escape, self.controls))}))(.)", re.DOTALL)

    def escape(self, text: str) -> str:
        return self._control.sub(r"\1\\", text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def segments(self, role: str | None, text: str | None) -> list[tuple[str, bool]]:
        written = self.escape(text or "")
        form = self.forms.get(role or "")
        if form is None:
            before, between, after = self.general
            return [(f"{before}{self.escape(role or '')}{between}", False), (written, False), (after, False)]
        return [(form.before, False), (written, form.loss), (form.after, False)]

    def read(self, written: str) -> tuple[str, str]:
        """Role and text of one written turn."""
        for role, form in self.forms.items():
            if written.startswith(form.before) and written.endswith(form.after):
                return role, self.unescape(written[len(form.before) : len(written) - len(form.after)])
        before, between, after = self.general
        role, _, text = written[len(before) : len(written) - len(after)].partition(between)
        return self.unescape(role), self.unescape(text)


INSTRUCTION_TEMPLATE = Template(
    forms={
        "system": Form("[SYS]", "[/SYS]"),
        "user": Form("[INST] ", " [/INST]"),
        "assistant": Form("<s>", "</s>", loss=True),
    },
    allowed={
        "": frozenset({"system", "user"}),
        "system": frozenset({"user"}),
        "user": frozenset({"assistant"}),
        "assistant": frozenset({"user"}),
    },
    final=frozenset({"assistant"}),
)

_SEGMENT = pa.struct([("text", pa.string()), ("loss", pa.bool_())])
_FORMATTED = "conv_id long, place long, valid boolean, state string, segments array<struct<text: string, loss: boolean>>"


def format_turns(conversations: DataFrame, template: Template = INSTRUCTION_TEMPLATE) -> DataFrame:
    """One row per turn, in order within each conversation: its ``segments``, whether the machine
    allows it (``valid``) and the ``state`` after it. Conversations do not cross tasks."""
    turns = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place, state = object(), 0, ""
        for batch in batches:
            ids = batch.column("conv_id").to_pylist()
            places, valid, states, segments = [], [], [], []
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            for conversation, role, text in zip(ids, roles, texts):
                if conversation != current:
                    current, place, state = conversation, 0, ""
                valid.append(role in template.allowed.get(state, ()))
                state = role or ""
                places.append(place)
                states.append(state)
                segments.append([{"text": t, "loss": loss} for t, loss in template.segments(role, text)])
                place += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(valid, pa.bool_()),
                    pa.array(states, pa.string()), pa.array(segments, pa.list_(_SEGMENT)),
                ],
                names=["conv_id", "place", "valid", "state", "segments"],
            )

    return ordered.mapInArrow(formatted, _FORMATTED)


@dataclass
class _Digest:
    """What is read back from the written turns of one conversation."""

    conversation: int | None
    turns: int = 0
    all_hash: object = field(default_factory=sha256)
    loss_hash: object = field(default_factory=sha256)
    loss_chars: int = 0
    chars: int = 0
    violations: int = 0
    complete: bool = False

    def add(self, segments: list[dict], valid: bool, template: Template) -> None:
        written = "".join(segment["text"] for segment in segments)
        role, text = template.read(written)
        under_loss = template.unescape("".join(segment["text"] for segment in segments if segment["loss"]))
        self.turns += 1
        self.all_hash.update(f"{role}\n{text}\n".encode())
        self.loss_hash.update(under_loss.encode())
        self.loss_chars += len(under_loss)
        self.chars += len(written)
        self.violations += not valid
        self.complete = role in template.final

    def row(self) -> tuple:
        return (
            self.conversation, self.turns, self.all_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(),
            self.chars, self.violations, self.complete and not self.violations,
        )


_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("violations", pa.int64()), ("accepted", pa.bool_()),
])


def read_back(formatted: DataFrame, template: Template = INSTRUCTION_TEMPLATE) -> DataFrame:
    """One row per conversation, from the rows of ``format_turns`` as they come."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Digest | None = None
        for batch in batches:
            done = []
            columns = (batch.column(name).to_pylist() for name in ("conv_id", "place", "valid", "segments"))
            for conversation, place, valid, segments in zip(*columns):
                if place == 0:
                    done += [current] if current else []
                    current = _Digest(conversation)
                current.add(segments, valid, template)
            yield _digest_batch(done)
        if current:
            yield _digest_batch([current])

    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string"
    return formatted.mapInArrow(digests, f"{kinds}, formatted_chars long, violations long, accepted boolean")


def _digest_batch(done: list[_Digest]) -> pa.RecordBatch:
    columns = list(zip(*(digest.row() for digest in done))) or [()] * len(_DIGEST)
    arrays = [pa.array(values, kind.type) for values, kind in zip(columns, _DIGEST)]
    return pa.RecordBatch.from_arrays(arrays, schema=_DIGEST)
