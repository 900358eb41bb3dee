"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text. The successive prefixes of a conversation are rendered and
consecutive outputs compared: what a turn adds is its span. A template whose longer output does not begin with
the shorter one rewrites history; its conversations are flagged, and their spans are found in the last output.
A turn's text is located inside its span by rendering two different stand-ins for it and comparing. A text that the
template leaves out has an empty place at the end of its turn's span (in a rewritten output: at the end); a template
that writes one text in several places raises, as no single span could be its loss.

Defined results: a null text or role is empty; a null conversation id is one conversation; turns are ordered by
(turn, role, text), nulls first, and repeated rows are repeated turns; an empty table gives no rows; only the
named columns are read. A conversation's rows reach one task as a sorted stream and are held one conversation
at a time; its digest is a chain over its turns, so it cannot be split.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
Render = Callable[[Turns], str]
LOSS_ROLES = ("assistant",)
_STAND_INS = "", ""
#: Turns before a turn that a local template renders with it.
NEAR = 8


@lru_cache
def escape_of(controls: tuple[str, ...]) -> Escape:
    return Escape(controls)


class Escape:
    """Keeps control strings out of texts, reversibly: each gets one more backslash after its first character."""

    def __init__(self, controls: tuple[str, ...]):
        forms = "|".join(f"(?<={re.escape(c[0])})(?=(\\\\*){re.escape(c[1:])})" for c in controls)
        self.firsts = {c[0] for c in controls}
        self._add, self._drop = re.compile(forms), re.compile("|".join(f"(?<={re.escape(c[0])})\\\\(?=(\\\\*){re.escape(c[1:])})" for c in controls))

    def __call__(self, text: str) -> str:
        return self._add.sub(r"\\", text) if any(c in text for c in self.firsts) else text

    def undo(self, text: str) -> str:
        return self._drop.sub("", text) if any(c in text for c in self.firsts) else text


@dataclass(frozen=True)
class Template:
    """Marks around every turn: opening, the role, middle, the text, closing."""

    opening: str
    middle: str
    closing: str
    controls: tuple[str, ...]
    #: Each turn is written alone, whatever stands before it.
    local: ClassVar[bool] = True

    def __call__(self, turns: Turns) -> str:
        escape = escape_of(self.controls)
        return "".join(f"{self.opening}{escape(role)}{self.middle}{escape(text)}{self.closing}" for role, text in turns)

    def parse(self, formatted: str) -> Turns:
        """The turns of an output."""
        escape, turns = escape_of(self.controls), []
        for part in formatted.split(self.opening)[1:]:
            role, _, text = part.removesuffix(self.closing).partition(self.middle)
            turns.append((escape.undo(role), escape.undo(text)))
        return turns


#: Control strings of the marked template, and of common bracketed templates, which texts must not imitate either.
MARKED = Template("<|turn|>", "<|text|>\n", "<|end|>\n", ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


@dataclass
class Rendered:
    text: str
    spans: list[tuple[int, int]]  # of every turn
    contents: list[tuple[int, int]]  # of every turn's text, escaped
    rewrites: bool


def render_turns(render: Render, turns: Turns) -> Rendered:
    """Spans by comparing successive outputs.

    Every prefix is rendered whole, which costs the square of the turns, unless the template says that it is local:
    such a one renders a turn after the NEAR turns before it, so long conversations cost in proportion to their
    turns; whole prefixes, at every power of two and at the end, must equal what was put together, else the template
    counts as one that rewrites history.
    """
    reach = NEAR if getattr(render, "local", False) else len(turns)
    spans, contents, parts, done, after = [], [], [], 0, render([])
    for i, (role, _) in enumerate(turns):
        near = turns[max(0, i - reach) : i]
        before = after if len(near) == i else render(near)
        after, a, b = render([*near, turns[i]]), *(render([*near, (role, s)]) for s in _STAND_INS)
        if not all(x.startswith(before) for x in (after, a, b)):
            return _rewritten(render, turns)
        low, high = _place(a, b, len(after))
        shift = done - len(before)
        parts.append(after[len(before) :])
        spans.append((done, shift + len(after)))
        contents.append((shift + low, shift + high))
        done = spans[-1][1]
        if i & (i + 1) == 0 or i == len(turns) - 1:
            parts = ["".join(parts)]
            if render(turns[: i + 1]) != parts[0]:
                return _rewritten(render, turns)
    return Rendered("".join(parts), spans, contents, False)


def _rewritten(render: Render, turns: Turns) -> Rendered:
    """Spans in the whole output, by stand-ins for each turn; a turn that the template dropped has an empty one."""
    whole, contents = render(turns), []
    for i, (role, _) in enumerate(turns):
        a, b = (render([*turns[:i], (role, s), *turns[i + 1 :]]) for s in _STAND_INS)
        contents.append(_place(a, b, len(whole)))
    return Rendered(whole, contents, contents, True)


def _place(a: str, b: str, length: int) -> tuple[int, int]:
    """Where a text stands in an output of this length, by outputs with two stand-ins for it; at the end if it is left out."""
    if a == b:
        return length, length
    low, high = 0, min(len(a), len(b))
    while low < high:  # by halves: slices compare faster than characters
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    if a[low + 1 :] != b[low + 1 :]:
        raise ValueError("the template writes the text of a turn in more than one place")
    return low, length - (len(a) - low - 1)


def conversations(table: DataFrame) -> DataFrame:
    """Rows so dealt and sorted that each conversation is one run of rows in one task."""
    rows = table.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chats(table: DataFrame, template: Template = MARKED, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """conv_id, formatted, turn_spans, loss_spans (code points, [start, end)), rewrites_history."""
    kind = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("turn_spans", _SPANS), ("loss_spans", _SPANS), ("rewrites_history", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for conv, turns in _grouped(batches):
            r = render_turns(template, turns)
            loss = [{"start": a, "end": b} for (role, _), (a, b) in zip(turns, r.contents, strict=True) if role in loss_roles]
            out.append((conv, r.text, [{"start": a, "end": b} for a, b in r.spans], loss, r.rewrites))
            if (size := size + len(r.text)) > 1 << 22:
                yield _batch(out, kind)
                out, size = [], 0
        if out:
            yield _batch(out, kind)

    spans = "array<struct<start:int,end:int>>"
    return conversations(table).mapInArrow(run, f"conv_id long, formatted string, turn_spans {spans}, loss_spans {spans}, rewrites_history boolean")


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Turns]]:
    now, turns = object(), []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if conv != now:
                if turns:
                    yield now, turns
                now, turns = conv, []
            turns.append((role, text))
    if turns:
        yield now, turns


def read_back(formatted: DataFrame, template: Template = MARKED) -> DataFrame:
    """Digests from outputs alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    escape = escape_of(template.controls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns = template.parse(text)
                learnt = "".join(escape.undo(text[s["start"] : s["end"]]) for s in loss)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            if out:
                yield _batch(out, kind)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
