"""Chat formatting with any template, by rendering successive prefixes.

A template is a function from turns (role, text) to a string and is treated as a black box.
Each conversation is rendered turn by turn; the part by which an output goes beyond the
one before is that turn's span. Where an output does not begin with the one before, the
template rewrites history: this is reported with the turn, and the span starts where the two
part. The text within a trained turn's span is found by rendering the same prefix with a
marker in place of its text, so header and trailer of the turn stay outside the loss mask.

The template here marks turns with `CONTROLS` and escapes them inside roles and texts: a
backslash is doubled, and one is put behind the first character of every control string.
`parse` reads conversations back from the output alone.

Turns are ordered by their number, ties by role and text; rows without conv_id are one
conversation each NULL id, NULL roles and texts are empty, turns without a number come
first. Roles may be any text. Other columns are ignored. Conversations are spread by
id and read in order, one at a time; only one conversation, whose output is one value in any
case, is ever held.

Rendering every prefix whole costs the square of the turns. Beyond `WINDOW` turns prefixes are
therefore first rendered in windows, each beginning where the last one ended, which is exact for
a template that only appends: if each output begins with the one before, and what the turns add
gives, put together, the whole renderings of the first one, two, four ... windows and of all turns,
the spans are taken. Otherwise all prefixes are rendered whole. A template that rewrites
history must show it within a window or in one of those whole renderings.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# Control strings of the template.
BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
CONTROLS = (BEGIN, END, OPEN, CLOSE)
TRAINED = ("assistant",)

_ESCAPED = re.compile(r"\\|" + "|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROLS))
_UNESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(CLOSE) + "(.*?)" + re.escape(END), re.DOTALL)
#: Turns whose prefixes are rendered together.
WINDOW = 64
#: Stands for a text while its place is looked for; private characters.
_MARKER = ""


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


def template(turns: list[Turn]) -> str:
    return BEGIN + "".join(f"{OPEN}{escape(role)}{CLOSE}{escape(text)}{END}" for role, text in turns)


def parse(formatted: str) -> list[Turn]:
    """The turns of an output of `template`."""
    if not formatted.startswith(BEGIN):
        raise ValueError("not an output of the template")
    turns, at = [], len(BEGIN)
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


class Rendered(NamedTuple):
    formatted: str
    spans: list[tuple[int, int]]  # of each turn
    mask: list[tuple[int, int]]  # of what is trained on
    rewritten: int | None  # first turn whose rendering changed what stood before


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def _located(turns: list[Turn], render_with: Template, trained: set[str]) -> Rendered:
    """Render all prefixes, each whole."""
    before = render_with([])
    spans, mask, rewritten = [], [], None
    for k, (role, text) in enumerate(turns):
        output = render_with(turns[: k + 1])
        start = _common(before, output)
        if start < len(before) and rewritten is None:
            rewritten = k
        spans.append((start, len(output)))
        if role in trained:
            probe = render_with([*turns[:k], (role, _MARKER)])
            at = probe.find(_MARKER, start)
            if at >= 0:
                rest = len(probe) - at - len(_MARKER)
                if at + rest <= len(output):
                    mask.append((at, len(output) - rest))
        before = output
    return Rendered(before, spans, mask, rewritten)


def _in_windows(turns: list[Turn], render_with: Template, trained: set[str]) -> Rendered | None:
    """The same from windows, or None where they do not prove it."""
    opening = render_with([])
    parts, spans, mask, length, checked = [opening], [], [], len(opening), WINDOW
    for at in range(0, len(turns), WINDOW):
        own = _located(turns[at : at + WINDOW], render_with, trained)
        if own.rewritten is not None or not own.formatted.startswith(opening):
            return None
        shift = length - len(opening)
        spans += [(a + shift, b + shift) for a, b in own.spans]
        mask += [(a + shift, b + shift) for a, b in own.mask]
        parts.append(own.formatted[len(opening) :])
        length += len(parts[-1])
        done = min(at + WINDOW, len(turns))
        if done == checked or done == len(turns):
            checked = 2 * done
            formatted = "".join(parts)
            if render_with(turns[:done]) != formatted:
                return None
    return Rendered(formatted, spans, mask, None)


def render(turns: list[Turn], render_with: Template = template, trained: Iterable[str] = TRAINED) -> Rendered:
    """Render prefixes and locate the turns. Positions count code points of the last
    output; with a template that rewrites history, spans before the change may not hold."""
    trained = set(trained)
    found = _in_windows(turns, render_with, trained) if len(turns) > WINDOW else None
    return found or _located(turns, render_with, trained)


FORMATTED = (
    "conv_id long, formatted string, turn_spans array<struct<start:long,end:long>>, "
    "loss_mask array<struct<start:long,end:long>>, rewritten_at long"
)


def _conversations(batches) -> Iterator[tuple[int | None, list[Turn]]]:
    """Conversations of rows that come sorted."""
    rows = (
        row
        for batch in batches
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")))
    )
    for conv_id, turns in itertools.groupby(rows, key=lambda r: r[0]):
        yield conv_id, [(role or "", text or "") for _, role, text in turns]


def _formatted(render_with: Template, trained: tuple[str, ...]):
    type_of = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for conv_id, turns in _conversations(batches):
            r = render(turns, render_with, trained)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([conv_id], pa.int64()),
                    pa.array([r.formatted]),
                    pa.array([[{"start": a, "end": b} for a, b in r.spans]], type_of),
                    pa.array([[{"start": a, "end": b} for a, b in r.mask]], type_of),
                    pa.array([r.rewritten], pa.int64()),
                ],
                ["conv_id", "formatted", "turn_spans", "loss_mask", "rewritten_at"],
            )

    return run


def format_conversations(
    turns: DataFrame, render_with: Template = template, trained: tuple[str, ...] = TRAINED
) -> DataFrame:
    """One row per conversation of `turns` (conv_id, turn, role, text): the output, the
    span of each turn, the loss mask, and the first turn that rewrote history, if any."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_formatted(render_with, trained), FORMATTED)
