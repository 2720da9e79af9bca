"""Chat formatting: spans of turns found by rendering successive prefixes of a black box."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = tuple[str, str]
Render = Callable[[Sequence[Message]], str]

_OPEN = {"system": "<<SYS>> ", "user": "[INST] ", "assistant": " "}
_CLOSE = {"system": " <</SYS>>\n", "user": " [/INST]", "assistant": " </s>\n"}
_MARK = re.compile(r"\\.|<<SYS>> | <</SYS>>\n|\[INST\] | \[/INST\]| </s>\n|<<ROLE (?:\\.|[^\\>])*>> | <</ROLE>>\n", re.S)


def escape(text: str) -> str:
    """No control string can begin in the result: each begins with ``[`` or ``<``, or a blank before one."""
    return text.replace("\\", "\\\\").replace("[", "\\[").replace("<", "\\<").replace(">", "\\>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def instruct_template(messages: Sequence[Message]) -> str:
    """Marks for system, user and assistant turns; any other role is named in its mark."""
    out = []
    for role, text in messages:
        opening = _OPEN.get(role, f"<<ROLE {escape(role)}>> ")
        out.append(f"{opening}{escape(text)}{_CLOSE.get(role, ' <</ROLE>>' + chr(10))}")
    return "".join(out)


def read_turn(span: str) -> Message:
    """Role and text of one turn, from its formatted span alone."""
    for role, opening in _OPEN.items():
        if span.startswith(opening) and span.endswith(_CLOSE[role]):
            if role != "assistant" or _MARK.match(span) is None:
                return role, unescape(span[len(opening) : len(span) - len(_CLOSE[role])])
    mark = _MARK.match(span)
    opening = mark[0]
    return unescape(opening[len("<<ROLE ") : -len(">> ")]), unescape(span[len(opening) : -len(" <</ROLE>>\n")])


@dataclass
class Located:
    """A rendered conversation: (start, end) of turns and of their texts, by character.

    ``rewrites`` is the first turn whose arrival changes what was rendered before, or None;
    turns up to it, and it, have no spans then.
    """

    text: str
    spans: list[tuple[int, int]]
    inner: list[tuple[int, int]]
    rewrites: int | None = None


def _common(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def _added(render: Render, before: Sequence[Message], known: str, message: Message) -> tuple[str | None, int, int]:
    """What a turn adds to the rendered prefix, and where its text begins and ends in that.

    Two probes with one-letter texts show the marks: what they share at both ends.
    """
    now = render([*before, message])
    if not now.startswith(known):
        return None, 0, 0
    a, b = (render([*before, (message[0], probe)])[len(known) :] for probe in "xy")
    lead = _common(a, b)
    tail = len(a) - lead - 1
    span = now[len(known) :]
    return span, lead, len(span) - tail


def locate(render: Render, messages: Sequence[Message], window: int | None = None) -> Located:
    """Render a conversation and find every turn by comparing successive prefixes.

    ``render`` is a black box. A prefix's output that the next one doesn't begin with means
    that the template rewrites history; this is reported with the turn. Every prefix is rendered,
    whatever the length, because a template may rewrite at any turn: the work grows with the square
    of a conversation's length. What the template makes of no turns stands before the first span.

    Who knows that a template looks back one turn at most may give a ``window``: conversations
    beyond it are located in stretches of that length after the first turn, in linear time. The
    stretches' spans must then add up to the output for the whole conversation, else all
    prefixes are rendered; a template that rewrites only by length is not noticed.
    """
    whole = render(messages)

    def stretch(context: list[Message], turns: Sequence[Message]) -> list[tuple[str, int, int]] | int:
        found, known = [], render(context)
        for i, message in enumerate(turns):
            span, start, end = _added(render, context, known, message)
            if span is None:
                return i
            found.append((span, start, end))
            context, known = [*context, message], known + span
        return found

    pieces: list[tuple[str, int, int]] | int = []
    preamble = render([])
    if window and len(messages) > window:
        for start in range(0, len(messages), window):
            some = stretch([] if not start else [messages[0], messages[start - 1]], messages[start : start + window])
            if isinstance(some, int):
                pieces = -1
                break
            pieces += some
        if pieces == -1 or preamble + "".join(p[0] for p in pieces) != whole:
            pieces = stretch([], messages)
    else:
        pieces = stretch([], messages)
    if isinstance(pieces, int):
        return Located(whole, [], [], pieces)
    spans, inner, at = [], [], len(preamble)
    for span, start, end in pieces:
        spans.append((at, at + len(span)))
        inner.append((at + start, at + end))
        at += len(span)
    return Located(whole, spans, inner)


_TURN = pa.struct([(n, pa.int32()) for n in ("start", "end", "text_start", "text_end")] + [("loss", pa.bool_())])


def formatted(
    conversations: DataFrame,
    render: Render = instruct_template,
    id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_roles: Sequence[str] = ("assistant",),
    window: int | None = None,
) -> DataFrame:
    """Rows (id, formatted, turns, rewrites_at), one per conversation.

    ``turns`` lists every turn's span in ``formatted``, its text's span within that and
    whether the loss counts there; ``rewrites_at`` is the turn (from 0) at which the template
    changed earlier output, with no spans then, else null. ``window`` as for ``locate``.

    Turns are taken in the order of ``turn``; ties go by role and text, repeated rows stay.
    Null texts and roles are empty; a null turn comes first; rows with a null id are one
    conversation. Other columns are ignored; an empty table gives no rows. A conversation is
    one row however long it is, as it becomes one text (2 GB at most); nothing else is gathered.
    A column of the input called like a result column does no harm.
    """
    kind = conversations.schema[id].dataType.simpleString()
    said = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    gathered = conversations.groupBy(F.col(id).alias("id")).agg(F.sort_array(F.collect_list(said)).alias("said"))

    def render_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                texts, turns, rewrites = [], [], []
                for said_ in batch.column(1):
                    messages = [(m["role"], m["text"]) for m in said_.as_py()]
                    found = locate(render, messages, window)
                    texts.append(found.text)
                    rewrites.append(found.rewrites)
                    turns.append(
                        [
                            {"start": s, "end": e, "text_start": a, "text_end": b, "loss": m[0] in loss_roles}
                            for m, (s, e), (a, b) in zip(messages, found.spans, found.inner)
                        ]
                    )
                columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(turns, pa.list_(_TURN)), pa.array(rewrites, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [id, "formatted", "turns", "rewrites_at"])

    turn_type = "array<struct<start:int,end:int,text_start:int,text_end:int,loss:boolean>>"
    schema = f"`{id}` {kind}, formatted string, turns {turn_type}, rewrites_at int"
    return gathered.mapInArrow(render_batches, schema)
