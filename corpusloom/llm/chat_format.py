"""Chat formatting with a template that is a black box, rendered turn by turn.

A template is any function from a list of messages (``role``, ``content``) to a
string. Each prefix of a conversation is rendered. Where an output starts with
the one before, the rest is the new turn's span; where it does not, the
template has rewritten history at that turn. For turns under the loss mask one
more rendering, with a probe as the last content, shows what stands before and
after the content, so the mask covers the content alone.

The template of this module marks turns, and escapes the marks inside texts
with backslashes, so its output can be read back exactly.

A conversation is formatted in one task, as it is one training example. Work
grows with its length times its turns, since a black box cannot be resumed.

Defined results: null texts and roles are empty; turns are in order of
``turn``, nulls last, ties by role and text; repeated rows are turns of their
own; rows with a null id are one conversation. Where history is rewritten,
``rewritten_at`` lists the turns at which it happened and ``turns`` is null,
since no span of the last output is sure; nothing is under the loss mask. Nor
is a turn whose content the template changes with what surrounds it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

Messages = list[dict[str, str]]
Template = Callable[[Messages], str]

OPEN, CLOSE = "###", "</turn>"
_CONTROL = re.compile(r"\\|#{3,}|</turn>")
_IN_ROLE = re.compile(r"[\\#:\n]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_ROLE = re.compile(r"### ((?:[^\\:]|\\.)*):\n", re.DOTALL)

# A content no template has a reason to treat in a way of its own.
PROBE = "QvuqprobeQvuq"


def escape(text: str) -> str:
    """No control string is left in the result: runs of # get a backslash each, ``</turn>`` one after its first character."""
    return _CONTROL.sub(lambda m: "<\\" + m[0][1:] if m[0] == CLOSE else "".join("\\" + c for c in m[0]), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked_turns(messages: Messages) -> str:
    """Each turn as ``### role:``, its escaped text, and ``</turn>``."""
    role = lambda m: _IN_ROLE.sub(r"\\\g<0>", m["role"])
    return "".join(f"{OPEN} {role(m)}:\n{escape(m['content'])}{CLOSE}\n" for m in messages)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of an output of ``marked_turns``; other strings are refused."""
    turns, at = [], 0
    while at < len(formatted):
        role = _ROLE.match(formatted, at)
        # No text holds the closing mark, so the next one ends the turn.
        stop = formatted.find(CLOSE + "\n", role.end()) if role else -1
        if stop < 0:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(role[1]), unescape(formatted[role.end() : stop])))
        at = stop + len(CLOSE) + 1
    return turns


def render(messages: Messages, template: Template, loss_roles: Iterable[str]) -> dict:
    """The text, a span per turn, the spans of contents under the loss mask, and where history was rewritten."""
    last, turns, loss, rewritten = template([]), [], [], []
    for i, message in enumerate(messages):
        so_far = messages[: i + 1]
        now = template(so_far)
        if not now.startswith(last):
            rewritten.append(i)
        turns.append({"role": message["role"], "start": len(last), "end": len(now)})
        if message["role"] in loss_roles and not rewritten:
            probed = template([*messages[:i], {**message, "content": PROBE}])
            before = probed.find(PROBE, len(last))
            if before >= 0 and probed.find(PROBE, before + 1) < 0 and now[:before] == probed[:before]:
                after = probed[before + len(PROBE) :]
                if now.endswith(after) and len(now) - len(after) >= before:
                    loss.append({"turn": i, "start": before, "end": len(now) - len(after)})
        last = now
    return {
        "text": last,
        "turns": None if rewritten else turns,
        "loss": [] if rewritten else loss,
        "rewritten_at": rewritten,
    }


_INT = pa.int32()
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("start", _INT), ("end", _INT)]))
_LOSS = pa.list_(pa.struct([("turn", _INT), ("start", _INT), ("end", _INT)]))
_RENDERED = [("text", pa.string()), ("turns", _TURNS), ("loss", _LOSS), ("rewritten_at", pa.list_(_INT))]
_RENDERED_SQL = (
    "text string, turns array<struct<role:string,start:int,end:int>>, "
    "loss array<struct<turn:int,start:int,end:int>>, rewritten_at array<int>"
)
# Conversations rendered before they are passed on.
AT_ONCE = 256


def format_conversations(
    conversations: DataFrame,
    template: Template = marked_turns,
    loss_roles: tuple[str, ...] = ("assistant",),
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Per conversation ``id_col, n_turns, text, turns, loss, rewritten_at``; spans count code points, ends excluded."""
    rows = conversations.select(
        F.col(id_col).alias("id"),
        F.struct(
            F.col(turn_col).isNull().alias("none"),
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("content"),
        ).alias("m"),
    )
    whole = rows.groupBy("id").agg(F.array_sort(F.collect_list("m")).alias("messages"))

    # As a map over rows, not a function in a projection: the optimizer would run that once for each field asked for.
    kept = whole.select("id", F.size("messages").cast("long").alias("n_turns"))
    schema = pa.schema([*to_arrow_schema(kept.schema), *[pa.field(*f) for f in _RENDERED]])

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(first, AT_ONCE)
                done = [render(messages, template, loss_roles) for messages in part.column("messages").to_pylist()]
                columns = [pa.array([d[name] for d in done], kind) for name, kind in _RENDERED]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_turns"), *columns], schema=schema)

    id_type = whole.schema["id"].dataType.simpleString()
    out = whole.select("id", F.size("messages").cast("long").alias("n_turns"), "messages").mapInArrow(
        rendered, f"id {id_type}, n_turns long, {_RENDERED_SQL}"
    )
    return out.withColumnRenamed("id", id_col)
