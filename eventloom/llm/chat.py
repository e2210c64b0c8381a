"""Chat formatting from conversation event logs.

Events are (conv_id, turn, seq, kind, role, text).  They are partitioned by
conversation, sorted by turn and sequence and folded in one streaming pass that holds a
single message: ``message`` opens a message, ``delta`` appends to it, ``edit`` replaces
its text, ``regenerate`` clears it so that later deltas build it anew.  Each final
message is rendered at once, so a conversation of any length needs bounded memory.

Template: ``<|turn|>`` role, line end, text, ``<|end|>``, line end.  Inside roles and
texts a backslash is doubled, and a control string gets a backslash after its first
character; in roles a line end gets one before it.  Removing each backslash that stands
before another character restores the original.  The loss mask covers assistant texts.

Defined results: a null text or role is empty; a null kind is ``message``; rows with a
null conv_id are left out; a null turn or seq sorts first; rows alike in turn and seq
are taken in the order of role and text (null first) and repeated rows each count; a
delta, edit or regenerate without a message opens one; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow

TURN, END = "<|turn|>", "<|end|>"
#: Control strings (fixed values): those of the template and of common chat templates.
CONTROL = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """(formatted message, start and end of its text in it)."""
    head = TURN + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each message of a formatted conversation; memory is that of the text."""
    out, at = [], 0
    while at < len(formatted):
        line, end = at + len(TURN), -1
        while formatted.startswith(TURN, at) and (line := formatted.find("\n", line)) >= 0:
            before = line
            while formatted[before - 1] == "\\":
                before -= 1
            if (line - before) % 2 == 0:  # no line end of the role
                end = formatted.find(END + "\n", line + 1)  # escaped texts hold no control string
                break
            line += 1
        if end < 0:
            raise ValueError("not a formatted conversation")
        out.append((unescape(formatted[at + len(TURN) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return out


_PART_PA = pa.schema([("conv_id", pa.int64()), ("ord", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv = turn = None
    role, parts, order, rows = None, None, 0, []

    def close():
        nonlocal parts, order
        if parts is not None:
            piece, a, b = render(role, "".join(parts))
            rows.append((conv, order, piece, a if role == "assistant" else None, b if role == "assistant" else None))
            order, parts = order + 1, None

    def out():
        cols = [pa.array(list(x), t.type) for x, t in zip(zip(*rows, strict=True), _PART_PA, strict=True)]
        rows.clear()
        return pa.RecordBatch.from_arrays(cols, schema=_PART_PA)

    for batch in batches:
        for c, t, kind, r, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if c != conv or t != turn:
                close()
                if c != conv:
                    order = 0
                conv, turn = c, t
            if kind in (None, "message") or parts is None:
                close()
                role, parts = r or "", []
            if kind in ("edit", "regenerate"):
                parts.clear()
            parts.append(text or "" if kind != "regenerate" else "")
            if len(rows) >= 1000:
                yield out()
        if rows:
            yield out()
    close()
    if rows:
        yield out()


def format_events(events: DataFrame) -> DataFrame:
    """conv_id, ord, formatted, loss_start, loss_end: one row per final message, in order within each conversation.

    loss_start and loss_end bound the trained text in the message's formatted text; null outside assistant messages.
    """
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("seq").cast("long").alias("seq"), "kind", "role", "text").filter("conv_id is not null")
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "seq", "role", "text")
    return arrow(rows.select("conv_id", "turn", "kind", "role", "text"), _fold, "conv_id long, ord long, formatted string, loss_start long, loss_end long")


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as events: each is a whole message."""
    return conversations.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


_DIGEST_PA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read formatted messages back; those of a conversation stand together, in order."""
    conv, state, rows = None, None, []

    def close():
        if state is not None:
            rows.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def out():
        cols = [pa.array(list(x), t.type) for x, t in zip(zip(*rows, strict=True), _DIGEST_PA, strict=True)]
        rows.clear()
        return pa.RecordBatch.from_arrays(cols, schema=_DIGEST_PA)

    for batch in batches:
        for c, _, formatted, a, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if state is None or c != conv:
                close()
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            if a is not None:
                loss = unescape(formatted[a:b])
                state[2] += len(loss)
                state[3].update(loss.encode())
            state[4] += len(formatted)
        if rows:
            yield out()
    close()
    if rows:
        yield out()


def digests(events: DataFrame) -> DataFrame:
    return arrow(format_events(events), _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
