"""Event-sourced chat reconstruction and a reversible chat template.

Events (conv_id, seq, kind, message_id, role, text) are folded into final messages, rendered with
``<|im_start|>role\\ntext<|im_end|>\\n`` and read back from the rendered output.

* fold: the log is partitioned by conversation and message and sorted by sequence.  ``message`` opens a
  message with its text, ``delta`` adds to it (and opens one that isn't there), ``edit`` replaces the text,
  ``regenerate`` empties it so that the new version's deltas follow, ``delete`` drops it.  A second ``message``
  with the same id is a message of its own.  One message is in memory at a time, so a conversation with a
  third of all rows is folded by many tasks.
* render: JVM expressions.  Inside texts a backslash goes between ``<`` and ``|`` (after any that are there),
  so no control string is left and one backslash is taken off on reading.
* read back: a task streams the pieces of its conversations in order; one piece is in memory at a time.  A
  digest over a conversation is sequential, so its turns pass through one task, never gathered there.

Edge cases: a null text or role is empty; a null conv_id is a conversation; equal sequence numbers go by
role, then text; repeated rows are turns of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basetrack.llm.common import ship

BEGIN, END = "<|im_start|>", "<|im_end|>"
MESSAGES = "conv_id long, seq long, message_id long, role string, text string"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
BATCH_ROWS, BATCH_CHARS = 4096, 8 << 20


def fold(events: DataFrame) -> DataFrame:
    """Final messages of an event log: conv_id, seq (of the opening event), message_id, role, text."""
    ship(events.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        key: tuple | None = None
        message: list | None = None  # conv_id, seq, message_id, role, parts of the text

        def close() -> int:
            if message is None:
                return 0
            text = "".join(message[4])
            out.append((*message[:4], text))
            return len(text)

        for batch in batches:
            for conv, seq, kind, mid, role, text in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if (conv, mid) != key:
                    held += close()
                    key, message = (conv, mid), None
                if kind == "message" or message is None and kind in ("delta", "edit"):
                    held += close()
                    message = [conv, seq, mid, role, [text or ""]]
                elif message is not None and kind == "delta":
                    message[4].append(text or "")
                elif message is not None and kind in ("edit", "regenerate"):
                    message[4] = [text or ""]
                elif kind == "delete":
                    message = None
                if len(out) >= BATCH_ROWS or held >= BATCH_CHARS:
                    yield _batch(out, _MESSAGE_FIELDS)
                    out, held = [], 0
        close()
        yield _batch(out, _MESSAGE_FIELDS)

    columns = ["conv_id", "seq", "kind", "message_id", "role", "text"]
    parted = events.select(*columns).repartition("conv_id", "message_id").sortWithinPartitions("conv_id", "message_id", "seq", "role", "text")
    return parted.mapInArrow(run, MESSAGES)


_MESSAGE_FIELDS = [pa.field("conv_id", pa.int64()), pa.field("seq", pa.int64()), pa.field("message_id", pa.int64()), pa.field("role", pa.string()), pa.field("text", pa.string())]
_DIGEST_FIELDS = [pa.field("conv_id", pa.int64()), pa.field("n_turns", pa.int64()), pa.field("turns_sha256", pa.string()), pa.field("loss_chars", pa.int64()), pa.field("loss_sha256", pa.string()), pa.field("formatted_chars", pa.int64())]


def _batch(rows: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def _escaped(column):
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"<(\\*)\|", r"<$1\\|")


def _escaped_role(column):
    return _escaped(F.replace(F.replace(F.coalesce(column, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def render(messages: DataFrame) -> DataFrame:
    """A formatted piece for each message, with the loss mask as code point offsets in the piece (null: no loss)."""
    head = F.concat(F.lit(BEGIN), _escaped_role(F.col("role")), F.lit("\n"))
    body = _escaped(F.col("text"))
    masked = F.coalesce(F.col("role") == "assistant", F.lit(False))
    return messages.select("conv_id", "seq", "message_id", F.concat(head, body, F.lit(END + "\n")).alias("piece"), F.when(masked, F.length(head)).cast("long").alias("loss_start"), F.when(masked, F.length(head) + F.length(body)).cast("long").alias("loss_end"))


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def unescape_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def parse(piece: str) -> list[tuple[str, str]]:
    """The (role, text) turns of formatted text; anything outside the template is an error."""
    turns, at = [], 0
    while at < len(piece):
        if not piece.startswith(BEGIN, at):
            raise ValueError(f"no {BEGIN} at {at}")
        end = piece.find("<|", at + len(BEGIN))
        if end < 0 or not piece.startswith(END + "\n", end):
            raise ValueError(f"no {END} after {at}")
        role, newline, text = piece[at + len(BEGIN) : end].partition("\n")
        if not newline:
            raise ValueError(f"no role at {at}")
        turns.append((unescape_role(role), unescape(text)))
        at = end + len(END) + 1
    return turns


def read_back(pieces: DataFrame) -> DataFrame:
    """One row per conversation: what the rendered pieces and their masks hold, by streaming them in order."""
    ship(pieces.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, begun = None, False
        n = loss = chars = 0
        turns, masked = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            for c, piece, lo, hi in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "piece", "loss_start", "loss_end")), strict=True):
                if not begun or c != conv:
                    if begun:
                        out.append((conv, n, turns.hexdigest(), loss, masked.hexdigest(), chars))
                    conv, begun, n, loss, chars = c, True, 0, 0, 0
                    turns, masked = hashlib.sha256(), hashlib.sha256()
                for role, text in parse(piece):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                if lo is not None:
                    under = unescape(piece[lo:hi])
                    masked.update(under.encode())
                    loss += len(under)
                chars += len(piece)
            if len(out) >= BATCH_ROWS:
                yield _batch(out, _DIGEST_FIELDS)
                out = []
        if begun:
            out.append((conv, n, turns.hexdigest(), loss, masked.hexdigest(), chars))
        yield _batch(out, _DIGEST_FIELDS)

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message_id", "piece").mapInArrow(run, DIGEST)


def as_events(conversations: DataFrame) -> DataFrame:
    """A log of whole messages from rows by turn."""
    c = conversations
    return c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("seq"), F.lit("message").alias("kind"), c["turn"].cast("long").alias("message_id"), c["role"].alias("role"), c["text"].alias("text"))
