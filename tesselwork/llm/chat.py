"""Event-sourced chat: fold a log of conversation events into final messages, then render them for training.

A log row is (conv_id, seq, kind, turn, role, text). Kinds:

``open``        a message begins: role and the text so far
``delta``       text is streamed onto the end of the turn's message
``edit``        the turn's text is replaced; a given role replaces the role
``regenerate``  the turn is produced anew: its text so far and every later turn go
``delete``      the turn goes

The log is partitioned by conversation, sorted by sequence within partitions, and folded in one pass that holds
one conversation's live messages. The rendered form marks every turn and escapes control strings inside texts so
that they can be read back exactly; a mask of character ranges says what a loss covers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = "conv_id long, seq long, kind string, turn long, role string, text string"
MESSAGES = "conv_id long, turn long, role string, text string"

# The strings that open and close turns here or in other common templates.
BEGIN, BETWEEN, END = "<|turn|>", "<|text|>", "<|end|>\n"
CONTROL = re.compile(r"<\|[a-z_]+\|>|</?s>|\[/?INST\]|<</?SYS>>|\\")
_CODE = {"<": "\\l", "[": "\\b", "\\": "\\\\"}
_PLAIN = {v: k for k, v in _CODE.items()}


def escape(text: str) -> str:
    """Replace the first character of every control string, and every backslash, by a two-character code."""
    return CONTROL.sub(lambda m: _CODE[m[0][0]] + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\[lb\\]", lambda m: _PLAIN[m[0]], text)


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the character ranges of assistant texts in it."""
    out, mask, at = [], [], 0
    for role, text in messages:
        head, body = f"{BEGIN}{escape(role)}{BETWEEN}", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    turns = formatted.split(BEGIN)[1:]
    pairs = [t.removesuffix(END).split(BETWEEN, 1) for t in turns]
    return [(unescape(a), unescape(b)) for a, b in pairs]


def fold(events: list[tuple]) -> list[tuple[int, str, str]]:
    """Final (turn, role, text) of one conversation's (kind, turn, role, text) events in order."""
    live: dict = {}
    for kind, turn, role, text in events:
        if kind == "open":
            live[turn] = [role, [text]]
        elif kind == "delta" and turn in live:
            live[turn][1].append(text)
        elif kind == "edit" and turn in live:
            live[turn] = [role or live[turn][0], [text]]
        elif kind == "regenerate" and turn in live:
            live = {t: m for t, m in live.items() if t < turn} | {turn: [role or live[turn][0], [text]]}
        elif kind == "delete":
            live.pop(turn, None)
    return [(t, m[0], "".join(m[1])) for t, m in sorted(live.items())]


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, events) of rows sorted by conversation; a conversation may span batches."""
    events, now, some = [], None, False
    for b in batches:
        for conv, kind, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text")), strict=True):
            if some and conv != now:
                yield now, events
                events = []
            now, some = conv, True
            events.append((kind, turn, role or "", text or ""))
    if some:
        yield now, events


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows in batches that stay small in memory."""
    while some := list(islice(rows, most)):
        yield pa.RecordBatch.from_pylist(some, schema=schema)


def _sorted_log(log: DataFrame, partitions: int | None) -> DataFrame:
    by = [partitions, "conv_id"] if partitions else ["conv_id"]
    return log.select("conv_id", "seq", "kind", "turn", "role", "text").repartition(*by).sortWithinPartitions("conv_id", "seq", "turn", "kind", "role", "text")


def final_messages(log: DataFrame, partitions: int | None = None) -> DataFrame:
    """Return conv_id, turn, role, text of the messages that stand at the end of the log."""

    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        rows = ({"conv_id": conv, "turn": t, "role": r, "text": x} for conv, events in _by_conversation(batches) for t, r, x in fold(events))
        return _batches(rows, schema)

    return _sorted_log(log.where("turn IS NOT NULL"), partitions).mapInArrow(run, MESSAGES)


def formatted(log: DataFrame, partitions: int | None = None) -> DataFrame:
    """Return conv_id, formatted and mask (array of character ranges under the loss) of each conversation.

    The rows of a conversation are folded and rendered in one task, in order of seq; equal seq are ordered by turn,
    kind, role and text. Null roles and texts are empty; a null conv_id is a conversation of its own; events
    without a turn, or on a turn that is not open, change nothing. Repeated events apply as often as they stand.
    """

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("mask", pa.list_(span))])

    def one(conv, events):
        text, mask = render([(r, t) for _, r, t in fold(events)])
        return {"conv_id": conv, "formatted": text, "mask": [{"start": a, "end": b} for a, b in mask]}

    def run(batches):
        return _batches((one(conv, events) for conv, events in _by_conversation(batches)), schema)

    return _sorted_log(log.where("turn IS NOT NULL"), partitions).mapInArrow(run, "conv_id long, formatted string, mask array<struct<start: long, end: long>>")


def log_of_turns(turns: DataFrame, piece: int = 256) -> DataFrame:
    """A log that says what a table of (conv_id, turn, role, text) rows says, as a server would have written it.

    Each message opens empty and streams in deltas of ``piece`` characters; an assistant message is first opened
    with a draft (its first half) and regenerated. Rows are numbered by turn, then role and text, so repeated
    turns stay messages of their own.
    """
    from pyspark.sql import Window

    line = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.row_number().over(line).cast("long"))
    event = lambda kind, role, text: F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    opened = F.when(
        F.col("role") == "assistant",
        F.array(event("open", F.col("role"), F.expr("substring(text, 1, length(text) div 2)")), event("regenerate", none, F.lit(""))),
    ).otherwise(F.array(event("open", F.col("role"), F.lit(""))))
    count = F.ceil(F.length("text") / F.lit(piece)).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    deltas = F.transform(at, lambda i: event("delta", none, F.substring(F.col("text"), (i - 1) * piece + 1, F.lit(piece))))
    return rows.select("conv_id", "n", F.posexplode(F.concat(opened, deltas)).alias("k", "e")).select(
        "conv_id", (F.col("n") * (1 << 32) + F.col("k")).alias("seq"), "e.kind", F.col("n").alias("turn"), "e.role", "e.text"
    )


def digests(rendered: DataFrame) -> DataFrame:
    """What a formatted conversation holds, read back from it."""

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def one(conv, text, mask):
        turns = read_back(text)
        loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        return {"conv_id": conv, "n_turns": len(turns), "turns_sha256": sha(whole), "loss_chars": len(loss), "loss_sha256": sha(loss), "formatted_chars": len(text)}

    def run(batches):
        return _batches((one(*x) for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "mask")), strict=True)), schema)

    return rendered.select("conv_id", "formatted", "mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
