"""Chat formatting from an event log.

A log holds events (conv_id, seq, message, kind, role, text) of five kinds: `message` and
`edit` set a message's text, `regenerate` empties it, `delta` appends to it, `delete` removes
the message. Events are folded per message in the order of seq; messages stand in the order
of their first event. The template is

    <|turn|>role<|text|>text<|end|>

and every "<|" inside a role or text, also one that already has been escaped, gets a
backslash after its "<": reversible, and no text can forge a mark. The output has one row per
turn, so a conversation of any length is never one value; the rows of a conversation, joined
in order, are its formatted text, and loss_start/loss_end are code points in it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import query, read

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
KINDS = ("message", "edit", "regenerate", "delta", "delete")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def log_of_turns(conversations: DataFrame) -> DataFrame:
    """The event log of a table of finished turns: a `message` event per row. Rows that share
    a turn are taken in the order of role and text and stay separate messages."""
    rank = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    taken = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return taken.select("conv_id", F.struct(F.col("turn").alias("a"), rank.cast("long").alias("b")).alias("seq"), "role", "text").select(
        "conv_id", "seq", F.col("seq").alias("message"), F.lit("message").alias("kind"), "role", "text")


def fold_messages(events: DataFrame) -> DataFrame:
    """conv_id, first (sequence number), role, text: the messages that are left at the end.

    A message's events are gathered under (conversation, message), so a long conversation is
    spread over tasks; the events of one message meet, as its text is one value. Events of
    the same seq are folded in the order message, edit, regenerate, delta, delete, then role
    and text. An unknown kind or a null text changes nothing but the message's first seq.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0))
    event = F.struct(F.col("seq"), rank.alias("rank"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    per = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("log"))
    # what stands before the last event that sets, empties or deletes has no effect
    last = F.expr("aggregate(transform(log, (e, i) -> IF(e.rank IN (1, 2, 3, 5), i, -1)), -1, (a, x) -> greatest(a, x))")
    per = per.withColumn("last", last)
    text = F.expr("array_join(transform(filter(log, (e, i) -> i >= last AND e.rank IN (1, 2, 4)), e -> e.text), '')")
    role = F.coalesce(F.try_element_at(F.expr("filter(transform(log, e -> e.role), r -> r <> '')"), F.lit(-1)), F.lit(""))
    alive = F.expr("last < 0 OR get(log, last).rank <> 5 OR size(filter(log, (e, i) -> i > last AND e.rank = 4)) > 0")
    return per.where(alive).select("conv_id", F.expr("log[0].seq").alias("first"), role.alias("role"), text.alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, first, formatted, loss_from, loss_to: one row per turn; the loss span (code
    points within the row) covers the texts of one role, without the marks."""
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    body = escape(F.col("text"))
    trained = F.col("role") == loss_role
    start = F.length(head).cast("long")
    return messages.select(
        "conv_id", "first", F.concat(head, body, F.lit(END)).alias("formatted"),
        F.when(trained, start).alias("loss_from"), F.when(trained, start + F.length(body)).alias("loss_to"))


OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                 ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


class _Reader:
    """Reads a conversation back from its formatted text, piece by piece."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.turns, self.turn_hash = conv_id, 0, hashlib.sha256()
        self.loss, self.loss_hash, self.chars, self.rest = 0, hashlib.sha256(), 0, ""

    def add(self, piece: str, a, b) -> None:
        self.chars += len(piece)
        if a is not None:
            under = unescape_text(piece[a:b])
            self.loss += len(under)
            self.loss_hash.update(under.encode())
        whole = self.rest + piece
        *done, self.rest = whole.split(END)
        for turn in done:
            role, _, text = turn.removeprefix(TURN).partition(TEXT)
            self.turns += 1
            self.turn_hash.update(f"{unescape_text(role)}\n{unescape_text(text)}\n".encode())

    def row(self):
        return self.conv_id, self.turns, self.turn_hash.hexdigest(), self.loss, self.loss_hash.hexdigest(), self.chars


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, out = None, []
    for batch in batches:
        for conv_id, piece, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.append(now.row())
                now = _Reader(conv_id)
            now.add(piece, a, b)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), OUT)], schema=OUT)
            out = []
    if now is not None:
        out.append(now.row())
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), OUT)], schema=OUT)


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of every conversation, read from the formatted text alone.

    The turns of a conversation are hashed one after the other, so they pass through one task
    in order; they stream through it, and no more than a batch is held at once. Formatting
    itself is spread over turns.
    """
    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "first").select("conv_id", "formatted", "loss_from", "loss_to")
    return ordered.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Formatted turns of a table (conv_id, turn, role, text). Null roles and texts are
    empty, null conversation ids one conversation; an empty table gives no rows."""
    return render(fold_messages(log_of_turns(conversations)))


@query("op9_chat_formatting")
def op9_chat_formatting(spark, sf_dir):
    """Every conversation and the planted one, formatted and read back."""
    table = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(table.unionByName(planted)))
