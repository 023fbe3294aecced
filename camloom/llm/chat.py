"""Chat formatting by event-sourced reconstruction.

A log holds, for each conversation, events in sequence: messages opened, deltas streamed into them, edits, deletions and
regenerations. The log is partitioned by conversation and sorted by sequence; one pass folds each conversation's events to
its final messages and renders them with a template. Only one conversation is held at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END_OF_ROLE = "<|turn|>", "<|end|>\n", "\n"
#: What a tokenizer or another template could take for control strings; each is escaped by a backslash before it.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
NEEDS = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
LINE_NEEDS = re.compile(NEEDS.pattern + "|\n")
ESCAPED = re.compile(r"\\(.)", re.S)
#: A turn's mark, where no backslash escapes it: escapes are read from left to right.
TOKEN = re.compile(r"\\.|" + re.escape(OPEN) + "|" + re.escape(CLOSE), re.S)


def escape(text: str) -> str:
    return NEEDS.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return LINE_NEEDS.sub(lambda m: "\\" + ("n" if m[0] == "\n" else m[0]), role)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def unescape_role(text: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


@dataclass
class Fold:
    """Messages in order of opening; events name a message by its number (``target``), none means the last opened.

    open: a new message with a role and the text so far. delta: text appended. edit: the text replaced. delete: the message
    goes. regenerate: the target and all messages after it go, and a new one with the target's role opens. Events about
    a message that is not there, and events of other kinds, change nothing.
    """

    messages: dict[int, tuple[str, list[str]]] = field(default_factory=dict)
    opened: int = 0

    def apply(self, kind: str | None, role: str | None, text: str | None, target: int | None) -> None:
        if kind == "open":
            self.messages[self.opened] = (role or "", [text or ""])
            self.opened += 1
            return
        at = target if target is not None else self.opened - 1
        if at not in self.messages:
            return
        if kind == "delta":
            self.messages[at][1].append(text or "")
        elif kind == "edit":
            self.messages[at] = (self.messages[at][0], [text or ""])
        elif kind == "delete":
            del self.messages[at]
        elif kind == "regenerate":
            again = self.messages[at][0]
            self.messages = {k: m for k, m in self.messages.items() if k < at}
            self.messages[self.opened] = (again, [text or ""])
            self.opened += 1

    def turns(self) -> list[tuple[str, str]]:
        return [(role, "".join(parts)) for _, (role, parts) in sorted(self.messages.items())]


def render(turns: Iterable[tuple[str, str]], learned: frozenset[str] = frozenset({"assistant"})) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans (in code points) of the texts that carry loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape_role(role) + END_OF_ROLE, escape(text)
        if role in learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: the inverse of render."""
    turns, start = [], 0
    for m in TOKEN.finditer(formatted):
        if m[0] == OPEN:
            start = m.end()
        elif m[0] == CLOSE:
            role, _, text = formatted[start : m.start()].partition(END_OF_ROLE)
            turns.append((unescape_role(role), unescape(text)))
    return turns


KINDS = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def formatted(events: DataFrame, learned: frozenset[str] = frozenset({"assistant"})) -> DataFrame:
    """(conv_id, seq, kind, role, text, target) -> conv_id, n_turns, formatted, loss_starts, loss_ends: one row a conversation.

    Events with equal or null seq are taken by kind (open before the rest), role and text, nulls first; repeated events are
    applied each time. Null texts and roles are empty, a null conv_id is a conversation. A conversation whose messages are
    all deleted gives an empty string. An empty log gives an empty result; other columns are not read. A conversation
    becomes one string, so it has to fit one task, however many rows it has; the rest of the log does not.
    """
    wanted = events.select("conv_id", "seq", "kind", "role", "text", F.col("target").cast("long").alias("target"))
    first = (F.col("kind") != "open").alias("q_late")
    placed = wanted.repartition("conv_id").sortWithinPartitions("conv_id", "seq", first, "kind", "role", "text", "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, now, kind = None, None, None
        out: list[tuple] = []

        def close() -> None:
            text, spans = render(fold.turns(), learned)
            out.append((now, len(fold.messages), text, [a for a, _ in spans], [e for _, e in spans]))

        def batch() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            kinds = [kind, pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "formatted", "loss_starts", "loss_ends"])
            out.clear()
            return made

        for b in batches:
            kind = b.schema.field(0).type
            for conv, _, what, role, text, target in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if fold is None or conv != now:
                    if fold is not None:
                        close()
                    fold, now = Fold(), conv
                fold.apply(what, role, text, target)
            if out:
                yield batch()
        if fold is not None:
            close()
            yield batch()

    kind = events.schema["conv_id"].dataType.simpleString()
    return placed.mapInArrow(run, f"conv_id {kind}, n_turns long, formatted string, loss_starts array<bigint>, loss_ends array<bigint>")


def events_of(turns: DataFrame) -> DataFrame:
    """A log from finished turns (conv_id, turn, role, text): each opens a message and streams its text into it.

    Turns with equal or null numbers are ordered by role and text, nulls first; each of repeated turns is a message of its own. A
    turn's text and role ride on its opening event's order, with a number of its row, so that a delta follows its own opening.
    """
    part = lambda kind, role, text: F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    order = F.struct(F.col("turn"), F.col("role").alias("role"), F.col("text").alias("text"), F.col("q_row").alias("row"))
    single = turns.withColumn("q_row", F.monotonically_increasing_id())
    both = single.select("conv_id", order.alias("order"), F.explode(F.array(part("open", F.col("role"), none), part("delta", none, F.col("text")))).alias("e"))
    return both.select("conv_id", F.struct("order", (F.col("e.kind") != "open").alias("late")).alias("seq"), "e.kind", "e.role", "e.text", F.lit(None).cast("long").alias("target"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: all read from the formatted strings and masks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, starts, ends in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                turns = parse(text)
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                loss = "".join(unescape(text[a:e]) for a, e in zip(starts, ends, strict=True))
                rows.append((len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    wanted = chats.select("conv_id", "formatted", "loss_starts", "loss_ends")
    kind = chats.schema["conv_id"].dataType.simpleString()
    return wanted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat_formatting(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return read_back(formatted(events_of(turns.unionByName(probe))))
