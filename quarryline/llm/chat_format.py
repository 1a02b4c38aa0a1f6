"""Conversations as marked text with a mask of the model's own words, and the way back.

Turns are dealt by conversation and block of turns, so a conversation of any length spreads over tasks; a heading row per block, from
counts by key alone, says where it starts. Tasks read their rows in order and hold one turn and one piece of text at a time. A formatted
conversation is rows of pieces of whole turns, about a megabyte each, never one unbounded text. What is read back comes from these pieces.

Control strings inside texts are escaped: after its first character each gets a backslash, and one that has backslashes there gets one
more, so unescaping takes one away and every text comes back.

Odd rows: a null text or role is empty, turns are in the order of turn (null first), then role, then text, repeated rows are turns of
their own, rows without a conv_id make one conversation, an empty table gives no rows. Rows that share one turn number lie in one block.
Further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chat_template import Compiled, compile_template

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[ROLE]", "[/ROLE]")
TEMPLATE = (
    "{% for message in messages %}{% if loop.first %}{{ bos }}{% endif -%}"
    "{% if message.role == 'user' %}[INST] {{ message.text | escape }} [/INST]"
    "{%- elif message.role == 'system' %}[SYS] {{ message.text | escape }} [/SYS]"
    "{%- elif message.role == 'assistant' %}[OUT]{% generation %}{{ message.text | escape }}{% endgeneration %}{{ eos }}"
    "{%- else %}[ROLE]{{ message.role | escape }}[/ROLE]{{ message.text | escape }}{{ eos }}{% endif %}{% endfor %}"
)
CONSTANTS = {"bos": "<s>", "eos": "</s>"}
#: Turns of a block, and characters after which a piece ends with its turn.
BLOCK, PIECE = 4096, 1 << 20

_INSIDE = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROLS))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROLS))
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))


def escape(text: str) -> str:
    """The text without any control string."""
    return _INSIDE.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted piece, by its control strings alone."""
    marks = [m for m in _CONTROL.finditer(text) if m[0] != "<s>"]
    role = None
    for here, there in pairwise(marks):
        inside = text[here.end() : there.start()]
        if here[0] in ("[INST]", "[SYS]"):
            yield ("user" if here[0] == "[INST]" else "system"), unescape(inside[1:-1])
        elif here[0] == "[OUT]":
            yield "assistant", unescape(inside)
        elif here[0] == "[ROLE]":
            role = unescape(inside)
        elif here[0] == "[/ROLE]":
            yield role, unescape(inside)


_PIECES = "conv_id {id}, block long, piece long, n_turns long, whole boolean, formatted string, starts array<long>, ends array<long>"
_READ = "conv_id {id}, block long, piece long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, formatted string, starts array<long>, ends array<long>"


def _arrow(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in types.items()], names=list(types))


_SPANS = pa.list_(pa.int64())
_PIECE_TYPES = {"block": pa.int64(), "piece": pa.int64(), "n_turns": pa.int64(), "whole": pa.bool_(), "formatted": pa.string(), "starts": _SPANS, "ends": _SPANS}


def _render(template: str, constants: dict):
    """Batches of headings and turns, in order, to batches of pieces."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: Compiled = compile_template(template, constants, escape)
        heading, at = None, 0
        texts, starts, ends, length, turns, piece = [], [], [], 0, 0, 0
        conv_type = None

        def flush() -> pa.RecordBatch:
            nonlocal texts, starts, ends, length, turns, piece
            row = {"conv_id": [heading["conv_id"]], "block": [heading["block"]], "piece": [piece], "n_turns": [turns], "whole": [heading["whole"]], "formatted": ["".join(texts)], "starts": [starts], "ends": [ends]}
            texts, starts, ends, length, turns, piece = [], [], [], 0, 0, piece + 1
            return _arrow(row, {"conv_id": conv_type, **_PIECE_TYPES})

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if row["heading"]:
                    if turns:
                        yield flush()
                    heading, at, piece = row, row["offset"], 0
                    continue
                for text, marked in compiled.parts({"role": row["role"], "text": row["text"]}, at, heading["size"]):
                    if marked:
                        if not (ends and ends[-1] == length):
                            starts.append(length)
                            ends.append(length)
                        ends[-1] = length + len(text)
                    texts.append(text)
                    length += len(text)
                at, turns = at + 1, turns + 1
                if length >= PIECE:
                    yield flush()
        if turns:
            yield flush()

    return run


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, constants: dict | None = None, block: int = BLOCK) -> DataFrame:
    """conv_id, block, piece, n_turns, whole, formatted, starts, ends: conversations as pieces of text with spans of the model's words.

    The pieces of a conversation in the order of (block, piece) are its text; ``starts`` and ``ends`` count code points from the piece's
    start; ``whole`` tells that the conversation has one block.
    """
    spark_type = dict(conversations.dtypes)["conv_id"]
    turns = conversations.select("conv_id", F.coalesce(F.floor(F.col("turn") / block), F.lit(-1)).cast("long").alias("block"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block")
    whole = Window.partitionBy("conv_id")
    headings = sizes.select("conv_id", "block", F.lit(True).alias("heading"), (F.sum("n").over(before) - F.col("n")).alias("offset"), F.sum("n").over(whole).alias("size"), (F.count(F.lit(1)).over(whole) == 1).alias("whole"))
    rows = turns.withColumn("heading", F.lit(False)).unionByName(headings, allowMissingColumns=True)
    dealt = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", F.desc("heading"), "turn", "role", "text")
    made = dealt.select("conv_id", "block", "heading", "offset", "size", "whole", "role", "text")
    return made.mapInArrow(_render(template, CONSTANTS if constants is None else constants), _PIECES.format(id=spark_type))


class _Digest:
    """Running digests of one conversation's turns and masked text."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, formatted: str, starts: list[int], ends: list[int]) -> None:
        for role, text in read_turns(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for start, end in zip(starts, ends):
            text = unescape(formatted[start:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.formatted_chars += len(formatted)

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "block": 0, "piece": 0, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.formatted_chars, "formatted": None, "starts": None, "ends": None}


_READ_TYPES = {"block": pa.int64(), "piece": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "formatted": pa.string(), "starts": _SPANS, "ends": _SPANS}


def _read_back(only_whole: bool):
    """Digests of conversations from their pieces in order; with ``only_whole``, pieces of those in several blocks pass through."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kind = None, pa.int64()
        for batch in batches:
            kind, out = batch.schema.field("conv_id").type, []
            for row in batch.to_pylist():
                ready = row.get("turns_sha256") is not None
                passing = ready or (only_whole and not row["whole"])
                if current is not None and (passing or row["conv_id"] != current.conv_id):
                    out.append(current.row())
                    current = None
                if passing:
                    out.append({c: row.get(c) for c in ("conv_id", *_READ_TYPES)})
                    continue
                current = current or _Digest(row["conv_id"])
                current.add(row["formatted"], row["starts"], row["ends"])
            if out:
                yield _arrow({c: [r[c] for r in out] for c in ("conv_id", *_READ_TYPES)}, {"conv_id": kind, **_READ_TYPES})
        if current is not None:
            out = [current.row()]
            yield _arrow({c: [r[c] for r in out] for c in ("conv_id", *_READ_TYPES)}, {"conv_id": kind, **_READ_TYPES})

    return run


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted pieces.

    A digest goes over its conversation in order. Conversations of one block are read where their pieces lie; only the pieces of longer ones
    are dealt again, and go through one task each as a stream, as sha256 demands.
    """
    schema = _READ.format(id=dict(pieces.dtypes)["conv_id"])
    near = pieces.mapInArrow(_read_back(True), schema)
    far = near.repartition("conv_id").sortWithinPartitions("conv_id", "block", "piece").mapInArrow(_read_back(False), schema)
    return far.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
