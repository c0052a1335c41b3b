"""Chat formatting from a declarative template, checked by a finite-state machine over roles.

A template names what stands before and after the text of each role, which roles
carry loss, and which role may follow which. A turn becomes three segments: the
opening, the text and the closing, of which only the text of a loss role is
under the mask. Control strings inside texts are escaped reversibly: backslashes
double, and a lone backslash goes behind the first character of each control
string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shuffle_partitions


@dataclass(frozen=True)
class Template:
    """``turns``: role -> (opening, closing). A role that has none uses ``other``, in which ``{role}`` is its escaped name."""

    turns: dict[str, tuple[str, str]]
    other: tuple[str, str]
    controls: tuple[str, ...]
    loss_roles: frozenset[str]
    follows: dict[str, frozenset[str]] = field(default_factory=dict)  # state -> roles that may come next; "" at the start
    ends: frozenset[str] = frozenset()

    def __post_init__(self):
        if any(len(c) < 2 or "\\" in c for c in self.controls):
            raise ValueError("a control string has two characters or more and no backslash")

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        # control strings may overlap: each place where one begins gets its backslash
        return re.sub(f"(?=(?:{'|'.join(map(re.escape, self.controls))}))(.)", r"\1\\", text, flags=re.DOTALL)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def around(self, role: str) -> tuple[str, str]:
        if role in self.turns:
            return self.turns[role]
        return self.other[0].replace("{role}", self.escape(role)), self.other[1]

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        opening, closing = self.around(role)
        return [(opening, False), (self.escape(text), role in self.loss_roles), (closing, False)]

    def parse(self, formatted: str) -> Iterator[tuple[str, str]]:
        """``(role, text)`` of each turn of a formatted conversation, or of a part that starts and ends between turns."""
        at = 0
        while at < len(formatted):
            for role, (opening, closing) in self.turns.items():
                if formatted.startswith(opening, at):
                    break
            else:
                head, tail = self.other[0].split("{role}")
                end = formatted.index(tail, at + len(head))
                role, closing, opening = self.unescape(formatted[at + len(head) : end]), self.other[1], formatted[at : end + len(tail)]
            begin = at + len(opening)
            end = formatted.index(closing, begin)
            yield role, self.unescape(formatted[begin:end])
            at = end + len(closing)


#: Turns in the instruction style; ``<|role|>`` for roles outside of it.
INSTRUCT = Template(
    turns={
        "system": ("<<SYS>>\n", "\n<</SYS>>\n"),
        "user": ("<s>[INST] ", " [/INST]"),
        "assistant": ("<|answer|>", "</s>"),
    },
    other=("<|role|{role}|>", "<|end|>"),
    controls=("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "<|answer|>", "<|role|", "|>", "<|end|>"),
    loss_roles=frozenset({"assistant"}),
    follows={"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})},
    ends=frozenset({"assistant"}),
)


def format_turns(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """``(conv_id, place, role, segments, in_order)``: a row a turn, sorted by conversation and place inside its partition.

    ``conversations`` has conv_id, turn, role and text; other columns aren't read.
    Turns are put in order by turn, role and text, so that ties have one result;
    null turns come first. A null text or role is the empty one, a null conv_id
    is a conversation of its own. ``segments`` is a list of ``(text, loss)``.
    ``in_order`` is false from the first turn on whose role may not follow; all
    turns are formatted all the same. Memory holds a batch, however long a
    conversation is. An empty table gives an empty result.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.repartition(shuffle_partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, place, fine, begun = None, "", 0, True, False
        for batch in batches:
            out: list[tuple] = []
            for i, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if not begun or i != conv:
                    conv, state, place, fine, begun = i, "", 0, True, True
                fine = fine and role in template.follows.get(state, ())
                parts = [{"text": t, "loss": loss} for t, loss in template.segments(role, text.as_py())]
                out.append((i, place, role, parts, fine))
                state, place = role, place + 1
            columns = zip(*out, strict=True) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), kind, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "place", "role", "segments", "in_order"])

    return rows.mapInArrow(run, "conv_id long, place long, role string, segments array<struct<text:string,loss:boolean>>, in_order boolean")


def read_back(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """A row a conversation, from the segments of ``format_turns`` alone, which must be in its order.

    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    in_order, complete)``: digests are taken as the turns stream by. Empty texts
    and roles count as turns; repeated turns count each; a null conv_id is a
    conversation of its own; no turns give an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun = None, False
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = n_loss = n_chars = 0
        fine, role = True, ""
        done: list[tuple] = []

        def close() -> None:
            if begun:
                done.append((conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars, fine, fine and role in template.ends))

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "in_order", "complete"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done.clear()
            return batch

        for batch in batches:
            for i, segments, order in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(4).to_pylist(), strict=True):
                if not begun or i != conv:
                    close()
                    conv, begun, fine = i, True, True
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    n = n_loss = n_chars = 0
                parts = segments.as_py()
                whole = "".join(p["text"] for p in parts)
                n_chars += len(whole)
                for role, text in template.parse(whole):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for p in parts:
                    if p["loss"]:
                        plain = template.unescape(p["text"])
                        n_loss += len(plain)
                        loss.update(plain.encode())
                fine = fine and order
            if len(done) > 10_000:
                yield flush()
        close()
        if done:
            yield flush()

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean, complete boolean")
