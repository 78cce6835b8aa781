"""Chat formatting: a finite-state machine over roles and a declarative template.

The rows of a conversation meet in one task, sorted by turn, and are streamed:
the machine keeps its state, the writer one turn, the reader two running
digests, so neither a long conversation nor a task with many of them needs
memory. The output is a table of text segments, each with its loss flag.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are marked, which are trained on, and which role may follow which.

    ``marks`` has the opening and closing control string of a role. Other roles
    are written between ``other[0]`` and ``other[1]`` and closed by ``other[2]``.
    ``follows`` maps a role to the roles that may come next, "" being the start.
    ``final`` are the roles a whole conversation may end with.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "tool": ("[TOOL]", "[/TOOL]")})
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/END]")
    loss: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant", "tool")})
    final: tuple[str, ...] = ("assistant",)
    escape: str = "\\"

    def controls(self) -> list[str]:
        return sorted({*self.other, *(m for pair in self.marks.values() for m in pair)}, key=lambda m: (-len(m), m))

    def escaper(self) -> re.Pattern:
        """Finds what gets an escape before it: the escape itself, and the first character of any control string."""
        return re.compile("|".join([re.escape(self.escape), *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls())]))

    def tokens(self) -> re.Pattern:
        return re.compile(f"{re.escape(self.escape)}(.)|({'|'.join(map(re.escape, self.controls()))})", re.DOTALL)


SEGMENTS = "conv_id long, turn_no long, part int, text string, loss boolean, valid boolean"
_NAMES = ["conv_id", "turn_no", "part", "text", "loss", "valid"]


def _segments(t: Template):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, put = t.escaper(), lambda m: t.escape + m[0]
        conv, state, n, valid, first = None, "", 0, True, True
        for batch in batches:
            out: list[tuple] = []
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if first or conv_id != conv:
                    conv, state, n, valid, first = conv_id, "", 0, True, False
                valid = valid and role in t.follows.get(state, ())
                if role in t.marks:
                    head, tail = t.marks[role]
                else:
                    head, tail = t.other[0] + find.sub(put, role) + t.other[1], t.other[2]
                parts = ((head, False), (find.sub(put, text), role in t.loss), (tail, False))
                out += ((conv_id, n, i, piece, loss, valid) for i, (piece, loss) in enumerate(parts))
                state, n = role, n + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 6, _TYPES, strict=True)], _NAMES)

    return rows


_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]


def format_segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """``conv_id, turn_no, part, text, loss, valid``: three segments a turn, in order within each task.

    Needs ``conv_id, turn, role, text``; others are not looked at. Rows go by
    turn, NULL first, then by role and text. NULL roles and texts are empty
    strings. ``turn_no`` counts from 0. ``valid`` says that all turns so far are
    in an order the template allows. Rows with a NULL conv_id are one
    conversation; repeated rows are turns of their own. An empty table gives
    no rows.
    """
    t = template or Template()
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn").alias("turn"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_segments(t), SEGMENTS)


def _read(t: Template):
    """Rebuild turns from formatted text; knows the template, but neither turns nor roles."""
    opens = {head: (role, tail) for role, (head, tail) in t.marks.items()}

    class Reader:
        def __init__(self, conv_id):
            self.conv_id, self.turns, self.loss, self.n, self.loss_chars, self.chars = conv_id, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            self.valid, self.last, self.role, self.end, self.named, self.text = True, "", None, None, False, []

        def take(self, piece: str, loss: bool, valid: bool) -> None:
            self.chars += len(piece)
            self.valid = valid
            at = 0
            for m in tokens.finditer(piece):
                self.literal(piece[at : m.start()], loss)
                at = m.end()
                if m[2] is None:
                    self.literal(m[1], loss)
                elif m[2] == self.end:
                    self.close()
                elif self.end is None and m[2] in opens:
                    self.role, self.end = opens[m[2]]
                    self.text = []
                elif self.end is None and m[2] == t.other[0]:
                    self.end, self.named, self.text = t.other[2], True, []
                elif self.named and m[2] == t.other[1]:
                    self.role, self.named, self.text = "".join(self.text), False, []
                else:
                    raise ValueError(f"control string {m[2]!r} out of place in conversation {self.conv_id}")
            self.literal(piece[at:], loss)

        def literal(self, piece: str, loss: bool) -> None:
            self.text.append(piece)
            if loss:
                self.loss.update(piece.encode())
                self.loss_chars += len(piece)

        def close(self) -> None:
            self.turns.update(f"{self.role}\n{''.join(self.text)}\n".encode())
            self.n, self.last, self.end, self.text = self.n + 1, self.role, None, []

        def row(self) -> tuple:
            return (self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid, self.valid and self.last in t.final)

    tokens = t.tokens()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            out = []
            for conv_id, piece, loss, valid in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if reader is None or conv_id != reader.conv_id:
                    if reader is not None:
                        out.append(reader.row())
                    reader = Reader(conv_id)
                reader.take(piece, loss, valid)
            yield _digests(out)
        if reader is not None:
            yield _digests([reader.row()])

    return rows


_READ = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "valid_order": pa.bool_(), "complete": pa.bool_()}


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(_READ)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _READ.values(), strict=True)], list(_READ))


def read_back(segments: DataFrame, template: Template | None = None, dealt: bool = False) -> DataFrame:
    """One row a conversation from its segments, stored ones in any order.

    ``dealt`` says that they come straight from ``format_segments``, in its
    order, and need not be dealt to tasks and sorted again.

    Turns are found again by parsing the text for control strings and undoing
    the escapes. ``loss_chars`` and ``loss_sha256`` are of the text under loss
    flags. ``valid_order`` is the machine's verdict on all turns; ``complete``
    says that the last turn may be a last one, too.
    """
    if not dealt:
        segments = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no", "part")
    own = segments.select("conv_id", "turn_no", "part", "text", "loss", "valid")
    return own.mapInArrow(_read(template or Template()), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid_order boolean, complete boolean")
