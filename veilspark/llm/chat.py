"""Chat formatting that is proved by reading it back.

A turn is written as a start mark, its role, a line break, its text, an end mark and a line break. A deterministic
parser reads a rendered turn back; if what it reads is not the turn it came from, the conflicting content is escaped
and the turn read again, until it is identical: a backslash goes into each ``<|`` of the text (one more where there
are some already), which the parser takes out. Rendering works on single turns and needs no shuffle; a conversation
is its turns' pieces in order, so one of any length is written and read as a stream. With each piece goes its part of the
loss mask: where the text of an assistant's turn begins and ends in the piece, as written.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship

ship(__name__)

START, STOP = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
_CLASH, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE_CLASH, _ROLE_ESCAPED = re.compile(r"[\\\n]"), re.compile(r"\\([\\n])")


def escape(text: str) -> str:
    return _CLASH.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return _ROLE_CLASH.sub(lambda m: "\\\\" if m[0] == "\\" else "\\n", escape(role))


def unescape_role(role: str) -> str:
    return unescape(_ROLE_ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "\n", role))


def parse(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and where the text as written begins and ends, for each turn; ``ValueError`` for anything else."""
    at = 0
    while at < len(rendered):
        line = rendered.find("\n", at)
        stop = rendered.find(STOP, line)
        end = stop + len(STOP)
        if line < 0 or stop < 0 or not rendered.startswith(START, at) or rendered[end : end + 1] != "\n":
            raise ValueError(f"no turn at {at}")
        if rendered.find(START, at + 1, stop) >= 0:
            raise ValueError(f"a turn begins inside the one at {at}")
        yield unescape_role(rendered[at + len(START) : line]), unescape(rendered[line + 1 : stop]), line + 1, stop
        at = end + 1


def _reads_as(rendered: str, role: str, text: str) -> bool:
    try:
        return [t[:2] for t in parse(rendered)] == [(role, text)]
    except ValueError:
        return False


def render(role: str, text: str) -> str:
    """A turn as written: the first of its forms, plain or escaped, that reads back as itself."""
    for as_role, as_text in ((role, text), (role, escape(text)), (escape_role(role), escape(text))):
        rendered = f"{START}{as_role}\n{as_text}{STOP}\n"
        if _reads_as(rendered, role, text):
            return rendered
    raise ValueError("a turn can't be written")


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turn, piece, loss_start, loss_end)``: each turn as written, and the code points of it that are under the
    loss mask (null: none). Null roles and texts are empty; repeated rows are turns each; columns of other names are
    left behind; a very long text is one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [render(r or "", t or "") for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            masks = [next((t[2:] for t in parse(p) if t[0] == LEARNED), (None, None)) for p in pieces]
            starts, ends = (pa.array([m[i] for m in masks], pa.int64()) for i in range(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.string()), starts, ends], ["conv_id", "turn", "piece", "loss_start", "loss_end"])

    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, piece string, loss_start long, loss_end long")


class _Digest:
    """What is read back of one conversation, piece by piece."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int | None, end: int | None) -> None:
        self.chars += len(piece)
        for role, text, _, _ in parse(piece):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if start is not None:
            learned = unescape(piece[start:end])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_COLUMNS = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}


def read_back(pieces: DataFrame) -> DataFrame:
    """One row per conversation, from its pieces alone, in the order of turns (equal turns: by what is written).

    A task reads its conversations one after another, sorted by Spark, and holds one piece at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def out() -> pa.RecordBatch:
            rows = [pa.array(x, t) for x, t in zip(zip(*done, strict=True), _COLUMNS.values(), strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(rows, list(_COLUMNS))

        for batch in batches:
            for conv, piece, *mask in zip(*batch.columns, strict=True):
                if now is None or now.conv != conv.as_py():
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv.as_py())
                now.add(piece.as_py(), *(x.as_py() for x in mask))
            if len(done) >= 1000:
                yield out()
        if now is not None:
            done.append(now.row())
            yield out()

    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece").select("conv_id", "piece", "loss_start", "loss_end")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def round_trip(turns: DataFrame) -> DataFrame:
    """Write all conversations to the shared folder and report each from what was written.

    Rows with a null conversation are one conversation; null turns come first; repeated rows are turns each; extra
    columns are left behind; an empty table gives an empty table.
    """
    return read_back(materialize(format_turns(turns), "chat"))
