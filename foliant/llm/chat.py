"""Chat formatting by a finite-state machine over roles.

A declarative template says how a turn of each role is written, which of its
parts carry loss, and which role may follow which.  Every turn becomes text
segments with a loss flag: opening marks, the escaped text, closing marks.

Escaping is reversible: a backslash is put behind the first letter of every
control string that a text contains, and every run of backslashes that already
stands there grows by one, so no control string survives inside a text.

Turns are put in order within blocks of turn numbers, so a conversation of any
length is many tasks' work.  The machine's state before a turn is the role of
the turn before it; only the last role of each block crosses over to the next.
Turns that tie in number are ordered by role and text.  Null text is empty, a
null role is the role "unknown".  An invalid turn (role that may not follow) is
formatted and flagged.  Null turn numbers come first; rows without a
conversation id form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Turn numbers of one block.
BLOCK = 1024
START = "<start>"


@lru_cache(maxsize=8)
def _guarded(controls: tuple[str, ...]) -> re.Pattern:
    """Starts of control strings, with the backslashes that guard them."""
    return re.compile("|".join(f"{re.escape(c[0])}\\\\*(?={re.escape(c[1:])})" for c in controls))


def one_line(role: str) -> str:
    """The role without line ends, reversibly; ordinary roles stay as they are."""
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def two_lines(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


@dataclass(frozen=True)
class Template:
    """Marks around turns, roles under loss, and the transitions between roles."""

    begin: str = "<|im_start|>{role}\n"
    end: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>")
    trained: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            START: frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user", "tool"}),
            "tool": frozenset({"assistant", "tool"}),
        }
    )

    def escape(self, text: str) -> str:
        return _guarded(self.controls).sub(lambda m: m[0] + "\\", text) if any(c[0] in text for c in self.controls) else text

    def unescape(self, text: str) -> str:
        if "\\" not in text:
            return text
        return _guarded(self.controls).sub(lambda m: m[0][:-1] if m[0].endswith("\\") else m[0], text)

    def valid(self, before: str, role: str) -> bool:
        return role in self.follows.get(before, frozenset())

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Text and loss flag of a turn's parts."""
        return [(self.begin.format(role=one_line(self.escape(role))), False), (self.escape(text), role in self.trained), (self.end, False)]


def formatted(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per turn, in columns conv_id, turn, seq, role, valid, segments.

    ``seq`` orders the turns of a conversation together with ``turn``.
    """
    own = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))).alias("block"),
    )
    last = own.groupBy("conv_id", "block").agg(
        F.max_by("role", F.struct(F.coalesce("turn", F.lit(-(1 << 62))), "role", "text")).alias("last")
    )
    across = Window.partitionBy("conv_id").orderBy("block")
    entry = last.select("conv_id", "block", F.coalesce(F.lag("last").over(across), F.lit(START)).alias("entry"))
    joined = own.join(
        entry.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "entry"),
        F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")),
    ).drop("_c", "_b")
    within = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    placed = joined.withColumn("before", F.coalesce(F.lag("role").over(within), "entry")).withColumn(
        "seq", F.row_number().over(within).cast("long")
    )
    schema = "conv_id long, turn long, seq long, role string, valid boolean, segments array<struct<text: string, loss: boolean>>"
    kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts, before = (batch.column(c).to_pylist() for c in ("role", "text", "before"))
            parts = [[{"text": t, "loss": flag} for t, flag in template.segments(r, x)] for r, x in zip(roles, texts, strict=True)]
            valid = [template.valid(b, r) for b, r in zip(before, roles, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), batch.column("seq"), batch.column("role"), pa.array(valid, pa.bool_()), pa.array(parts, kind)],
                names=["conv_id", "turn", "seq", "role", "valid", "segments"],
            )

    return placed.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "seq", "role", "text", "before").mapInArrow(run, schema)


def parsed(text: str, template: Template = Template()) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    head, tail = template.begin.split("{role}")
    body = text[len(head) : len(text) - len(template.end)]
    role, _, body = body.partition(tail)
    return template.unescape(two_lines(role)), template.unescape(body)


class Digest:
    """What a conversation's output says, taken up turn by turn."""

    def __init__(self):
        self.turns, self.loss_chars, self.chars, self.invalid = 0, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segments: list[dict], valid: bool, template: Template) -> None:
        whole = "".join(s["text"] for s in segments)
        role, text = parsed(whole, template)
        self.turns += 1
        self.invalid += not valid
        self.chars += len(whole)
        self.all.update(f"{role}\n{text}\n".encode())
        for s in segments:
            if s["loss"]:
                trained = template.unescape(s["text"])
                self.loss_chars += len(trained)
                self.loss.update(trained.encode())

    def row(self) -> tuple:
        return (self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.invalid)


def digests(output: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, read from formatted rows: counts and running digests.

    A SHA-256 digest is sequential by nature: the rows of a conversation pass
    through one task as a sorted stream, of which one batch is held at a time.
    """
    ordered = output.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_invalid"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            rows = []
            for conv, valid, segments in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "valid", "segments")), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        rows.append((now, *state.row()))
                    now, state = conv, Digest()
                state.add(segments, valid, template)
            yield _rows(rows, names, kinds)
        if state is not None:
            yield _rows([(now, *state.row())], names, kinds)

    return ordered.select("conv_id", "valid", "segments").mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_invalid long",
    )


def _rows(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
