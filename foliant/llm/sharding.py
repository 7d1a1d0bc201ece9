"""Reproducible shuffle of rows into shards by a Feistel permutation of their global numbers.

Built-in functions only.  Rows are numbered 0 to n - 1 in the order of their
id.  A keyed permutation of these numbers gives each row its *place*; place p
lies in shard ``p % shards`` at slot ``p // shards``.  Shards therefore differ
by one row at most (the law ``rows``), slots have no gaps, and where a row
lies, or which row lies at a slot, is computed from numbers alone (`place_of`,
`row_at`), without the table.

The permutation works on the smallest rectangle a x b that holds n numbers.
A number is the pair (x // b, x % b); each round adds to one half a keyed
function of the other, modulo a or b in turn, which can be undone.  The few
values (less than a) that fall outside the n numbers walk on through the
permutation until they fall inside: cycle walking.  A walk visits no outside
value twice, so its length has the bound a * b - n.

Moving texts is not needed to know where rows go (`placed`); `written` moves
them into shard files.

Defined results: a null text has no bytes, hence size 8 and CRC 0; a null id
comes first.  Rows that repeat an id are ordered by CRC and size of their
text; rows equal in all of that have equal results up to their places.  Equal
texts are placed like any other rows: a group of copies may be a third of the
table, and then no shard could hold it.  An empty table has no rows in any
shard.  Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, fresh, numbered

LAW = "rows"
SHARDS = 24
KEY = b"public key of the registered query"
ROUNDS = 8
#: Two primes below 2**31: products of values below them stay within 64 bits.
PRIMES = (2**31 - 1, 2**31 - 19)
#: Lengths up to which walks are tried before the bound is used.
STRIDES = (8, 256)
#: Slots of a shard that one file holds.
FILE_SLOTS = 1 << 20


@dataclass(frozen=True)
class Permutation:
    """Keyed permutation of 0 .. n - 1, n up to about 4e18."""

    n: int
    key: bytes = KEY

    @property
    def sides(self) -> tuple[int, int]:
        a = max(isqrt(max(self.n, 1) - 1) + 1, 1)
        return a, max(-(-self.n // a), 1)

    @property
    def walks(self) -> int:
        """No walk is longer: as many values lie outside."""
        a, b = self.sides
        return a * b - self.n

    def constants(self) -> list[tuple[int, int, int]]:
        out = []
        for i in range(ROUNDS):
            raw = sha256(self.key + b"/%d" % i).digest()
            out.append(tuple(1 + int.from_bytes(raw[j : j + 8]) % (PRIMES[1] - 1) for j in (0, 8, 16)))
        return out

    def _added(self, half: Column, constants: Sequence) -> Column:
        """Keyed function of a half: two linear steps modulo different primes."""
        first, shift, second = constants
        return ((half % PRIMES[0]) * first + shift) % PRIMES[0] % PRIMES[1] * second % PRIMES[1]

    def _turned(self, df: DataFrame, value: str, out: str, back: bool) -> DataFrame:
        """``out``: the permutation of the whole rectangle, round by round, in generated code."""
        a, b = self.sides
        taken = set(df.columns)
        left, right = fresh(taken, "left"), fresh(taken, "right")
        df = df.withColumns({left: div(F.col(value), b), right: F.col(value) % b})
        rounds = list(enumerate(self.constants()))
        for i, constants in reversed(rounds) if back else rounds:
            side = b if i % 2 else a
            if back:
                df = df.withColumns({left: F.pmod(F.col(right) - self._added(F.col(left), constants), F.lit(side)), right: F.col(left)})
            else:
                df = df.withColumns({left: F.col(right), right: (F.col(left) + self._added(F.col(right), constants)) % side})
        # an even number of rounds brings the halves back to their sides
        return df.withColumn(out, F.col(left) * b + F.col(right)).drop(left, right)

    def _turn(self, value: Column, back: bool) -> Column:
        """The same for one value as an expression: for the few that walk."""
        a, b = self.sides
        rows = [(*c, b if i % 2 else a) for i, c in enumerate(self.constants())]
        table = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(row, "abcs", strict=True)]) for row in (rows[::-1] if back else rows)])

        def forth(s, c):
            return F.struct(s["r"].alias("l"), ((s["l"] + self._added(s["r"], (c["a"], c["b"], c["c"]))) % c["s"]).alias("r"))

        def undo(s, c):
            return F.struct(F.pmod(s["r"] - self._added(s["l"], (c["a"], c["b"], c["c"])), c["s"]).alias("l"), s["l"].alias("r"))

        start = F.struct(div(value, b).alias("l"), (value % b).alias("r"))
        return F.aggregate(table, start, undo if back else forth, lambda s: s["l"] * b + s["r"])

    def _walked(self, df: DataFrame, value: str, out: str, back: bool) -> DataFrame:
        df = self._turned(df, value, out, back)
        done = 0
        for upto in [s for s in STRIDES if s < self.walks] + [self.walks]:
            if upto > done:
                # next to no row reaches the longer strides, but they are there
                steps = F.sequence(F.lit(done + 1).cast("long"), F.lit(upto).cast("long"))
                onward = F.aggregate(steps, F.col(out), lambda x, _: F.when(x < self.n, x).otherwise(self._turn(x, back)))
                df = df.withColumn(out, F.when(F.col(out) < self.n, F.col(out)).otherwise(onward))
            done = upto
        return df

    def places(self, df: DataFrame, row: str, place: str) -> DataFrame:
        """``df`` with the place of each row number."""
        return self._walked(df, row, place, back=False)

    def rows(self, df: DataFrame, place: str, row: str) -> DataFrame:
        """``df`` with the row number at each place."""
        return self._walked(df, place, row, back=True)


def div(x: Column, y: int) -> Column:
    """Whole quotient."""
    return F.call_function("div", x, F.lit(y).cast("long"))


def place_of(df: DataFrame, row: str, n: int, shards: int = SHARDS, key: bytes = KEY) -> DataFrame:
    """``df`` with place, shard and slot of its row numbers, whatever table they number."""
    return Permutation(n, key).places(df, row, "place").withColumns(
        {"shard": (F.col("place") % shards).cast("int"), "slot": div(F.col("place"), shards)}
    )


def row_at(df: DataFrame, n: int, shards: int = SHARDS, key: bytes = KEY) -> DataFrame:
    """``df`` (shard, slot) with the ``row_number`` that lies there; slots beyond the end of a shard go."""
    found = df.withColumn("place", F.col("slot") * shards + F.col("shard")).filter((F.col("place") < n) & F.col("shard").between(0, shards - 1))
    return Permutation(n, key).rows(found, "place", "row_number")


def numbered_rows(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, carried: bool) -> DataFrame:
    """(doc_id, size, text_crc32, pos, total[, doc]): ``pos`` is the global row number."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("met"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carried else []),
    )
    return numbered(scratch.saved(rows, "rows"), [], ["doc_id", "text_crc32", "size", "met"], scratch)


def placed(docs: DataFrame, shards: int = SHARDS, key: bytes = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard (null), row_number, place."""
    scratch = Scratch(docs.sparkSession, "shards")
    rows = scratch.saved(numbered_rows(docs, scratch, id_col, text_col, carried=False).drop("total"), "numbered")
    return place_of(rows, "pos", rows.count(), shards, key).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("pos").alias("row_number"), "place",
    )


def written(docs: DataFrame, path: str, shards: int = SHARDS, key: bytes = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write whole rows into one folder per shard, in slot order, and read them back: slot, doc (the row), shard.

    A file holds up to ``FILE_SLOTS`` consecutive slots, so a shard of any
    size is written by many tasks.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    rows = numbered_rows(docs, scratch, id_col, text_col, carried=True)
    n = rows.agg(F.count(F.lit(1))).first()[0]
    dealt = place_of(rows, "pos", n, shards, key).select("shard", "slot", "doc").withColumn("run", div(F.col("slot"), FILE_SLOTS))
    dealt.repartition("shard", "run").sortWithinPartitions("shard", "slot").drop("run").write.partitionBy("shard").parquet(path)
    scratch.discard()
    schema = dealt.select("slot", "doc", "shard").schema
    return docs.sparkSession.read.schema(schema).parquet(path)
