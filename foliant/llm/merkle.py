"""Merkle manifest of a table of documents, with proofs by octopus multiproofs.

**Tree.**  H is the lowercase hex SHA-256 of its inputs put together, digests
as hex text.  A leaf is H of the fields ``doc_id, source, lang, n_chars, text``
(each ``-`` if null, else byte count, colon, value).  Leaves of a language
ascend by doc_id; every two consecutive nodes become their H, a last single
one too, until one is left, the subroot.  Subroots ordered by language (null
first, then by bytes) are the leaves of one more tree, whose top is the root.
A node has the coordinate (tree, level, idx).

**Build.**  Texts are hashed where they are read; only digests move.  Leaves
are numbered within their tree by ranges, cut into blocks of ``2**RAISED``
consecutive ones, and each block raises its nodes to one; the tops of the
blocks are numbered the same way, so a tree of any size takes a few rounds.

**Proofs.**  A *leaf partition* is the set of wanted leaves of a block, all of
them or a few.  It computes the coordinates of the nodes it misses for all its
leaves together (at each level the siblings that are not themselves on a path,
`octopus`), fetches each once by a join with the stored nodes, derives the
interior nodes its leaves share, and reads every leaf's own proof out of them
(`expanded`).

Defined results: rows that repeat a doc_id are leaves of their own, ordered by
their digest; a null doc_id comes first and is never tampered with.  A table
without rows has no tree and gives no rows.  Columns beside the five fields
play no part, whatever their names.  A text of any length is hashed in the
task that reads it.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, numbered, small

#: Levels that a block raises at a time: a task holds 4,096 digests of a block.
RAISED = 12
#: Tree of the subroots; trees of languages are called ``-`` (null) or ``=`` and the language.
TOP = "^"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, level int, idx long, hash binary, n long, last boolean"


def digest(*hexes: str) -> str:
    return sha256("".join(hexes).encode()).hexdigest()


def height(n: int) -> int:
    """Level of the top of a tree with ``n`` leaves."""
    return max(int(n) - 1, 0).bit_length()


def width(n: int, level: int) -> int:
    """Nodes of a level."""
    return -(-int(n) >> level)


def raised(hexes: list[str]) -> list[str]:
    """The level above: every two nodes, and a last single one."""
    return [digest(*hexes[i : i + 2]) for i in range(0, len(hexes), 2)]


def _field(value: Column) -> Column:
    own = value.cast("string")
    return F.when(own.isNull(), "-").otherwise(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[_field(fields[name]) for name in FIELDS]).cast("binary"), 256))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, hash, altered, row): digests of the rows, and of the tampered ones after tampering."""
    fields = {name: F.col(name).cast("long") if name in ("doc_id", "n_chars") else F.col(name) for name in FIELDS}
    one_more = {**fields, "n_chars": fields["n_chars"].cast("decimal(20,0)") + 1}
    tampered = F.crc32(fields["doc_id"].cast("string").cast("binary")) % 7 == 0
    return docs.select(
        F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit("="), "lang")).alias("tree"),
        fields["doc_id"].alias("doc_id"),
        leaf_digest(fields).alias("hash"),
        F.when(tampered & F.col("n_chars").isNotNull(), leaf_digest(one_more)).alias("altered"),
        F.monotonically_increasing_id().alias("row"),
    )


@dataclass
class Manifest:
    """Stored tables of a tree of trees, and the folder they lie in."""

    #: tree, pos, n (leaves of the tree), doc_id, hash, altered
    leaves: DataFrame
    #: tree, level, idx, hash, n, last (the top of its tree): every node of every tree, that of the subroots included
    nodes: DataFrame
    #: tree, n, top (place among the subroots), trees (their number), subroot
    trees: DataFrame
    scratch: Scratch
    #: levels of a block
    raised: int


def _tops(base: int, raise_by: int):
    """Nodes that a block of one level makes: ``raise_by`` levels more, or up to the top of its tree."""

    def run(key, rows):
        tree, block = (k.as_py() for k in key)
        rows = rows.sort_by("pos")
        n = rows.column("n")[0].as_py()
        hexes = [h.hex() for h in rows.column("hash").to_pylist()]
        levels, idx, made = [], [], []
        for level in range(base, min(height(n), base + raise_by) + 1):
            if level > base:
                hexes = raised(hexes)
            if level > base or base == 0:
                first = block << (base + raise_by - level)
                levels += [level] * len(hexes)
                idx += range(first, first + len(hexes))
                made += [bytes.fromhex(h) for h in hexes]
        size = len(made)
        return pa.table(
            [pa.array([tree] * size, pa.string()), pa.array(levels, pa.int32()), pa.array(idx, pa.int64()), pa.array(made, pa.binary()), pa.array([n] * size, pa.int64()), pa.array([level == height(n) for level in levels], pa.bool_())],
            names=["tree", "level", "idx", "hash", "n", "last"],
        )

    return run


def grown(leaves: DataFrame, scratch: Scratch, raise_by: int = RAISED) -> DataFrame:
    """All nodes over stored leaves (tree, pos, n, hash)."""
    tallest = height(leaves.agg(F.max("n")).first()[0] or 0)
    rows, made = leaves.select("tree", "pos", "n", "hash"), []
    for base in range(0, max(tallest, 1), raise_by):
        groups = rows.withColumn("block", F.shiftright("pos", raise_by)).groupBy("tree", "block")
        made.append(scratch.saved(groups.applyInArrow(_tops(base, raise_by), NODE), "nodes"))
        above = made[-1].filter((F.col("level") == base + raise_by) & (F.col("n") > (1 << (base + raise_by))))
        rows = above.select("tree", F.col("idx").alias("pos"), "n", "hash")
    nodes = made[0]
    for more in made[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def manifest(docs: DataFrame, raise_by: int = RAISED) -> Manifest:
    """Build the tree of trees over a table of documents."""
    scratch = Scratch(docs.sparkSession, "merkle")
    rows = scratch.saved(leaf_rows(docs), "rows")
    placed = numbered(rows, ["tree"], ["doc_id", "hash", "row"], scratch)
    leaves = scratch.saved(placed.select("tree", "pos", F.col("total").alias("n"), "doc_id", "hash", "altered"), "leaves")
    nodes = grown(leaves, scratch, raise_by)
    subroots = scratch.saved(nodes.filter("last").select("tree", "n", "hash"), "subroots")
    ordered = numbered(subroots, [], ["tree"], scratch)
    trees = scratch.saved(
        ordered.select("tree", "n", F.col("pos").alias("top"), F.col("total").alias("trees"), F.col("hash").alias("subroot")), "trees"
    )
    above = grown(trees.select(F.lit(TOP).alias("tree"), F.col("top").alias("pos"), F.col("trees").alias("n"), F.col("subroot").alias("hash")), scratch, raise_by)
    return Manifest(leaves, nodes.unionByName(above), trees, scratch, raise_by)


def octopus(positions: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Coordinates (level, idx) of the nodes missing to lead the leaves at ``positions`` to the top of their tree."""
    missing, known = [], np.unique(positions)
    for level in range(height(n)):
        siblings = known ^ 1
        absent = siblings[(siblings < width(n, level)) & ~np.isin(siblings, known)]
        missing += [(level, int(i)) for i in absent]
        known = np.unique(known >> 1)
    return missing


def _requests(key, rows):
    """What a leaf partition fetches: its own tree's missing nodes and subroot, those of the top tree, and the root."""
    tree, block = (k.as_py() for k in key)
    n, top, trees = (rows.column(c)[0].as_py() for c in ("n", "top", "trees"))
    own = [(tree, level, i) for level, i in octopus(rows.column("pos").to_numpy(), n)] + [(tree, height(n), 0)]
    above = [(TOP, level, i) for level, i in octopus(np.array([top]), trees)] + [(TOP, height(trees), 0)]
    wanted = own + above
    of, level, idx = zip(*wanted, strict=True)
    return pa.table(
        [pa.array([tree] * len(wanted), pa.string()), pa.array([block] * len(wanted), pa.int64()), pa.array(of, pa.string()), pa.array(level, pa.int32()), pa.array(idx, pa.int64())],
        names=["tree", "block", "of", "level", "idx"],
    )


class Paths:
    """Nodes of one tree that a leaf partition knows: its leaves, what it fetched, and what it derives from them."""

    def __init__(self, n: int, leaves: dict[int, str], fetched: list[dict[int, str]]):
        self.n, self.levels = n, [dict(leaves)]
        for level in range(height(n)):
            below = self.levels[level]
            onward = {i >> 1 for i in below}
            below.update(fetched[level])
            self.levels.append({i: digest(*[below[j] for j in (2 * i, 2 * i + 1) if j < width(n, level)]) for i in onward})

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def proof(self, at: int) -> list[str | None]:
        """The sibling at each level, None where a node has none."""
        return [self.levels[level].get((at >> level) ^ 1) for level in range(height(self.n))]


def folded(leaf: str, at: int, siblings: list[str | None]) -> str:
    """The top that a leaf and its siblings lead to."""
    for level, sibling in enumerate(siblings):
        if sibling is None:
            leaf = digest(leaf)
        else:
            leaf = digest(sibling, leaf) if (at >> level) & 1 else digest(leaf, sibling)
    return leaf


PROOF = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean,"
    " position long, proof array<string>"
)


def _expand(with_proofs: bool):
    def run(key, rows, got):
        tree = key[0].as_py()
        n, top, trees = (rows.column(c)[0].as_py() for c in ("n", "top", "trees"))
        held = {tree: [{} for _ in range(height(n) + 1)], TOP: [{} for _ in range(height(trees) + 1)]}
        for of, level, i, h in zip(*(got.column(c).to_pylist() for c in ("of", "level", "idx", "hash")), strict=True):
            held[of][level][i] = h.hex()
        subroot, root = held[tree][-1][0], held[TOP][-1][0]
        ids, at, hashes, altered = (rows.column(c).to_pylist() for c in ("doc_id", "pos", "hash", "altered"))
        hexes = [h.hex() for h in hashes]
        own = Paths(n, dict(zip(at, hexes, strict=True)), held[tree])
        above = Paths(trees, {top: own.top}, held[TOP])
        onward = above.proof(top)
        tail = "".join(s for s in onward if s)
        sums, folds, proofs = [], [], []
        for i, changed in zip(at, altered, strict=True):
            siblings = own.proof(i)
            sums.append(digest("".join(s for s in siblings if s), tail))
            # an untouched leaf leads to the interior nodes derived for all of them
            folds.append(above.top if changed is None else folded(folded(changed.hex(), i, siblings), top, onward))
            proofs.append([s for s in siblings + onward if s] if with_proofs else None)
        size = len(at)
        return pa.table(
            [
                pa.array(ids, pa.int64()), pa.array(hexes, pa.string()), pa.array([subroot] * size, pa.string()), pa.array([root] * size, pa.string()),
                pa.array(sums, pa.string()), pa.array(folds, pa.string()), pa.array([f == root for f in folds], pa.bool_()),
                pa.array(at, pa.int64()), pa.array(proofs, pa.list_(pa.string())),
            ],
            names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "position", "proof"],
        )

    return run


def proofs(tree: Manifest, wanted: DataFrame | None = None, with_proofs: bool = False) -> DataFrame:
    """Proof and verification of leaves: of all, or of rows of ``tree.leaves`` that the caller picked.

    ``altered`` is the digest that a leaf shows now, null if it is as the
    manifest has it; ``folded_root`` is what it leads to.  ``with_proofs``
    returns the siblings too, leaf to root.
    """
    rows = (tree.leaves if wanted is None else wanted).join(small(tree.trees.select("tree", "top", "trees")), "tree")
    rows = rows.withColumn("block", F.shiftright("pos", tree.raised))
    requests = rows.select("tree", "block", "pos", "n", "top", "trees").groupBy("tree", "block")
    requests = requests.applyInArrow(_requests, "tree string, block long, of string, level int, idx long")
    nodes = tree.nodes.select(F.col("tree").alias("of"), "level", "idx", "hash")
    got = tree.scratch.saved(requests.join(nodes, ["of", "level", "idx"]), "fetched")
    return rows.groupBy("tree", "block").cogroup(got.groupBy("tree", "block")).applyInArrow(_expand(with_proofs), PROOF)
