"""The manifest beside a tree built from lists; octopus beside paths one by one."""

from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from foliant.llm import merkle

from .conftest import ODD


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        yield i, level[i ^ 1] if i ^ 1 < len(level) else None
        i >>= 1


def lead(value, steps):
    for i, sibling in steps:
        value = h(value) if sibling is None else h(sibling, value) if i % 2 else h(value, sibling)
    return value


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text) to the contract's columns."""
    groups = {}
    for row in rows:
        groups.setdefault((row[2] is not None, (row[2] or "").encode()), []).append((row, h(*map(field, row))))
    order = sorted(groups)
    trees = {k: sorted(groups[k], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])) for k in order}
    levels = {k: climb([x[1] for x in trees[k]]) for k in order}
    tops = climb([levels[k][-1][0] for k in order]) if order else []
    out = []
    for t, k in enumerate(order):
        for i, (row, leaf) in enumerate(trees[k]):
            steps, above = list(path(levels[k], i)), list(path(tops, t))
            now = leaf
            if row[0] is not None and crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                now = h(*map(field, (*row[:3], row[3] + 1, row[4])))
            fold = lead(lead(now, steps), above)
            proof = h(*[s for _, s in steps + above if s])
            out.append((row[0], leaf, levels[k][-1][0], tops[-1][0], proof, fold, fold == tops[-1][0], i))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "position"]


def got(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def table(spark, rows):
    full = [(*r, "x", 3, "t") for r in rows]
    return spark.createDataFrame(full, "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int, hash string")


def odd_rows():
    langs = [None, "", "en", "é", "-", "^"]
    rows = [(i, None if n % 4 == 0 else f"s{n}", langs[n % 6], None if t is None or n % 5 == 0 else len(t), t) for n, (i, t) in enumerate(ODD)]
    return rows + [(7, "s", "en", 3, "abc")] * 3 + [(i, "s", "de", i, "t") for i in range(70)] + [(500, "s", "de", 2**63 - 1, "t"), (14, "s", "de", 2**63 - 1, "t")]


@pytest.mark.parametrize("raised", [1, 3, merkle.RAISED])
def test_equals_tree_of_lists(spark, raised):
    rows = odd_rows()
    assert got(merkle.proofs(merkle.manifest(table(spark, rows), raised))) == sorted(brute(rows), key=str)


def test_empty_and_single(spark):
    empty = merkle.proofs(merkle.manifest(table(spark, [])))
    assert empty.columns[:7] == COLUMNS[:7] and empty.count() == 0
    one = [(0, None, None, None, None)]
    assert got(merkle.proofs(merkle.manifest(table(spark, one)))) == brute(one)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 64, 100])
def test_octopus_is_the_minimal_union(n):
    rng = np.random.default_rng(n)
    for size in {1, 2, n // 2 or 1, n}:
        at = np.sort(rng.choice(n, min(size, n), replace=False))
        levels = climb([h(str(i)) for i in range(n)])
        on_paths = {(lv, int(i) >> lv) for i in at for lv in range(len(levels))}
        wanted = {(lv, (int(i) >> lv) ^ 1) for i in at for lv in range(len(levels) - 1)}
        wanted = {(lv, i) for lv, i in wanted if i < len(levels[lv])} - on_paths
        found = merkle.octopus(at, n)
        assert len(found) == len(set(found)) and set(found) == wanted
        fetched = [{} for _ in levels]
        for lv, i in found:
            fetched[lv][i] = levels[lv][i]
        paths = merkle.Paths(n, {int(i): levels[0][i] for i in at}, fetched)
        assert paths.top == levels[-1][0]
        for i in at.tolist():
            assert paths.proof(i) == [s for _, s in path(levels, i)]
            assert merkle.folded(levels[0][i], i, paths.proof(i)) == levels[-1][0]


def test_some_leaves(spark):
    """Proofs of picked leaves, changed ones found out."""
    rows = odd_rows()
    tree = merkle.manifest(table(spark, rows))
    wanted = tree.leaves.filter("doc_id in (3, 14, 40)")
    found = merkle.proofs(tree, wanted, with_proofs=True).collect()
    whole = {(r[1], r[7]): r for r in brute(rows)}
    assert len(found) == sum(r[0] in (3, 14, 40) for r in rows)
    for row in found:
        assert tuple(row)[:8] == whole[row["leaf"], row["position"]]
        assert h(*row["proof"]) == row["proof_sha256"]
