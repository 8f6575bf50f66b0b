"""Roots, paths and their verification against a tree of whole levels."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from cinequarry.llm import merkle

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings_of(levels, at):
    return [(level[(at >> h) ^ 1] if (at >> h) ^ 1 < len(level) else None) for h, level in enumerate(levels[:-1])]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 31, 32, 33, 100, 127, 128])
def test_traversal_gives_every_path(n):
    leaves = [H(str(i)) for i in range(n)]
    levels = levels_of(leaves)
    height = merkle.height_of(0, n)
    assert merkle.block_root(leaves, height) == levels[-1][0]
    assert list(merkle.traverse(leaves, height)) == [siblings_of(levels, i) for i in range(n)]


def test_ragged_block_of_a_larger_tree():
    """The last block of a tree rises through all levels, alone at the higher ones."""
    leaves = [H(str(i)) for i in range(3)]
    levels = levels_of(leaves)
    root = levels[-1][0]
    for _ in range(merkle.LEVELS - 2):
        root = H(root)
    assert merkle.block_root(leaves, merkle.height_of(1, 3)) == root
    paths = list(merkle.traverse(leaves, merkle.height_of(1, 3)))
    assert [p[:2] for p in paths] == [siblings_of(levels, i) for i in range(3)] and all(x is None for p in paths for x in p[2:])


def test_stacks_hold_few_nodes(monkeypatch):
    """No more than a few nodes for each level, whatever the leaves."""
    made, most = [], 0
    plain = merkle.Treehash.__init__

    def noted(self, *args):
        plain(self, *args)
        made.append(self)

    monkeypatch.setattr(merkle.Treehash, "__init__", noted)
    height = 9
    for _ in merkle.traverse([H(str(i)) for i in range(1 << height)], height):
        del made[: -3 * height]
        most = max(most, sum(len(s.stack) for s in made[-height:]))
    assert most <= 3 * height


def told(*values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute(rows):
    """(id, leaf) -> subroot, root, siblings with sides, of rows (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, told(*r)))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = {t: levels_of([x[2] for x in sorted(trees[t])]) for t in names}
    over = levels_of([own[t][-1][0] for t in names])
    out = {}
    for place, t in enumerate(names):
        for at, x in enumerate(sorted(trees[t])):
            out.setdefault((x[1] if x[0] else None, x[2]), []).append((own[t][-1][0], over[-1][0], siblings_of(own[t], at) + siblings_of(over, place)))
    return out


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def check(spark, rows):
    changed = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    df = merkle.manifest(rows_of(spark, rows), changed={"n_chars": changed})
    df = df.select("*", merkle.proof_digest(F.col("path")).alias("proof"), merkle.folded(F.col("leaf"), F.col("path")).alias("whole"), merkle.folded(F.col("changed_leaf"), F.col("path")).alias("folded"))
    got, wanted = {}, brute(rows)
    for r in df.collect():
        got.setdefault((r.doc_id, r.leaf), []).append((r.subroot, r.root, [x.hash for x in r.path]))
        assert r.proof == H("".join(x.hash or "" for x in r.path))
        assert r.whole == r.root
        assert (r.folded == r.root) == (r.changed_leaf == r.leaf)
    order = lambda x: str(x)
    assert {k: sorted(v, key=order) for k, v in got.items()} == {k: sorted(v, key=order) for k, v in wanted.items()}


def test_manifest_against_whole_levels(spark, monkeypatch):
    """Small blocks, so that paths cross several levels of blocks; one language has most rows."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    draw = random.Random(1)
    rows = [(i, draw.choice(["a", None]), draw.choice(["en"] * 8 + ["de", "fr", None, "", "é", "Z"]), draw.choice([None, i]), draw.choice(["", None, f"text {i}", "naïve ☃"])) for i in range(150)]
    check(spark, rows)


def test_nulls_repeats_and_one_row(spark):
    rows = [(None, "s", "en", 1, "x"), (3, "s", "en", 2, "y"), (3, "s", "en", 2, "y"), (3, "s", "en", 2, "z"), (4, None, None, None, None), (-2, "s", "de", 0, "")]
    check(spark, rows)
    check(spark, rows[:1])
    check(spark, [(i, None, f"l{i}", 1, "alone") for i in range(5)])


def test_empty_table_and_other_columns(spark):
    assert merkle.manifest(rows_of(spark, [])).collect() == []
    wide = rows_of(spark, [(i, "s", "en", i, "t") for i in range(5)])
    names = ["tree", "at", "hash", "path", "block", "root", "subroot", "leaf", "group", "changed_leaf", "_part"]
    plain = {r.doc_id: r for r in merkle.manifest(wide).collect()}
    got = {r.doc_id: r for r in merkle.manifest(wide.select("*", *[F.lit("clash").alias(c) for c in names])).collect()}
    assert got == plain and len(plain) == 5


def test_long_text(spark):
    check(spark, [(1, "s", "en", 9, "word " * 400_000), (2, "s", "en", 9, "short")])


def test_height_follows_rows():
    assert [merkle.height_of(0, n) for n in (1, 2, 3, 4, 5, merkle.BLOCK)] == [0, 1, 2, 2, 3, merkle.LEVELS]
    assert math.log2(merkle.BLOCK) == merkle.LEVELS
