"""Merkle manifest of a table: roots, authentication paths and their verification."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import dense_ids, places_within
from .common import materialize

#: What a leaf tells of a row.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of the tree within an aligned block, and nodes of a full block.
LEVELS = 10
BLOCK = 1 << LEVELS
_PATH = "array<struct<left: boolean, hash: string>>"

#: A node's digest, or None where a ragged tree has no node.
Node = str | None


def joined(left: Node, right: Node) -> Node:
    """Digest of a run of two nodes, or of one at the ragged end."""
    return None if left is None else sha256((left + (right or "")).encode()).hexdigest()


class Treehash:
    """Makes the node of one height over the leaves from ``at`` on, a leaf or a joined pair
    each step, and holds a node of each height at most."""

    def __init__(self, leaves: list[str], at: int, height: int) -> None:
        self.leaves, self.at, self.height = leaves, at, height
        self.stack: list[tuple[int, Node]] = []

    @property
    def low(self) -> float:
        """Height of the lowest node held; its own if there is none, endless if it is done."""
        if not self.stack:
            return self.height
        return float("inf") if self.stack[-1][0] == self.height else self.stack[-1][0]

    def step(self) -> None:
        if len(self.stack) > 1 and self.stack[-1][0] == self.stack[-2][0]:
            (_, right), (height, left) = self.stack.pop(), self.stack.pop()
            self.stack.append((height + 1, joined(left, right)))
        else:
            self.stack.append((0, self.leaves[self.at] if self.at < len(self.leaves) else None))
            self.at += 1


def height_of(block: int, n: int) -> int:
    """Levels within a block of ``n`` nodes. Only a tree's single block has less than all,
    and one of BLOCK nodes has as many either way."""
    return LEVELS if block else (n - 1).bit_length()


def block_root(leaves: list[str], height: int) -> str:
    stack = Treehash(leaves, 0, height)
    while stack.low != float("inf"):
        stack.step()
    return stack.stack[0][1]


def traverse(leaves: list[str], height: int) -> Iterator[list[Node]]:
    """The siblings on the way up from each leaf, leaf after leaf.

    Each height has the sibling in force and a stack at work on the one to follow. After
    a leaf, heights whose node ends there take over their stack's node, and 2 * height - 1
    steps go to the stack that holds the lowest node. So each is ready in time, and all
    stacks together hold no more nodes than a few for each height."""
    siblings: list[Node] = [None] * height
    stacks: list[Treehash] = []
    for h in range(height):
        first, second = Treehash(leaves, 0, h), Treehash(leaves, 1 << h, h)
        for stack in (first, second):
            while stack.low != float("inf"):
                stack.step()
        siblings[h] = second.stack[0][1]
        stacks.append(first)
    for at in range(len(leaves)):
        yield list(siblings)
        after = at + 1
        for h in range(height):
            if after % (1 << h):
                break
            siblings[h] = stacks[h].stack[0][1]
            stacks[h] = Treehash(leaves, after + (1 << h) ^ (1 << h), h)
        for _ in range(2 * height - 1):
            working = min(stacks, key=lambda s: s.low, default=None)
            if working is None or working.low == float("inf"):
                break
            working.step()


def leaf_digest(columns: dict[str, Column]) -> Column:
    """sha256 of all values one after the other: ``-`` for null, else bytes, ``:``, value."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns.values()]
    return F.sha2(F.concat(*told), 256)


def _blocks(nodes: DataFrame) -> DataFrame:
    """(tree, at, hash) of the level above: the root of each aligned block."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        tree, block = (k.as_py() for k in key)
        leaves = rows.sort_by("at")["hash"].to_pylist()
        return pa.table({"tree": pa.array([tree], pa.string()), "at": pa.array([block], pa.int64()), "hash": [block_root(leaves, height_of(block, len(leaves)))]})

    blocks = nodes.select("tree", F.shiftright("at", LEVELS).alias("block"), "at", "hash")
    return blocks.groupBy("tree", "block").applyInArrow(run, "tree string, at bigint, hash string")


def _paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` (tree, at, hash, more) with path, subroot and root: the way up within the
    block, then that of the block's root, which ``above`` tells (tree, at, path, subroot, root)."""
    names = ["tree", "at", "hash", *[c for c in nodes.columns if c not in ("tree", "at", "hash")]]

    def run(rows: pa.Table, upper: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        leaves = rows["hash"].to_pylist()
        height = height_of(rows["at"][0].as_py() >> LEVELS, len(leaves))
        shared, subroot, root = (upper[c][0].as_py() for c in ("path", "subroot", "root"))
        paths = [[*({"left": bool(at >> h & 1), "hash": x} for h, x in enumerate(siblings)), *shared] for at, siblings in enumerate(traverse(leaves, height))]
        told = {"path": pa.array(paths, pa.list_(pa.struct([("left", pa.bool_()), ("hash", pa.string())]))), "subroot": pa.array([subroot] * len(leaves)), "root": pa.array([root] * len(leaves))}
        return pa.Table.from_arrays([*rows.select(names).columns, *told.values()], names=[*names, *told])

    kinds = [f"{c} {nodes.schema[c].dataType.simpleString()}" for c in names]
    left = nodes.withColumn("block", F.shiftright("at", LEVELS)).groupBy("tree", "block")
    right = above.select("tree", F.col("at").alias("block"), "path", "subroot", "root").groupBy("tree", "block")
    return left.cogroup(right).applyInArrow(run, ", ".join([*kinds, f"path {_PATH}", "subroot string", "root string"]))


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """Tables (tree, at, hash) of every LEVELS-th level, from the nodes given to one that has
    a single node a tree."""
    levels = [nodes]
    while len(levels) == 1 or levels[-1].where("at > 0").limit(1).count():
        levels.append(materialize(_blocks(levels[-1].select("tree", "at", "hash")), "merkle-level"))
    return levels


def _descend(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """Paths of the lowest of ``levels``, block by block from those of the highest."""
    for nodes in reversed(levels[1:-1]):
        top = materialize(_paths(nodes, top), "merkle-paths")
    return _paths(levels[0], top)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = COLUMNS, changed: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, changed_leaf, path, subroot, root), a row for each of ``docs``.

    The rows of each ``group_col`` make a tree, leaves in order of ``id_col`` (null first;
    rows that repeat an id in order of their digests); a node is the digest of two that
    follow each other, or of the last one. The trees' roots, in order of the group (null
    first, by bytes), make the tree above them. ``path`` leads from the leaf to ``root``:
    each step's sibling, null if there is none, and whether it is on the left. ``changed``
    gives expressions for columns; ``changed_leaf`` is the leaf with those in place.

    Leaves are digested where they are read, and only digests are shuffled. Each aligned
    block of BLOCK nodes is one task's row group, whatever the size of its tree; its root
    is a node of the level above, and a block's shared way up is joined to it, not to its
    leaves. An empty table has no rows; other columns are not read."""
    kept = {c: F.col(c) for c in columns}
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("tree"),
        leaf_digest(kept).alias("hash"),
        leaf_digest(kept | (changed or {})).alias("changed_leaf"),
    )
    leaves = places_within(materialize(rows, "merkle-leaves"), ["tree"], ["doc_id", "hash"], "at")
    levels = _climb(materialize(leaves.select("tree", "at", "hash", "doc_id", "changed_leaf"), "merkle-leaves"))
    forest = dense_ids(levels[-1].select("tree", "hash"), ["tree"], "at").select(F.lit("").alias("tree"), "at", "hash", F.col("tree").alias("group"))
    over = _climb(materialize(forest, "merkle-subroots"))
    root = over[-1].select("tree", "at", F.array().cast(_PATH).alias("path"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    subroots = _descend(over, root).select(F.col("group").alias("tree"), F.lit(0).cast("long").alias("at"), "path", F.col("hash").alias("subroot"), "root")
    found = _descend(levels, materialize(subroots, "merkle-paths"))
    return found.select("doc_id", F.col("hash").alias("leaf"), "changed_leaf", "path", "subroot", "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    beside = lambda acc, s: F.when(s["hash"].isNull(), acc).when(s["left"], F.concat(s["hash"], acc)).otherwise(F.concat(acc, s["hash"]))
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(beside(acc, s), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.coalesce(s["hash"], F.lit(""))), ""), 256)
