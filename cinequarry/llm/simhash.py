"""SimHash near-dedup: 64-bit fingerprints linked by BK-trees over shards."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, group_minimum, materialize, salt_of

SHINGLE = 4
RADIUS = 4
#: Fingerprints that a shard should hold on average; decides how many blocks a fingerprint is cut into.
SHARD_TARGET = 64
#: A shard with more fingerprints is dealt out again by its remaining bits.
SHARD_LIMIT = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text as a signed 64-bit integer.

    Words are cut at ASCII white space after A-Z became a-z; every shingle (with
    repeats) votes with its XXH64; a bit is set if more than half of the votes
    have it. No words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:j], 42) for i, j in zip((ends - sizes)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, "<u8"))


def majority(values: np.ndarray) -> int:
    """The bits set in over half of 64-bit ``values``, as a signed integer; 0 of none."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):  # bounds the bit matrix of a very long text
        votes += np.unpackbits(values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(values), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp: long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(x) for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def shard_links(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (root, other) that join all of a shard's fingerprints which are within
    ``radius`` bits of each other, directly or over others of the shard.

    A BK-tree holds a child for each distance to its parent, so from a node at
    distance d only edges d - radius to d + radius can lead on. What has been
    reached leaves the tree, and a subtree that has been reached wholly is not
    entered again, so a group of thousands of copies costs about one visit each."""
    n = len(fps)
    fps = [x & 0xFFFFFFFFFFFFFFFF for x in fps]
    children: list[dict[int, int]] = [{} for _ in range(n)]
    parent = [-1] * n
    for k in range(1, n):
        x, p = fps[k], 0
        while (c := children[p].get(d := (x ^ fps[p]).bit_count())) is not None:
            p = c
        children[p][d] = k
        parent[k] = p
    left = [1] * n  # nodes of the subtree that have not been reached
    for k in range(n - 1, 0, -1):
        left[parent[k]] += left[k]
    reached = bytearray(n)
    links = []
    for root in range(n):
        if reached[root]:
            continue
        todo = [root]
        found = [root]
        while todo or found:
            for k in found:
                reached[k] = 1
                while k >= 0:
                    left[k] -= 1
                    k = parent[k]
            found = []
            if not todo:
                break
            x, stack = fps[todo.pop()], [0] if left[0] else []
            while stack:
                p = stack.pop()
                d = (x ^ fps[p]).bit_count()
                if d <= radius and not reached[p]:
                    found.append(p)
                stack += [c for e, c in children[p].items() if left[c] and d - radius <= e <= d + radius]
            todo += found
            links += [(root, k) for k in found]
    return links


def _runs(bits: list[int], blocks: int) -> list[int]:
    """Masks of ``blocks`` runs of ``bits``."""
    return [sum(1 << b for b in bits[len(bits) * i // blocks : len(bits) * (i + 1) // blocks]) for i in range(blocks)]


def _rest(mask: int, radius: int) -> list[int]:
    """Masks of radius + 1 runs of the bits that ``mask`` leaves: within ``radius`` bits, one is equal."""
    return _runs([b for b in range(64) if not mask >> b & 1], radius + 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _longs(masks: list[int]) -> Column:
    return F.array(*[F.lit(_signed(m)).cast("long") for m in masks])


def _equal(fps: np.ndarray, mask: int) -> Iterator[np.ndarray]:
    """The groups of two or more of ``fps`` that are equal in ``mask``."""
    keys = fps & np.int64(_signed(mask))
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.diff(keys[order], prepend=keys[order[:1]] ^ 1))
    ends = np.append(starts[1:], len(fps))
    for i in np.flatnonzero(ends - starts > 1).tolist():
        yield fps[order[starts[i] : ends[i]]]


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, target: int = SHARD_TARGET, limit: int = SHARD_LIMIT) -> DataFrame:
    """(a, b): links that connect all distinct ``fp`` within ``radius`` bits.

    Of m blocks at least m - radius are equal in two such fingerprints; m grows with the
    number of fingerprints so that trees stay small. The first equal block is one of the
    first radius + 1, and by these alone fingerprints are dealt to tasks: radius + 1 copies of
    each, however many there are. A task searches a tree for each choice of
    m - radius - 1 later blocks, and one of more than ``limit`` by runs of its other bits.
    What far more share than others, ``limit`` at least, is dealt out again by radius + 1
    runs of its other bits, of which one must be equal too."""
    total, m = fps.count(), radius + 1
    while m < 16 and total > target * 2 ** (64 * (m - radius) // m):
        m += 1
    blocks = _runs(list(range(64)), m)
    first = blocks[: radius + 1]
    below = [_rest(x, radius) for x in first]
    most = max(limit, 4 * total >> 64 // m)
    # By way, and by way and run of what is dealt out again: the bits that are equal, and choices of those that have to be.
    searched = {i: (x, [sum(c) for c in combinations(blocks[i + 1 :], m - radius - 1)]) for i, x in enumerate(first)}
    searched |= {(i + 1) * (radius + 1) + j: (x | y, [0]) for i, x in enumerate(first) for j, y in enumerate(below[i])}

    dealt = fps.select("fp", F.posexplode(_longs(first)).alias("way", "mask")).select("fp", "way", F.col("fp").bitwiseAND(F.col("mask")).alias("shard"))
    hot = dealt.groupBy("way", "shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("way", "shard", F.lit(True).alias("hot"))
    again = F.element_at(F.array(*[_longs([x | y for y in ys]) for x, ys in zip(first, below, strict=True)]), F.col("way") + 1)
    dealt = dealt.join(hot, ["way", "shard"], "left").select(
        "fp", "way", "hot", F.posexplode(F.when(F.col("hot"), F.transform(again, lambda m: F.col("fp").bitwiseAND(m))).otherwise(F.array("shard"))).alias("part", "shard")
    )
    dealt = dealt.select(F.when(F.col("hot"), (F.col("way") + 1) * (radius + 1) + F.col("part")).otherwise(F.col("way")).alias("way"), "shard", "fp")

    def trees(way: int, fps: np.ndarray) -> Iterator[np.ndarray]:
        same, choices = searched[way]
        for mask in choices:
            for group in _equal(fps, mask):
                if len(group) > limit:
                    for x in _rest(same | mask, radius):
                        yield from _equal(group, x)
                else:
                    yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shards() -> Iterator[tuple[int, np.ndarray]]:
            last, held = None, []
            for batch in batches:
                ways, keys, values = (c.to_numpy() for c in batch.columns)
                cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(ways) != 0)) + 1
                for i, part in enumerate(np.split(values, cuts)):
                    if not len(part):
                        continue
                    at = cuts[i - 1] if i else 0
                    if last is not None and (ways[at], keys[at]) != last:
                        yield int(last[0]), np.concatenate(held)
                        held = []
                    last = ways[at], keys[at]
                    held.append(part)
            if held:
                yield int(last[0]), np.concatenate(held)

        found: list[tuple[int, int]] = []
        for way, own in shards():
            for tree in trees(way, own) if len(own) > 1 else ():
                values = tree.tolist()
                found += [(values[i], values[j]) for i, j in shard_links(values, radius)]
                if len(found) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])
                    found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    return dealt.repartition("way", "shard").sortWithinPartitions("way", "shard", "fp").mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row for each row of ``docs``: id, fp (long), component (least id that can
    be reached over links of ``radius`` or fewer differing bits).

    Null and empty texts have fingerprint 0 and are linked like any other. Rows that
    repeat an id are returned once each. A null id is ignored by the least id, so a
    component of null ids only has a null component. Extra columns are not read."""
    spark = docs.sparkSession
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints").withColumn("salt", salt_of(F.col("id")))
    groups = materialize(group_minimum(prints, "fp", "id"), "fingerprint-groups")
    labels = connected_components(fingerprint_links(groups.select("fp"), radius), spark).withColumnRenamed("node", "fp")
    least = materialize(labels.join(groups.select("fp", "least"), "fp").groupBy("label").agg(F.min("least").alias("component")), "components")
    labels = labels.join(least, "label").select("fp", "component")
    named = groups.join(labels, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"), F.explode("salts").alias("salt"))
    return prints.join(named, ["fp", "salt"]).select("id", "fp", "component")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The documents with the least id of each component. Rows that repeat that id and
    the text are the same document, and one stays; rows that share that id but not the
    text all stay, as do rows without an id."""
    groups = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text_col, radius)
    keep = groups.where(F.col("id") == F.col("component")).select(F.col("id").alias("_kept_id")).distinct()
    named = docs.where(F.col(id_col).isNotNull())
    kept = named.join(keep, named[id_col] == keep["_kept_id"], "left_semi").dropDuplicates([id_col, text_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
