"""Best-fit packing into bins of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import WORD_SEPARATOR, materialize

#: Permitted sequence lengths.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Bytes of text that one packing group should hold.
GROUP_BYTES = 32 << 20
#: Items laid into a bin one by one when its filling is foreseen; the rest is taken as a whole.
FORESEEN = 16
#: Fixed cost of a bin, in tokens; with the quadratic part it makes neither the shortest nor the longest bins best for everything.
BIN_COST = 64
QUADRATIC = 65_536


def bin_cost(capacity: int) -> float:
    """Cost of running one sequence: its tokens, a share for attention, and a fixed part."""
    return BIN_COST + capacity + capacity * capacity / QUADRATIC


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin of each item, start of each item within its bin, capacity of each bin.

    ``lengths`` are longest first and none is above the largest capacity. An item goes to
    the open bin that it leaves fullest, the oldest of equals. If none has room, a bin
    opens. All permitted lengths are weighed together by what is still to be packed: each
    that holds the item is filled, in thought, with the longest items ahead that fit, and
    the one with the least cost a token opens, the longer of equals. In the end every bin
    shrinks to the cheapest permitted length that holds its contents."""
    sizes = sorted(set(capacities))
    cheapest = {c: min((bin_cost(s), s) for s in sizes if s >= c) for c in sizes}
    held_by = lambda n: cheapest[sizes[bisect_left(sizes, n)]]
    longest_first = [-n for n in lengths]
    ahead = list(accumulate(reversed(lengths), initial=0))[::-1]  # tokens from an item on

    def foreseen(at: int, size: int) -> int:
        left, j = size - lengths[at], at + 1
        for _ in range(FORESEEN):
            j = bisect_left(longest_first, -left, lo=j)
            if not left or j == len(lengths):
                return size - left
            left -= lengths[j]
            j += 1
        return size - left + min(left, ahead[j])

    def opening(at: int) -> int:
        filled = [(size, max(1, foreseen(at, size))) for size in sizes if size >= lengths[at]]
        return min((held_by(n)[0] / n, -size) for size, n in filled)[1] * -1

    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    filled: list[int] = []
    place, start = [], []
    for i, n in enumerate(lengths):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            b, left = len(filled), opening(i)
            filled.append(0)
        place.append(b)
        start.append(filled[b])
        filled[b] += n
        if left > n:
            insort(room, (left - n, b))
    return place, start, [held_by(n)[1] for n in filled]


def _spread(rows: DataFrame, group_bytes: int) -> DataFrame:
    """Adds _deal: 0, or for rows of an id and text that are more than ``group_bytes``
    together, their number among the parts that they fill, in turn.

    There are at most as many such pairs as groups, so they can be broadcast. Where there are
    any, rows are written first: numbers that go by places in a table must not change if a task is
    run again."""
    key = F.xxhash64("doc_id", "text")
    bytes_of = F.octet_length("text").cast("long")
    by = rows.select(key.alias("_key"), bytes_of.alias("_b")).groupBy("_key").agg(F.sum("_b").alias("_b"), F.count(F.lit(1)).alias("_c"))
    large = by.where((F.col("_b") > group_bytes) & (F.col("_c") > 1)).select("_key", F.ceil(F.col("_b") / group_bytes).alias("_parts"))
    large = materialize(large, "repeated")
    if not large.limit(1).count():
        return rows.withColumn("_deal", F.lit(0).cast("long"))
    numbered = materialize(rows, "documents").withColumn("_at", F.monotonically_increasing_id()).withColumn("_key", key)
    dealt = numbered.join(F.broadcast(large), "_key", "left")
    return dealt.withColumn("_deal", F.coalesce(F.pmod("_at", "_parts"), F.lit(0).cast("long"))).drop("_at", "_key", "_parts")


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The packed sequences, a row for each bin: bin_id (string, unique), bin_capacity and
    n_tokens (long), doc_ids, members (array of structs, in order: doc_id, piece (int, from
    0), piece_start and n_tokens (words of the document, from piece_start on), bin_start
    (where the piece starts in the bin)) and texts (array<string>, of the members).

    A document above the largest capacity is cut into pieces of that capacity and a rest,
    whose texts are their words joined by spaces, so no word is lost; any other is one piece
    and keeps its text as it is. One without words (null, empty) has one piece of length 0,
    in the bin of another if there is room. Pieces are dealt by a hash of id, place and text
    to groups of about ``group_bytes`` of text, each packed in one task: longest first, ties
    by id, then piece. Repeated rows are packed once each; those of one id and text that are
    more than a group together are dealt to as many groups as they fill (see ``_spread``).
    Texts are shuffled once. Other columns are not read."""
    most = max(capacities)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    groups = max(1, -(-total // group_bytes))
    rows = _spread(rows, group_bytes)
    rows = rows.withColumn("_w", F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), WORD_SEPARATOR), "")).withColumn("_n", F.size("_w"))
    last = F.greatest(F.ceil(F.col("_n") / most).cast("int") - 1, F.lit(0))

    def piece(k: Column) -> Column:
        text = F.when(F.col("_n") <= most, F.col("text")).otherwise(F.array_join(F.slice("_w", k * most + 1, most), " "))
        return F.struct(k.alias("piece"), (k.cast("long") * most).alias("piece_start"), F.least(F.col("_n") - k * most, F.lit(most)).cast("long").alias("n_tokens"), text.alias("text"))

    pieces = rows.select("doc_id", "_deal", F.explode(F.transform(F.sequence(F.lit(0), last), piece)).alias("p")).select("doc_id", "_deal", "p.*")
    pieces = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "text", "_deal"), F.lit(groups)).cast("int")).drop("_deal")
    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"bin_id string, bin_capacity bigint, n_tokens bigint, doc_ids array<{kind}>, members array<struct<doc_id: {kind}, piece: int, piece_start: bigint, n_tokens: bigint, bin_start: bigint>>, texts array<string>")
    arrow = to_arrow_schema(schema)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        place, start, held = best_fit(rows["n_tokens"].to_pylist(), capacities)
        by_bin = np.argsort(np.array(place), kind="stable")
        rows = rows.append_column("bin_start", pa.array(start, pa.int64())).take(pa.array(by_bin)).combine_chunks()
        ends = np.cumsum(np.bincount(place, minlength=len(held)))
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        flat = {c: rows[c].combine_chunks() for c in ("doc_id", "piece", "piece_start", "n_tokens", "bin_start", "text")}
        one = lambda c: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        flat = {c: one(v) for c, v in flat.items()}
        names = ["doc_id", "piece", "piece_start", "n_tokens", "bin_start"]
        members = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([flat[c] for c in names], names=names))
        tokens = np.bincount(place, weights=rows["n_tokens"].to_numpy()[np.argsort(by_bin)], minlength=len(held)).astype(np.int64)
        group = key[0].as_py()
        columns = [pa.array([f"{group}-{b}" for b in range(len(held))]), pa.array(held, pa.int64()), pa.array(tokens), pa.ListArray.from_arrays(offsets, flat["doc_id"]), members, pa.ListArray.from_arrays(offsets, flat["text"])]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return pieces.groupBy("pack_group").applyInArrow(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``sequences`` by piece: doc_id, piece, piece_start, n_tokens, bin_id, bin_start,
    bin_capacity and text_md5 (of the piece's text; null if that is null)."""
    bins = sequences(docs, id_col, text_col, capacities, group_bytes)
    each = bins.select("bin_id", "bin_capacity", F.explode(F.arrays_zip("members", "texts")).alias("m"))
    return each.select("m.members.doc_id", "m.members.piece", "m.members.piece_start", "m.members.n_tokens", "bin_id", "m.members.bin_start", "bin_capacity", F.md5("m.texts").alias("text_md5"))
