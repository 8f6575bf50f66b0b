"""Token layouts, bins and the segments within them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import cut_lineage, dense_ids, places_within, states_before
from .sampling import portable_uniform


VIDEO, AUDIO, TEXT, PAD = range(4)


def with_tokens(layouts: DataFrame) -> DataFrame:
    """Adds what follows from a layout's shape (frames, rows and columns of latents, audio, and
    the patch sizes patch and patch_t): times and cells of its video tokens, and seq_len with
    the audio's tokens. Frames are padded to whole patches."""
    times = F.ceil(F.col("frames") / F.col("patch_t"))
    cells = F.floor(F.col("rows") / F.col("patch")) * F.floor(F.col("columns") / F.col("patch"))
    return layouts.withColumn("times", times.cast("long")).withColumn("cells", cells.cast("long")).withColumn("seq_len", (F.col("times") * F.col("cells") + F.col("audio")).cast("long"))


def position_ids(layouts: DataFrame, text_len: int) -> DataFrame:
    """(layout, pos, t, h, w, modality) of the tokens of every layout (layout and the columns of
    ``with_tokens``): video cells row by row, audio on the video's time axis, then text after
    the last time."""
    each = layouts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("seq_len") + text_len - 1)).alias("pos"))
    pos, wide = F.col("pos"), F.floor(F.col("columns") / F.col("patch"))
    i = pos - F.col("times") * F.col("cells")
    video, audio = i < 0, i < F.col("audio")
    step = F.when(F.col("audio") > 0, F.col("times") / F.col("audio")).otherwise(0.0)
    after = F.greatest(F.col("times") - 1.0, (F.col("audio") - 1) * step) + 1
    zero, minus = F.lit(0.0), F.lit(-1.0)
    return each.select(
        "layout", "pos",
        F.when(video, F.floor(pos / F.col("cells")).cast("double")).when(audio, i * step).otherwise(after + (i - F.col("audio"))).alias("t"),
        F.when(video, F.floor((pos % F.col("cells")) / wide).cast("double")).when(audio, minus).otherwise(zero).alias("h"),
        F.when(video, (pos % wide).cast("double")).when(audio, minus).otherwise(zero).alias("w"),
        F.when(video, VIDEO).when(audio, AUDIO).otherwise(TEXT).cast("long").alias("modality"),
    )


def budget(layouts: DataFrame, batch: int) -> DataFrame:
    """One row: tokens of a bin, and samples it can hold at most."""
    tokens = F.max("seq_len") * batch
    return layouts.agg(tokens.alias("tokens"), F.ceil(tokens / F.min("seq_len")).alias("samples"))


#: Items that are laid out together in one task.
STREAM_BLOCK = 4096


def next_fit(items: DataFrame, order: list[str], size: str, most_tokens: int, most_items: int, block: int = STREAM_BLOCK) -> DataFrame:
    """``items`` with bin, slot and x_off (long): in ``order``, which has to be total, an item
    goes to the open bin if its size fits beside the others and they are fewer than
    ``most_items``, else the next bin opens with it. An item above ``most_tokens`` is alone.

    Where a bin ends follows from where it begins, so items are cut into blocks by their
    places, each with the few items after it that its last bin can reach. A block tells for
    each place where a bin may begin in it where the first bin of the next block begins, and
    how many bins begin in it; these steps are joined (``ordering.states_before``), and then
    each block lays out its own bins. No task sees more than a block."""
    if not 0 < most_items <= block:
        raise ValueError("a bin's items have to fit into a block")
    placed = cut_lineage(dense_ids(items, order, "_at").withColumn("_block", F.floor(F.col("_at") / block)))
    near = (F.col("_at") % block < most_items) & (F.col("_block") > 0)
    met = placed.withColumn("_in", F.explode(F.when(near, F.array("_block", F.col("_block") - 1)).otherwise(F.array("_block"))))

    def ends(sizes: np.ndarray) -> np.ndarray:
        """Where the bin ends that begins at each item."""
        until = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        i = np.arange(len(sizes))
        fits = np.searchsorted(until, until[:-1] + most_tokens, side="right") - 1
        return np.minimum(np.maximum(fits, i + 1), i + most_items)

    def steps(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_at")
        own = int((rows["_block"].to_numpy() == key[0].as_py()).sum())
        end = ends(rows["_size"].to_numpy()).tolist()
        to, n = [max(0, i - own) for i in range(own + most_items)], [0] * (own + most_items)  # behind the block: places of the next
        for i in range(own - 1, -1, -1):
            to[i], n[i] = to[end[i]], n[end[i]] + 1
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "to": pa.array([to[:most_items]], pa.list_(pa.int32())), "adds": pa.array([n[:most_items]], pa.list_(pa.int64()))})

    def laid(rows: pa.Table, begin: pa.Table) -> pa.Table:
        rows = rows.sort_by("_at")
        sizes = rows["_size"].to_numpy()
        own = int((rows["_block"].to_numpy() == rows["_in"].to_numpy()).sum())
        end, at, number = ends(sizes), begin["state"][0].as_py(), begin["total"][0].as_py()
        first, last = [], []
        while at < own:
            first.append(at)
            at = int(end[at])
            last.append(at)
        first, n = np.array(first, np.int64), np.array(last, np.int64) - np.array(first, np.int64)
        begins = np.repeat(first, n)
        taken = first[0] + np.arange(len(begins)) if len(first) else begins
        before = np.cumsum(sizes) - sizes
        out = rows.take(pa.array(taken)).select(names)
        told = [np.repeat(np.arange(number, number + len(n)), n), taken - begins, before[taken] - before[begins]]
        return pa.Table.from_arrays([*out.columns, *map(pa.array, told)], names=[*names, "bin", "slot", "x_off"])

    names = items.columns
    kept = met.select(*names, F.col(size).cast("long").alias("_size"), "_at", "_block", "_in")
    states = states_before(kept.select("_at", "_block", "_in", "_size").groupBy("_in").applyInArrow(steps, "at bigint, to array<int>, adds array<bigint>"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return kept.groupBy("_in").cogroup(states.groupBy("at")).applyInArrow(laid, f"{fields}, bin bigint, slot bigint, x_off bigint")


def bin_stream(members: DataFrame, lengths: DataFrame, draws: int, ranks: int, most_tokens: int, most_items: int, seed: int = 0) -> DataFrame:
    """(rank, bin, slot, x_off, bucket, item): the bins of a whole training stream.

    ``draws`` buckets are drawn by their number of ``members`` (bucket, item), the same for all
    ranks, and fill bins by ``next_fit`` with the ``lengths`` (bucket, seq_len) of their
    layouts; so all ranks have the same layouts. Each rank draws its own item of the bucket
    for each slot. Draws follow from seed, rank and draw. There is a row for each bucket in
    ``lengths``; a bucket without members is never drawn."""
    placed = places_within(members.select("bucket", "item"), ["bucket"], ["item"], "place")
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).join(lengths, "bucket")
    upto = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    bounds = sizes.select(upto.alias("upto"), "bucket", "n", "seq_len").agg(F.array_sort(F.collect_list(F.struct("upto", "bucket", "n", "seq_len"))).alias("bounds"))
    drawn = members.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(bounds))  # one row
    hit = F.element_at(F.filter("bounds", lambda b: portable_uniform(seed, F.col("draw")) * F.element_at("bounds", -1)["upto"] < b["upto"]), 1)
    shapes = drawn.select("draw", hit.alias("b")).select("draw", "b.bucket", "b.n", "b.seq_len")
    bins = next_fit(shapes, ["draw"], "seq_len", most_tokens, most_items)
    slots = bins.withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranks - 1).cast("long"))))
    own = F.floor(portable_uniform(seed + 1, F.concat_ws("|", "rank", "draw")) * F.col("n")).cast("long")
    return slots.withColumn("place", own).join(placed, ["bucket", "place"]).select("rank", "bin", "slot", "x_off", "bucket", "item")


def first_fit(items: DataFrame, key: str, size: str, most_tokens: int, most_items: int) -> list[tuple[int, int]]:
    """(key, size) of one bin's items: in order of ``key``, an item is taken if it fits.

    A round asks for the next ``most_items`` items that are small enough for the room
    left, so the driver never sees more than that, and each round fills the room or
    moves on; the number of rounds doesn't depend on the table's size but on how often
    the next few items don't fit together."""
    least = items.agg(F.min(size)).first()[0]
    taken: list[tuple[int, int]] = []
    room, after = most_tokens, None
    while least is not None and len(taken) < most_items and room >= least:
        ahead = items.where(F.col(size) <= room) if after is None else items.where((F.col(size) <= room) & (F.col(key) > after))
        batch = ahead.select(key, size).orderBy(key).limit(most_items).collect()
        if not batch:
            break
        for row in batch:
            after = row[0]
            if row[1] <= room and len(taken) < most_items:
                taken.append((row[0], row[1]))
                room -= row[1]
    return taken


def with_offsets(bins: DataFrame, text_len: int = 0) -> DataFrame:
    """Adds x_off and joint_off: where each slot's noised tokens and its whole segment start
    in the bin. A bin has a bounded number of slots."""
    before = Window.partitionBy("bin").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    x = F.sum("seq_len").over(before) - F.col("seq_len")
    return bins.withColumn("x_off", x).withColumn("joint_off", x + (F.row_number().over(Window.partitionBy("bin").orderBy("slot")) - 1) * text_len)


def bin_runs(bins: DataFrame, joint_len: int, text_len: int) -> DataFrame:
    """(bin, pos, n, segment, source, is_text): the runs of positions of every bin, ``n`` from
    ``pos`` on: a slot's noised tokens, its text, and in the end the padding as a segment of its
    own. ``source`` is the first position's place among the bin's noised tokens or texts and
    goes up with it; null for padding. Runs of no positions are left out."""
    whole = Window.partitionBy("bin")
    placed = with_offsets(bins, text_len).withColumn("used", F.max(F.col("joint_off") + F.col("seq_len") + text_len).over(whole)).withColumn("last", F.max("slot").over(whole))
    size, slot, used = F.col("seq_len"), F.col("slot"), F.col("used")
    seq, text = F.when(size > 0, size).otherwise(0), F.when(size >= 0, text_len).otherwise(size + text_len)
    run = lambda pos, n, segment, source, is_text: F.struct(
        pos.cast("long").alias("pos"), n.cast("long").alias("n"), segment.cast("long").alias("segment"), source.cast("long").alias("source"), F.lit(is_text).alias("is_text")
    )
    runs = F.array(
        run(F.col("joint_off"), seq, slot, F.col("x_off"), False), run(F.col("joint_off") + seq, text, slot, slot * text_len + seq - size, True),
        run(used, F.when(slot == F.col("last"), joint_len - used), slot + 1, F.lit(None), False),
    )
    return placed.select("bin", F.explode(runs).alias("r")).select("bin", "r.*").where("n > 0")


def bin_tokens(bins: DataFrame, joint_len: int, text_len: int) -> DataFrame:
    """(bin, pos, segment, source, is_text) for every position of the runs of every bin."""
    each = bin_runs(bins, joint_len, text_len).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return each.select("bin", (F.col("pos") + F.col("i")).alias("pos"), "segment", (F.col("source") + F.col("i")).alias("source"), "is_text")


def patch_place(i, depth: int, height: int, width: int, p: int):
    """(token, place in token) of cell ``i`` of a (depth, height, width) grid cut into p x p x p patches."""
    d, h, w = F.floor(i / (height * width)), F.floor(i / width) % height, i % width
    token = (F.floor(d / p) * (height // p) + F.floor(h / p)) * (width // p) + F.floor(w / p)
    return token.cast("long"), (((d % p) * p + h % p) * p + w % p).cast("long")


def _patch_cells(depth: int, height: int, width: int, p: int) -> list[list[int]]:
    """Cells of each patch, in order of their places in it."""
    grid = range(0, depth, p), range(0, height, p), range(0, width, p)
    inside = [(a, b, c) for a in range(p) for b in range(p) for c in range(p)]
    return [[((d + a) * height + h + b) * width + w + c for a, b, c in inside] for d in grid[0] for h in grid[1] for w in grid[2]]


def patches(grid: Column, depth: int, height: int, width: int, p: int) -> Column:
    """A (depth, height, width) grid, given as one array, as an array of p x p x p patches."""
    return F.array(*[F.array(*[F.get(grid, F.lit(i)) for i in cells]) for cells in _patch_cells(depth, height, width, p)])


def unpatch(tokens: Column, depth: int, height: int, width: int, p: int) -> Column:
    """The grid again."""
    back = {i: (t, k) for t, cells in enumerate(_patch_cells(depth, height, width, p)) for k, i in enumerate(cells)}
    return F.array(*[F.get(F.get(tokens, F.lit(back[i][0])), F.lit(back[i][1])) for i in range(depth * height * width)])


def pack_plan(placed: DataFrame, width: int, text_len: int) -> DataFrame:
    """One row for each bin of slots with offsets (bin, slot, seq_len, x_off, joint_off): used
    tokens, bounds (array: where each segment begins, padded to ``width`` + 1 entries by the
    end), and for each slot where its own tokens and its texts stand among all of the bin
    (inverse: the way back from the joint order). A bin holds at most ``width`` slots."""
    slots = F.array_sort(F.collect_list(F.struct("slot", "joint_off", "x_off", "seq_len")))
    bins = placed.groupBy("bin").agg(slots.alias("slots")).withColumn("used", F.element_at("slots", -1)["joint_off"] + F.element_at("slots", -1)["seq_len"] + text_len)
    tail = F.array_repeat(F.col("used"), F.lit(width + 1) - F.size("slots"))
    inverse = F.transform("slots", lambda s: F.struct(s["slot"].alias("slot"), (s["joint_off"] - s["x_off"]).alias("x_shift"), (s["joint_off"] + s["seq_len"]).alias("text_at")))
    return bins.select("bin", "used", F.concat(F.transform("slots", lambda s: s["joint_off"]), tail).alias("bounds"), inverse.alias("inverse"))
