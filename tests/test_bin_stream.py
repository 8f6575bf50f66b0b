"""All bins of a stream, laid out block by block, against one walk."""

import random

import pytest
from pyspark.sql import functions as F

from cinequarry.operators import packing


@pytest.fixture(autouse=True)
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def walk(sizes, most_tokens, most_items):
    out, bin_, slot, used = [], -1, 0, 0
    for i, n in enumerate(sizes):
        if bin_ >= 0 and slot + 1 < most_items and used + n <= most_tokens:
            slot += 1
        else:
            bin_, slot, used = bin_ + 1, 0, 0
        out.append((i, bin_, slot, used))
        used += n
    return out


@pytest.mark.parametrize("block", [8, 50, 4096])
def test_next_fit(spark, block):
    draw = random.Random(block)
    sizes = [draw.choice([1, 5, 20, 99, 100, 130, 0]) for _ in range(700)]
    rows = list(enumerate(sizes))
    draw.shuffle(rows)
    items = spark.createDataFrame([(i, n, f"name {i}") for i, n in rows], "i long, n int, more string").repartition(3)
    got = packing.next_fit(items, ["i"], "n", 100, 8, block)
    assert got.columns == ["i", "n", "more", "bin", "slot", "x_off"]
    found = got.orderBy("i").collect()
    assert [(r.i, r.bin, r.slot, r.x_off) for r in found] == walk(sizes, 100, 8)
    assert all(r.more == f"name {r.i}" and r.n == sizes[r.i] for r in found)


def test_levels_of_blocks(spark, monkeypatch):
    """So many blocks that their steps are joined on several levels."""
    plain = packing.states_before
    monkeypatch.setattr(packing, "states_before", lambda steps: plain(steps, 3))
    sizes = [random.Random(i).randint(1, 60) for i in range(300)]
    items = spark.createDataFrame(list(enumerate(sizes)), "i long, n long")
    got = packing.next_fit(items, ["i"], "n", 100, 4, 4).orderBy("i").collect()
    assert [(r.i, r.bin, r.slot, r.x_off) for r in got] == walk(sizes, 100, 4)


def test_edges(spark):
    items = spark.createDataFrame([(0, 500), (1, 1)], "i long, n long")
    assert [(r.i, r.bin) for r in packing.next_fit(items, ["i"], "n", 100, 4).orderBy("i").collect()] == [(0, 0), (1, 1)]
    assert packing.next_fit(items.where("i > 9"), ["i"], "n", 100, 4).collect() == []
    with pytest.raises(ValueError):
        packing.next_fit(items, ["i"], "n", 100, 9, 8)


def test_ranks_share_layouts(spark):
    members = spark.range(300).select(F.when(F.col("id") % 3 == 0, "long").otherwise("short").alias("bucket"), F.col("id").alias("item"))
    lengths = spark.createDataFrame([("long", 40), ("short", 15), ("unused", 7)], "bucket string, seq_len long")
    rows = packing.bin_stream(members, lengths, 400, 3, 100, 5, seed=2).collect()
    assert len(rows) == 1200
    by_rank = [sorted((r.bin, r.slot, r.x_off, r.bucket) for r in rows if r["rank"] == k) for k in range(3)]
    assert by_rank[0] == by_rank[1] == by_rank[2]
    size = {"long": 40, "short": 15}
    assert [(b, s, x) for b, s, x, _ in by_rank[0]] == [(b, s, x) for _, b, s, x in walk([size[x[3]] for x in by_rank[0]], 100, 5)]
    assert all((r.item % 3 == 0) == (r.bucket == "long") for r in rows)
    items = [[r.item for r in sorted(rows, key=lambda r: (r.bin, r.slot)) if r["rank"] == k] for k in range(3)]
    assert items[0] != items[1] and len(set(items[0])) > 150
    assert 90 < sum(r.bucket == "long" for r in rows) / 3 < 180
