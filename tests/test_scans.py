"""Scans over range parts against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinequarry.operators import ordering


@pytest.fixture(autouse=True)
def many_parts(spark):
    """Small tables are range-partitioned into several parts, too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def loop(rows, start=None):
    """(key, place, a, b) in order -> state after each row."""
    states, out = {}, {}
    for k, i, a, b in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        x = states.get(k, b if start == "first" else 0.0)
        if a is not None and b is not None:
            x = a * x + b
        states[k] = out[k, i] = x
    return out


def scanned(spark, rows, parts, **options):
    df = spark.createDataFrame(rows, "k string, i long, a double, b double").repartition(parts)
    got = ordering.scan(df, ["k"], ["i"], F.col("a"), F.col("b"), "x", **options)
    assert got.columns == ["k", "i", "a", "b", "x"]
    found = got.collect()
    assert len(found) == len(rows)
    return {(r.k, r.i): r.x for r in found}


def close(got, want):
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 1e-9 * max(1, abs(want[k])) for k in want)


def test_maps_by_doubling():
    rng = np.random.default_rng(1)
    key = np.repeat([5, 3, 9, 1], [1, 700, 2, 64])
    a, b = rng.normal(size=len(key)), rng.normal(size=len(key))
    got_a, got_b = ordering.composed_maps(key, a, b)
    for i in range(len(key)):
        x, y = 0.0, 1.0
        for j in range(i + 1):
            if key[j] == key[i]:
                x, y = a[j] * x + b[j], a[j] * y + b[j]
        assert np.isclose(got_b[i], x) and np.isclose(got_a[i], y - x)
    assert [len(x) for x in ordering.composed_maps(np.zeros(0), np.zeros(0), np.zeros(0))] == [0, 0]


def test_one_group_holds_all_rows(spark):
    """Its rows lie in every part; no task has them all."""
    draw = random.Random(2)
    rows = [("hot", i, draw.choice([0.9, 1.0, 0.5, 0.0, -1.0]), float(draw.randint(-5, 5))) for i in range(4000)]
    close(scanned(spark, rows, 6), loop(rows))
    df = spark.createDataFrame(rows, "k string, i long, a double, b double")
    ranged = df.repartitionByRange("k", "i").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(ranged) > 1 and max(r["count"] for r in ranged) < 2400


def test_many_groups_nulls_and_starts(spark):
    draw = random.Random(3)
    rows = [(draw.choice([None, "a", "b", *"cdefgh"]), i, draw.choice([0.9, 1.0, 0.25]), draw.random()) for i in range(1500)]
    close(scanned(spark, rows, 5, start=F.col("b")), loop(rows, "first"))
    odd = rows + [("a", 5000, None, 3.0), ("a", 5001, 2.0, None), ("z", 1, None, None)]
    close(scanned(spark, odd, 5), loop(odd))
    assert scanned(spark, [], 1) == {}


def test_running_sum_is_one_case(spark):
    rows = [(i, (i * 37) % 11) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, n long")
    sums = ordering.exclusive_sum(df, ["i"], "n", "before")
    both = ordering.scan(sums, [], ["i"], F.lit(1.0), F.col("n"), "x")
    assert both.where(F.col("x") != F.col("before") + F.col("n")).count() == 0 and both.count() == 3000


def test_states_of_a_chain(spark):
    """Three levels of joined steps, against a walk."""
    draw = random.Random(4)
    steps = [(i, [draw.randrange(5) for _ in range(5)], [draw.randrange(9) for _ in range(5)]) for i in range(70)]
    df = spark.createDataFrame(steps, "at long, to array<int>, adds array<bigint>").repartition(4)
    state, total, want = 0, 0, []
    for i, to, adds in steps:
        want.append((i, state, total))
        state, total = to[state], total + adds[state]
    for fan in (4, 1024):
        assert sorted(tuple(r) for r in ordering.states_before(df, fan).collect()) == want
    assert ordering.states_before(df.where("at < 0")).collect() == []


def test_arrow_columns_pass(spark):
    df = spark.createDataFrame([("a", 1, ["x", None]), ("a", 2, None)], "k string, i long, s array<string>")
    got = ordering.scan(df, ["k"], ["i"], F.lit(1.0), F.lit(1.0), "n").orderBy("i").collect()
    assert [(r.s, r.n) for r in got] == [(["x", None], 1.0), (None, 2.0)]
