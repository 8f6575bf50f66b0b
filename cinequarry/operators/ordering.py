"""Dense ids and running totals over a whole table, without putting it into one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _ranged(df: DataFrame, order: list) -> DataFrame:
    return cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))


def exclusive_sum(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Adds ``name``: sum of ``value`` over all rows before this one in ``order``, which
    has to be total. Rows are range-partitioned; a partition's total is one row."""
    ranged = _ranged(df, order)
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_total"))
    before = totals.select("_part", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return ranged.withColumn("_local", local).join(F.broadcast(before), "_part").withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def dense_ids(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... in ``order``, which has to be total."""
    return exclusive_sum(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", name).drop("_one")


def places_within(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within each combination of ``keys``, in ``order``.

    Rows are range-partitioned by keys and order together, so a key with a third of all
    rows spans many parts, whose counts are offsets; equal rows may be placed either way."""
    ranged = _ranged(df, [*keys, *order])
    counts = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)) - 1
    return ranged.join(before, [*keys, "_part"]).withColumn(name, (local + F.col("_before")).cast("long")).drop("_part", "_before")


def middle_values(df: DataFrame, key: str, value: str, upper: bool = False) -> DataFrame:
    """(key, middle): median of the values that aren't null, or their upper median: the rows
    at the middle places, so no key's values are gathered."""
    some = df.select(key, value).where(F.col(value).isNotNull())
    placed = places_within(some, [key], [value], "_place")
    n = some.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    at = [F.floor(F.col("_n") / 2)] if upper else [F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)]
    return placed.join(n, key).where(F.col("_place").isin(*at)).groupBy(key).agg(F.avg(value).alias("middle"))


def _same(left: str, right: str, keys: list[str]) -> Column:
    """Equal keys, null among them."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def composed_maps(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the map x -> a x + b of all its key's rows up to it, one after the other.
    Rows of a key follow each other. Maps of twice as many rows are joined each round."""
    a, b = a.copy(), b.copy()
    at = np.arange(len(key))
    since = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), at, 0)) if len(key) else at
    step, longest = 1, int((at - since).max(initial=0)) + 1
    while step < longest:
        i = np.flatnonzero(at - step >= since)
        a[i], b[i] = a[i] * a[i - step], a[i] * b[i - step] + b[i]
        step *= 2
    return a, b


def scan(df: DataFrame, by: list[str], order: list[str], a: Column, b: Column, name: str, start: Column | float = 0.0) -> DataFrame:
    """Adds ``name`` (double): the state after each row of its group ``by``, in ``order``,
    where a row turns state x into a x + b and the group's first row finds ``start``, told
    by that row. With a = 1 it is a running sum, with 0 < a < 1 a moving average.

    Maps of this kind can be joined in any grouping that keeps their order. So rows are
    range-partitioned by group and order together and each part joins its own rows' maps;
    of groups that span several parts, fewer than there are parts, one map a part is
    carried on. No group meets in one task. Where a or b is null the state stays. Order
    has to be total; the columns of ``df`` go through Arrow."""
    told = df.select("*", F.xxhash64(*by).alias("_key") if by else F.lit(0).cast("long").alias("_key"), F.when(b.isNull(), 1.0).otherwise(F.coalesce(a.cast("double"), F.lit(1.0))).alias("_a"),
                     F.when(a.isNull(), 0.0).otherwise(F.coalesce(b.cast("double"), F.lit(0.0))).alias("_b"), (start if isinstance(start, Column) else F.lit(start)).cast("double").alias("_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, row = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key, a, b, first = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("_key", "_a", "_b", "_start"))
            if last is not None and last[0] == key[0]:
                a[0], b[0] = a[0] * last[1], a[0] * last[2] + b[0]
                first[0] = last[3]
            since = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), np.arange(n), 0))
            a, b = composed_maps(key, a, b)
            first = first[since]
            last = key[-1], a[-1], b[-1], first[-1]
            kept = [i for i, c in enumerate(batch.schema.names) if c not in ("_key", "_a", "_b", "_start")]
            names = [*(batch.schema.names[i] for i in kept), "_a", "_b", "_start", "_row"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *map(pa.array, (a, b, first, np.arange(row, row + n)))], names=names)
            row += n

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    ranged = told.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    local = cut_lineage(ranged.mapInArrow(run, f"{fields}, _a double, _b double, _start double, _row bigint").withColumn("_part", F.spark_partition_id()))
    ends = local.groupBy(*by, "_part").agg(F.max_by("_a", "_row").alias("_a"), F.max_by("_b", "_row").alias("_b"), F.min_by("_start", "_row").alias("_start"))
    spans = ends.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where("_n > 1")

    def carry(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_part")
        state, before = rows["_start"][0].as_py(), []
        for a, b in zip(rows["_a"].to_pylist(), rows["_b"].to_pylist(), strict=True):
            before.append(state)
            state = a * state + b
        return rows.select([*by, "_part"]).append_column("_before", pa.array(before, pa.float64()))

    kinds = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), "_part int, _before double"])
    before = spans.groupBy(*by).applyInArrow(carry, kinds)
    # two rows for each boundary between parts at most
    joined = local.alias("l").join(F.broadcast(before).alias("r"), _same("l", "r", [*by, "_part"]), "left").select("l.*", "_before")
    return joined.withColumn(name, F.col("_a") * F.coalesce("_before", "_start") + F.col("_b")).drop("_a", "_b", "_start", "_row", "_part", "_before")


def states_before(steps: DataFrame, fan: int = 1024) -> DataFrame:
    """(at, state, total): the state in which each step of a chain begins and what steps before
    it have added, from state 0. ``steps`` has at (long: 0, 1, 2, ...), and by state ``to``
    (array<int>: the state it leads to) and ``adds`` (array<bigint>).

    Steps are joined ``fan`` at a time to steps of the level above until one is left, and
    states are handed down again, so no task sees more than ``fan`` steps of a level."""
    from ..sources.shared import new_path

    def written(df: DataFrame) -> DataFrame:
        path = new_path(df.sparkSession, "steps")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def whole(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        to, adds = None, None
        for f, n in zip(rows["to"].to_pylist(), rows["adds"].to_pylist(), strict=True):
            f, n = np.array(f), np.array(n)
            to, adds = (f, n) if to is None else (f[to], adds + n[to])
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "to": pa.array([to.tolist()], pa.list_(pa.int32())), "adds": pa.array([adds.tolist()], pa.list_(pa.int64()))})

    def handed(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        state, total, out = above["state"][0].as_py(), above["total"][0].as_py(), []
        for f, n in zip(rows["to"].to_pylist(), rows["adds"].to_pylist(), strict=True):
            out.append((state, total))
            state, total = f[state], total + n[state]
        return pa.table({"at": rows["at"], "state": pa.array([s for s, _ in out], pa.int32()), "total": pa.array([t for _, t in out], pa.int64())})

    above = lambda df: df.withColumn("_up", F.floor(F.col("at") / fan)).groupBy("_up")
    levels = [written(steps.select("at", "to", "adds"))]
    while levels[-1].where("at > 0").limit(1).count():
        levels.append(written(above(levels[-1]).applyInArrow(whole, "at bigint, to array<int>, adds array<bigint>")))
    states = levels[-1].select("at", F.lit(0).alias("state"), F.lit(0).cast("long").alias("total"))
    for nodes in reversed(levels[:-1]):
        states = written(above(nodes).cogroup(states.groupBy("at")).applyInArrow(handed, "at bigint, state int, total bigint"))
    return states
