"""Draws that depend on a seed and an id only: partitions and retries can't change them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) for each combination of keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


def normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal number for each combination of keys."""
    u, v = uniform(seed * 2 + 1, *keys), uniform(seed * 2 + 2, *keys)
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(F.lit(6.283185307179586) * v)


def hash_sample(rows: DataFrame, key: str, count: int, seed: int = 0) -> DataFrame:
    """``count`` rows without replacement, the same at every call."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(count)


def draw_buckets(sizes: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """(draw, bucket, n): buckets (bucket, n) drawn with replacement by their sizes. There is
    a row for each bucket, so they are gathered into one row of bounds."""
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    bounds = sizes.select("bucket", "n", F.sum("n").over(before).alias("upto")).agg(F.array_sort(F.collect_list(F.struct("upto", "bucket", "n"))).alias("bounds"))
    spark = sizes.sparkSession
    at = spark.range(draws).withColumnRenamed("id", "draw").withColumn("u", uniform(seed, "draw")).join(F.broadcast(bounds))
    hit = F.element_at(F.filter("bounds", lambda b: F.col("u") * F.element_at("bounds", -1)["upto"] < b["upto"]), 1)
    return at.select("draw", hit.alias("b")).select("draw", "b.bucket", "b.n")


def batches(members: DataFrame, n_batches: int, size: int, seed: int = 0) -> DataFrame:
    """(batch, slot, bucket, item): each batch draws one bucket by size and its items from it
    with replacement. ``members`` has bucket and item; an item's place comes from a total
    order within parts of its bucket, so draws join on (bucket, place)."""
    from .ordering import dense_ids

    placed = dense_ids(members.select("bucket", "item"), ["bucket", "item"], "place")
    first = placed.groupBy("bucket").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    drawn = draw_buckets(first.select("bucket", "n"), n_batches, seed).withColumnRenamed("draw", "batch")
    slots = drawn.join(F.broadcast(first.select("bucket", "first")), "bucket").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    place = F.col("first") + F.floor(uniform(seed + 1, "batch", "slot") * F.col("n"))
    return slots.select("batch", "slot", "bucket", place.alias("place")).join(placed, ["bucket", "place"]).select("batch", "slot", "bucket", "item")


def timesteps(spark: SparkSession, n: int, seed: int = 0, mean: float = 0.0, spread: float = 1.0, shift: float = 3.0, uniform_share: float = 0.1, clean_share: float = 0.05) -> DataFrame:
    """(id, t, t2, kept): noise levels from a logistic of a normal number, shifted, of which a
    share is uniform and a share is 1; a second level that is no lower; and whether
    conditioning is kept (nine times in ten)."""
    from ..functions.scalars import timeshift

    x = normal(seed, "id") * spread + mean
    base = timeshift(1 / (1 + F.exp(-x)), shift)
    which, u = uniform(seed + 10, "id"), uniform(seed + 11, "id")
    t = F.when(which < clean_share, 1.0).when(which < clean_share + uniform_share, u).otherwise(base)
    return spark.range(n).select("id", t.alias("t"), F.greatest(t, uniform(seed + 12, "id")).alias("t2"), (uniform(seed + 13, "id") >= 0.1).alias("kept"))


def portable_uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) for a key, from the first digits of an MD5: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def draw_caption(texts: Column, item: Column, seed: int = 0) -> Column:
    """One of an item's captions, each as likely; null if it has none."""
    at = F.floor(portable_uniform(seed, item) * F.size(texts)).cast("int")
    return F.when(F.size(texts) > 0, F.get(texts, at))


def draw_from_primary(members: DataFrame, primary: Column, draws: int, seed: int = 0) -> DataFrame:
    """(draw, item): items (bucket, item) of the primary bucket only, with replacement."""
    from .ordering import dense_ids

    placed = dense_ids(members.where(F.col("bucket") == primary).select("item"), ["item"], "place")
    n = placed.agg(F.count(F.lit(1)).alias("n"))
    wanted = placed.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(n))  # one row
    return wanted.select("draw", F.floor(portable_uniform(seed, F.col("draw")) * F.col("n")).alias("place")).join(placed, "place").select("draw", "item")
