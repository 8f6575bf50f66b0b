"""Grouped means, probes and reports over metric logs."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def masked_mean(error: Column, mask: Column, channels: int = 1) -> Column:
    """Sum of masked errors over the masked elements; 0 if none."""
    return F.sum(F.when(mask, error).otherwise(0.0)) / F.greatest(F.sum(F.when(mask, 1.0).otherwise(0.0)) * channels, F.lit(1.0))


def macro_mean(rows: DataFrame, sample: list[str], error: Column, mask: Column) -> DataFrame:
    """(mean, samples): mean over samples with any masked element of their masked means."""
    each = rows.groupBy(*sample).agg(F.avg(F.when(mask, error)).alias("m"))
    return each.agg(F.round(F.avg("m"), 6).alias("mean"), F.count("m").alias("samples"))


def probe(log: DataFrame, bands: int = 8) -> DataFrame:
    """Mean loss by noise band, clean-sample error by noise band, by bucket and by clip, in
    one pass: (axis, key, mean, n)."""
    banded = log.select(S.band(F.col("t"), bands).cast("string").alias("t"), "bucket", F.col("clip").cast("string").alias("clip"), "loss", S.clean_error(F.col("loss"), F.col("t")).alias("x1"))
    sets = banded.groupingSets([["t"], ["bucket"], ["clip"]], "t", "bucket", "clip").agg(F.avg("loss").alias("loss"), F.avg("x1").alias("x1"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    axis = F.when(F.col("g") == 3, "t").when(F.col("g") == 5, "bucket").otherwise("clip")
    out = sets.select(axis.alias("axis"), F.coalesce("t", "bucket", "clip").alias("key"), "loss", "x1", "n")
    means = F.array(F.struct(F.col("axis").alias("axis"), F.col("loss").alias("mean")), F.when(F.col("axis") == "t", F.struct(F.lit("t_x1").alias("axis"), F.col("x1").alias("mean"))))
    return out.select("key", "n", F.explode(F.array_compact(means)).alias("m")).select("m.axis", "key", F.round("m.mean", 6).alias("mean"), "n")


def upper_median(value: Column) -> Column:
    """Middle of the sorted values, the upper of two. For groups of bounded size."""
    return F.element_at(F.array_sort(F.collect_list(value)), (F.floor(F.count(value) / 2) + 1).cast("int"))


def accuracy(rows: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Share of rows where each prediction equals its truth (null-safe), where all do, and
    where any prediction is missing."""
    hits = {k: p.eqNullSafe(t) for k, (p, t) in pairs.items()}
    every, missing = F.lit(True), F.lit(False)
    for k, (p, _) in pairs.items():
        every, missing = every & hits[k], missing | p.isNull()
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return rows.agg(*[share(h).alias(k) for k, h in hits.items()], share(every).alias("all_right"), share(missing).alias("missing"), F.count(F.lit(1)).alias("n"))


def channel_stats(features: DataFrame, vector: str = "v") -> DataFrame:
    """(channel, mean, std): over all rows; stds have a floor of a twentieth of the largest
    and 1e-4."""
    long = features.select(F.posexplode(vector).alias("channel", "x"))
    stats = long.groupBy("channel").agg(F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"))
    top = F.max("std").over(Window.partitionBy())  # as many rows as channels
    return stats.select("channel", "mean", F.greatest(F.col("std"), top * 0.05, F.lit(1e-4)).alias("std"))


def available(metrics: dict[str, Callable[[], float]]) -> dict[str, float]:
    """Values of the metrics that can be told here; one that fails is left out with a warning."""
    told = {}
    for name, value in metrics.items():
        try:
            told[name] = value()
        except Exception as e:  # whatever it is, the others still count
            warnings.warn(f"{name} is left out: {e}", stacklevel=2)
    return told
