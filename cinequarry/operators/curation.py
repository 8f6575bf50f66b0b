"""Operators on clip manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def assign_buckets(clips: DataFrame) -> DataFrame:
    """Adds size, clip_seconds and bucket: sources of a landscape size alternate between
    10 and 20 seconds in order of (duration, item_id); portrait ones have 10.

    Only the running count's parity matters, so rows are numbered within (size, part of
    the duration range) and parts are offset by their counts: no size meets in one task."""
    sized = clips.withColumn("size", S.aspect_by_nearest(F.col("w"), F.col("h")))
    order = ["duration", "item_id"]
    from .ordering import _ranged

    ranged = _ranged(sized, order)
    counts = ranged.groupBy("size", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("size", "_part", F.coalesce(F.sum("_n").over(Window.partitionBy("size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("size", "_part").orderBy(*order)) - 1 + F.col("_before")
    numbered = ranged.join(F.broadcast(before), ["size", "_part"]).withColumn("_at", at)
    seconds = F.when((F.col("size") == "288x512") | (F.col("_at") % 2 == 0), 10.0).otherwise(20.0)
    return numbered.withColumn("clip_seconds", seconds).withColumn("bucket", S.bucket_key(F.col("clip_seconds"), F.col("size"))).drop("_part", "_before", "_at")


def captions_by_clip(fields: DataFrame) -> DataFrame:
    """(stem, texts): captions of each clip in order of (field, pos), distinct, trimmed, blanks
    dropped; clips without any are left out. A clip has a handful of captions."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("field", "pos", "caption"))), lambda x: x["caption"])
    return fields.groupBy("stem").agg(S.collect_captions(ordered).alias("texts")).where(F.size("texts") > 0)


def windows_of(clips: DataFrame, seconds: float, stride: float | None = None, most: int = 6) -> DataFrame:
    """A row for each window that fits into a source: window, start."""
    starts = S.window_starts(F.col("duration"), seconds, seconds if stride is None else stride, most)
    return clips.select("*", F.posexplode(starts).alias("window", "start"))


def eligible(clips: DataFrame, least: Column | float) -> DataFrame:
    return clips.where((F.col("duration") >= least) & (F.col("w") > 0) & (F.col("h") > 0))


def cover_sizes(clips: DataFrame, count: int) -> DataFrame:
    """The ``count`` shortest clips, of which the longest of a size that has others gives
    way to the shortest clip of every size that is missing, sizes in order of their names.

    Only ``count`` rows and one for each size are looked at by the driver."""
    sized = clips.withColumn("size", S.aspect_by_threshold(F.col("w"), F.col("h"))).select("duration", "item_id", "size")
    picked = [tuple(r) for r in sized.orderBy("duration", "item_id").limit(count).collect()]
    first = {r["size"]: (r.m.duration, r.m.item_id, r["size"]) for r in sized.groupBy("size").agg(F.min(F.struct("duration", "item_id")).alias("m")).collect()}
    if count < len(first):
        raise ValueError(f"{count} clips can't cover {len(first)} sizes")
    by_width = lambda size: tuple(map(int, size.split("x")))
    for size in sorted(set(first) - {p[2] for p in picked}, key=by_width):
        sizes = [p[2] for p in picked]
        at = max((i for i, p in enumerate(picked) if sizes.count(p[2]) > 1), key=lambda i: (picked[i][0], -i))
        picked[at] = first[size]
    return clips.sparkSession.createDataFrame(sorted(picked), "duration double, item_id long, size string")
