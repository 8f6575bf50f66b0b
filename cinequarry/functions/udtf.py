"""Table functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import SkipRestOfInputTableException, udtf


@udtf(returnType="window int, start double")
class ClipWindows:
    """Windows that fit into a source: clip_windows(duration, seconds, stride, most)."""

    def eval(self, duration: float, seconds: float, stride: float, most: int) -> Iterator[tuple[int, float]]:
        for i in range(most if duration is not None else 0):
            if i * stride + seconds > duration - 0.2:
                break
            yield i, round(i * stride, 3)


@udtf(returnType="clip bigint, win int, slot int, frame bigint, value string, seen bigint")
class ServeWindows:
    """Frames of all windows of a clip in one pass over its frames:
    serve_windows(TABLE(t) PARTITION BY clip ORDER BY at). The first row of a partition has
    ``needs``, sorted by frame; the others are frames. Rows are looked at up to the last frame
    needed, or the first beyond it; ``seen`` is their number. Slots without a frame come out
    with a null value."""

    def __init__(self):
        self.needs: list[Row] = []
        self.served = self.seen = 0
        self.out: list[tuple] = []

    def eval(self, row: Row) -> None:
        if row["needs"] is not None:
            self.clip, self.needs = row["clip"], row["needs"]
            return
        if not self.needs:
            raise SkipRestOfInputTableException("no window")
        self.seen += 1
        while self.served < len(self.needs) and self.needs[self.served]["frame"] <= row["at"]:
            need = self.needs[self.served]
            self.out.append((need["win"], need["slot"], need["frame"], row["value"] if need["frame"] == row["at"] else None))
            self.served += 1
        if self.served == len(self.needs):
            raise SkipRestOfInputTableException("all windows are served")

    def terminate(self) -> Iterator[tuple]:
        left = [(n["win"], n["slot"], n["frame"], None) for n in self.needs[self.served :]]
        for win, slot, frame, value in [*self.out, *left]:
            yield self.clip, win, slot, frame, value, self.seen


def serve_windows(frames: DataFrame, needs: DataFrame) -> DataFrame:
    """(clip, win, slot, frame, value, seen): ``needs`` (clip, win, slot, frame) with the value
    of ``frames`` (clip, frame, value; a frame once a clip) by ServeWindows. Needs travel as a
    clip's first row, so the two tables share one shuffle and a need is never copied to
    frames. Clips without needs give no row; needs without frames are null."""
    kind = "array<struct<frame: bigint, win: int, slot: int>>"
    asked = needs.groupBy("clip").agg(F.sort_array(F.collect_list(F.struct(F.col("frame").cast("bigint").alias("frame"), F.col("win").cast("int").alias("win"), F.col("slot").cast("int").alias("slot")))).alias("needs"))
    first = asked.select(F.col("clip").cast("bigint").alias("clip"), F.lit(-1).cast("bigint").alias("at"), F.lit(None).cast("string").alias("value"), F.col("needs").cast(kind).alias("needs"))
    rows = frames.where("frame >= 0").select(F.col("clip").cast("bigint").alias("clip"), F.col("frame").cast("bigint").alias("at"), F.col("value").cast("string").alias("value"), F.lit(None).cast(kind).alias("needs"))
    return ServeWindows(first.union(rows).asTable().partitionBy("clip").orderBy("at"))


def install(spark: SparkSession) -> None:
    spark.udtf.register("clip_windows", ClipWindows)
    spark.udtf.register("serve_windows", ServeWindows)
