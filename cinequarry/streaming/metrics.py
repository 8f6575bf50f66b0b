"""Metric streams, and their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVERY = 100
#: Frames that a chunk takes over from those before it.
CARRIED = 2
#: A frame with its chunk; what is carried into that chunk, oldest first; and whether it came late.
CARRIES = "clip long, frame long, value double, chunk long, carried array<struct<frame: bigint, value: double>>, late boolean"


def by_flush(log: DataFrame, every: int = EVERY) -> DataFrame:
    """Mean loss of each bucket between two flushes. Works on a batch and on a stream
    (update or complete mode)."""
    return log.groupBy(F.floor((F.col("step") - 1) / every).alias("flush"), "bucket").agg(F.round(F.avg("loss"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def by_event_time(events: DataFrame, size: str = "6 hours", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count and mean of each type in windows of event time; rows later than ``late`` are dropped from a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def chunk_of(frame, size: int = 4):
    """Chunk of a frame: the first alone, then ``size`` at a time."""
    return F.when(frame == 0, 0).otherwise(1 + F.floor((frame - 1) / size)).cast("long")


def chunked(frames: DataFrame, size: int = 4) -> DataFrame:
    """(clip, frame, chunk, carried): frames of a stream in order of arrival with their
    chunk and how many frames of earlier chunks (two at most) are carried into it.

    The state of a clip is one number, so it doesn't grow with the clip."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for part in parts:
            rows = []
            for frame in sorted(part["frame"]):
                chunk = 0 if seen == 0 else 1 + (seen - 1) // size
                before = 0 if chunk == 0 else 1 + (chunk - 1) * size
                rows.append((key[0], int(frame), chunk, min(2, before)))
                seen += 1
            state.update((seen,))
            yield pd.DataFrame(rows, columns=["clip", "frame", "chunk", "carried"])

    return frames.select("clip", "frame").groupBy("clip").applyInPandasWithState(run, "clip long, frame long, chunk long, carried long", "seen long", "append", "NoTimeout")


class ChunkCarrier(StatefulProcessor):
    """State of a clip: how many frames were taken, the last one's number, and a list of the
    frames that the open chunk carries and of the latest ones, which the next will carry; at
    most 2 * CARRIED of them, however long the clip."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "n long, last long")
        self.open = handle.getListState("open", "frame long, value double")
        self.latest = handle.getListState("latest", "frame long, value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, last = self.taken.get() if self.taken.exists() else (0, None)
        carried, latest = ([tuple(x) for x in state.get()] if state.exists() else [] for state in (self.open, self.latest))
        out = []
        arrived = pd.concat(list(rows))
        for frame, value in sorted(zip(arrived["frame"].tolist(), arrived["value"].tolist(), strict=True)):
            if last is not None and frame <= last:
                out.append((key[0], frame, value, None, None, True))
                continue
            if n == 0 or (n - 1) % self.size == 0:
                carried = latest
            chunk = 0 if n == 0 else 1 + (n - 1) // self.size
            out.append((key[0], frame, value, chunk, [{"frame": f, "value": v} for f, v in carried], False))
            latest = [*latest, (frame, value)][-CARRIED:]
            n, last = n + 1, frame
        self.taken.update((n, last))
        for state, held in ((self.open, carried), (self.latest, latest)):
            if held:
                state.put(held)
        yield pd.DataFrame(out, columns=["clip", "frame", "value", "chunk", "carried", "late"]).astype({"chunk": "Int64"})

    def close(self) -> None:
        pass


def carried_stream(frames: DataFrame, size: int = 4) -> DataFrame:
    """CARRIES for each row of a stream of (clip, frame, value), as ``carried_batch`` gives
    them if a clip's frames come in order of their numbers. A micro-batch puts its own rows in order.
    A row whose number isn't above the last one taken of its clip is late: it comes out as such, with
    no chunk, and changes nothing. Needs the RocksDB state store, as any list state does."""
    rows = frames.select(F.col("clip").cast("long").alias("clip"), F.col("frame").cast("long").alias("frame"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("clip").transformWithStateInPandas(ChunkCarrier(size), CARRIES, "append", "none")


def carried_batch(frames: DataFrame, size: int = 4) -> DataFrame:
    """The same of a whole table: of rows that repeat a frame's number the least value is taken,
    the others are late. Frames count by their place in the clip. A frame looks back at the
    few places that its chunk can carry, so the window's list is short."""
    w = Window.partitionBy("clip").orderBy("frame")
    rows = frames.select(F.col("clip").cast("long").alias("clip"), F.col("frame").cast("long").alias("frame"), F.col("value").cast("double").alias("value"))
    rows = rows.withColumn("late", F.row_number().over(Window.partitionBy("clip", "frame").orderBy("value")) > 1)
    taken = rows.where(~F.col("late")).withColumn("at", F.row_number().over(w).cast("long") - 1)
    taken = taken.withColumn("chunk", chunk_of(F.col("at"), size))
    back = F.collect_list(F.struct("at", "frame", "value")).over(w.rowsBetween(-(size - 1 + CARRIED), -1))
    begin = F.when(F.col("chunk") == 0, 0).otherwise(1 + (F.col("chunk") - 1) * size)
    taken = taken.withColumn("begin", begin).withColumn("back", back)
    held = F.filter("back", lambda x: (x["at"] < F.col("begin")) & (x["at"] >= F.col("begin") - CARRIED))
    taken = taken.select("clip", "frame", "value", "chunk", F.transform(held, lambda x: F.struct(x["frame"].alias("frame"), x["value"].alias("value"))).alias("carried"), "late")
    none = rows.where("late").select("clip", "frame", "value", F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("array<struct<frame: bigint, value: double>>").alias("carried"), "late")
    return taken.union(none)
