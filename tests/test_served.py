"""Windows served in one pass by a table function, and chunks with carried frames by a stream's list state."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from cinequarry.functions.udtf import install, serve_windows
from cinequarry.plans.catalogue import QUERIES
from cinequarry.sources import fixtures as X
from cinequarry.streaming import metrics as T


def test_early_end(spark):
    frames = spark.range(1000).select(F.lit(1).alias("clip"), F.col("id").alias("frame"), F.concat(F.lit("f"), F.col("id")).alias("value"))
    frames = frames.union(spark.createDataFrame([(2, 0, "a"), (2, 9, "b"), (3, 0, "c"), (4, 0, "x"), (4, 1, "y")], frames.schema))
    needs = spark.createDataFrame([(1, 0, 0, 3), (1, 0, 1, 7), (1, 1, 0, 7), (1, 1, 1, 5), (2, 0, 0, 4), (3, 0, 0, 0), (3, 0, 1, 8), (5, 0, 0, 1)], "clip long, win int, slot int, frame long")
    got = sorted(map(tuple, serve_windows(frames, needs).collect()), key=str)
    want = [(1, 0, 0, 3, "f3", 8), (1, 0, 1, 7, "f7", 8), (1, 1, 0, 7, "f7", 8), (1, 1, 1, 5, "f5", 8), (2, 0, 0, 4, None, 2), (3, 0, 0, 0, "c", 1), (3, 0, 1, 8, None, 1), (5, 0, 0, 1, None, 0)]
    assert got == sorted(want, key=str)


def test_same_as_the_join(spark):
    """Slots at 1 and 3 frames a second over frames at 2, as the join gives them."""
    r = X.frames(spark, SF).groupBy("clip", "frame").agg(F.min("role").alias("value"))
    n = r.groupBy("clip").agg((F.max("frame") + 1).alias("n")).select("clip", "n", F.explode(F.array(F.lit(1.0), F.lit(3.0))).alias("rate"))
    count = F.floor(F.col("n") * F.col("rate") / 2.0)
    needs = n.select("clip", F.col("rate").cast("int").alias("win"), F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1))).alias("slot"), "rate")
    needs = needs.withColumn("frame", F.bround(F.col("slot") / F.col("rate") * 2.0).cast("long"))
    got = serve_windows(r, needs).groupBy(F.col("win").cast("double").alias("rate")).agg(F.count(F.lit(1)).alias("slots"), F.count("value").alias("matched"), F.count_distinct(F.when(F.col("value").isNotNull(), F.struct("clip", "frame"))).alias("frames"))
    want = QUERIES["q63_frame_need_join"](spark, SF)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_in_sql(spark):
    install(spark)
    spark.createDataFrame([(1, -1, None, [(2, 0, 0)]), (1, 2, "a", None), (1, 3, "b", None)], "clip long, at long, value string, needs array<struct<frame: bigint, win: int, slot: int>>").createOrReplaceTempView("asked")
    assert [tuple(r) for r in spark.sql("SELECT * FROM serve_windows(TABLE(asked) PARTITION BY clip ORDER BY at)").collect()] == [(1, 0, 0, 2, "a", 1)]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_carried_frames(spark, rocks, tmp_path):
    rows = X.feat(spark, SF).select(F.floor(F.col("vec_id") / 30).alias("clip"), (F.col("vec_id") % 30).alias("frame"), F.col("v")[0].alias("value"))
    for low, high in ((0, 4), (4, 5), (5, 19), (19, 30)):  # batches end within chunks
        rows.where(F.col("frame").between(low, high - 1)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/frames")
    again = spark.createDataFrame([(0, 3, 9.0)], "clip bigint, frame bigint, value double")
    again.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/frames")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/frames")
    q = T.carried_stream(stream).writeStream.format("memory").queryName("carried").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    plain = lambda df: sorted((r.clip, r.frame, r.late, r.value, r.chunk, None if r.carried is None else [tuple(x) for x in r.carried]) for r in df.collect())
    got = plain(spark.table("carried"))
    assert got == plain(T.carried_batch(rows.union(again)))
    assert sum(r[2] for r in got) == 1
    by = {(r[0], r[1]): r for r in got if not r[2]}
    for (clip, frame), r in by.items():
        begin = 0 if frame == 0 else 1 + (frame - 1) // 4 * 4
        assert r[5] == [(f, by[clip, f][3]) for f in range(max(0, begin - 2), begin)]
