from conftest import SF
from pyspark.sql import functions as F

from cinequarry.sources import fixtures as X
from cinequarry.streaming import metrics as T
from cinequarry.streaming import sinks


def run(spark, df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def stream(spark, name):
    batch = X.table(spark, SF, name)
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{SF}/{name}.parquet*")


def test_flush_means(spark, tmp_path):
    s = stream(spark, "events").select((F.col("event_id") + 1).alias("step"), F.col("value").alias("loss"), F.col("event_type").alias("bucket"))
    got = run(spark, T.by_flush(s), "flushes", "complete", tmp_path)
    want = T.by_flush(X.metric_events(spark, SF))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_event_windows(spark, tmp_path):
    got = run(spark, T.by_event_time(stream(spark, "events")), "event_windows", "complete", tmp_path)
    want = T.by_event_time(X.table(spark, SF, "events"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    hop = T.by_event_time(X.table(spark, SF, "events"), "6 hours", slide="3 hours")
    assert hop.agg(F.sum("n")).first()[0] == 2 * X.table(spark, SF, "events").count()


def test_chunks(spark, tmp_path):
    frames = stream(spark, "conversations").select(F.col("conv_id").alias("clip"), F.col("turn").alias("frame"))
    got = sorted(map(tuple, run(spark, T.chunked(frames), "chunks", "append", tmp_path).collect()))
    batch = X.frames(spark, SF).select("clip", "frame")
    once = batch.groupBy("clip", "frame").count().groupBy("clip").agg(F.max("count").alias("m"), F.max("frame").alias("last"), F.count(F.lit(1)).alias("n")).where("m = 1 and n = last + 1").select("clip")
    want = batch.join(once, "clip").withColumn("chunk", T.chunk_of(F.col("frame")))
    want = sorted((r.clip, r.frame, r.chunk, min(2, 0 if r.chunk == 0 else 1 + (r.chunk - 1) * 4)) for r in want.collect())
    clips = {r[0] for r in want}
    assert want and [g for g in got if g[0] in clips] == want


def test_metric_table(spark, tmp_path):
    s = stream(spark, "events").select((F.col("event_id") + 1).alias("step"), F.col("value").alias("loss"), F.lit(0.5).alias("lr"), F.lit(None).cast("double").alias("mfu"))
    for _ in range(2):  # the second run finds nothing new
        sinks.append_metrics(sinks.long_metrics(s), f"file://{tmp_path}/table", f"file://{tmp_path}/cp").awaitTermination(120)
    got = spark.read.parquet(f"file://{tmp_path}/table")
    n = X.table(spark, SF, "events").count()
    assert {r.name: r["count"] for r in got.groupBy("name").count().collect()} == {"loss": n, "lr": n}


def test_report(spark, tmp_path):
    summary = spark.createDataFrame([("a", 0.5, 2), ("b", 1.0, 0)], "label string, accuracy double, n int")
    records = spark.createDataFrame([("a", 2, "p", True), ("a", 1, "q", False)], "label string, seed int, prompt string, ok boolean")
    sinks.write_report(summary, records, f"file://{tmp_path}/report")
    back = {r.label: r for r in sinks.read_report(spark, f"file://{tmp_path}/report").collect()}
    assert [x.prompt for x in back["a"].records] == ["q", "p"] and back["b"].records is None
