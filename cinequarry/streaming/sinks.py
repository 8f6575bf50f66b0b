"""Where metric streams and evaluation results go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def long_metrics(log: DataFrame, key: str = "step") -> DataFrame:
    """(step, name, value): one row for each number of a wide log; nulls are left out."""
    names = [f.name for f in log.schema if f.name != key and f.dataType.simpleString() in ("int", "bigint", "float", "double")]
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    return log.select(key, F.explode(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("m")).select(key, "m.name", "m.value")


def append_metrics(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a table, a partition for each micro-batch. A batch that is run
    again after a failure replaces its own partition, so rows are neither lost nor doubled."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_report(summary: DataFrame, records: DataFrame, path: str) -> None:
    """Evaluation results as JSON lines, one for each label: its summary and its records,
    which are a handful of prompts and seeds."""
    by_label = records.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("seed", "prompt", "ok"))).alias("records"))
    summary.join(by_label, "label", "left").write.mode("errorifexists").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
