"""Tables that stand in for clip manifests, captions, features and metric logs, with the
same definitions as SQL for checking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = ("user", "assistant", "system")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clip_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probed clips: item_id, text, source, duration (seconds), w, h."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"),
        "text",
        "source",
        "lang",
        (F.col("n_chars") / 100.0).alias("duration"),
        (200 + (F.col("doc_id") * 37) % 600).alias("w"),
        (200 + (F.col("doc_id") * 53) % 600).alias("h"),
    )


CLIP_SRC = """clip_src AS (SELECT doc_id AS item_id, text, source, lang, n_chars::DOUBLE / 100 AS duration,
  200 + (doc_id * 37) % 600 AS w, 200 + (doc_id * 53) % 600 AS h FROM documents)"""


def metric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric log: step, loss, t (noise level), bucket, clip."""
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("step"),
        F.col("value").alias("loss"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("t"),
        F.col("event_type").alias("bucket"),
        F.col("user_id").alias("clip"),
    )


METRIC_EVENTS = """metric_events AS (SELECT event_id + 1 AS step, value AS loss,
  json_extract_string(props, '$.k')::DOUBLE / 100 AS t, event_type AS bucket, user_id AS clip FROM events)"""


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features: vec_id, label, v (array<double>)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


FEAT = "feat AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def caption_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions: stem, field (0..2, by priority of role), pos, caption."""
    field = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) - 1
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stem"), field.alias("field"), F.col("turn").alias("pos"), F.col("text").alias("caption"))


CAPTION_FIELDS = """caption_fields AS (SELECT conv_id AS stem, list_position(['user','assistant','system'], role) - 1 AS field,
  turn AS pos, text AS caption FROM conversations)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("clip"), F.col("turn").alias("frame"), "role", "text")


FRAMES = "frames AS (SELECT conv_id AS clip, turn AS frame, role, text FROM conversations)"
