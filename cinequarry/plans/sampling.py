"""Queries that draw, and synthetic clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metrics as M
from ..operators import sampling as R
from ..operators import synthetic
from ..sources import fixtures as X
from .registry import query


@query()
def q51_hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return R.hash_sample(X.feat(spark, sf), "vec_id", 100).select("vec_id", "label")


def _buckets(spark: SparkSession, sf: str) -> DataFrame:
    return X.clip_src(spark, sf).select(S.aspect_by_nearest(F.col("w"), F.col("h")).alias("bucket"), F.col("item_id").alias("item"))


@query()
def q52_weighted_draw(spark: SparkSession, sf: str) -> DataFrame:
    """How often each bucket is drawn in 10,000 draws, next to its size."""
    sizes = _buckets(spark, sf).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return R.draw_buckets(sizes, 10_000).groupBy("bucket", "n").agg(F.count(F.lit(1)).alias("drawn"))


@query()
def q73_bucket_batches(spark: SparkSession, sf: str) -> DataFrame:
    return R.batches(_buckets(spark, sf), 200, 8)


@query()
def q72_timestep_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return R.timesteps(spark, 10_000)


@query()
def q54_toy_clip_udf(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy of the classifiers on 216 clips made anew."""
    pairs = {k: (F.col(f"pred_{k}"), F.col(k)) for k in ("color", "shape", "move")}
    pairs["pitch"] = (F.col("pred_pitch"), F.when(F.col("move").isin("right", "up"), "up").otherwise("down"))
    return M.accuracy(synthetic.judged(synthetic.clips(spark, 216)), pairs)
