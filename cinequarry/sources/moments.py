"""Moments of feature files that are kept between runs, so the real side of a comparison is
read once and new files are added to it."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import similarity as V

GENERATION = "n bigint, s array<double>, p array<double>, gen string"
FILES = "path string, length bigint, changed timestamp, gen string"


def _present(spark: SparkSession, features: str) -> DataFrame:
    """(path, length, changed) of the files: listed, not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(features)
    return found.select("path", "length", F.col("modificationTime").alias("changed"))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def update(spark: SparkSession, store: str, features: str, vector: str) -> DataFrame:
    """(n, mean, cov): the Gaussian of all vectors in the parquet files under ``features``.

    The store holds, a generation for each update, the sums of the files that were new
    then, and which these were (path, length, time). Files that it knows aren't opened. A file
    that changed or is gone can't be taken back, so the store begins anew in a folder of its own,
    named by what it begins with. Sums are written before the files' names: of an update that was cut
    off, the sums are never read. One update at a time. Without vectors there is no row."""
    present = _present(spark, features)
    epoch = _table(spark, f"{store}/epochs", "epoch string, at timestamp")
    last = epoch.orderBy(F.desc("at"), "epoch").first() if epoch is not None else None
    known = _table(spark, f"{store}/{last.epoch}/files", FILES) if last else None
    whole = ["path", "length", "changed"]
    if known is None or known.join(present, whole, "left_anti").limit(1).count():
        last = spark.range(1).select(F.lit(uuid.uuid4().hex).alias("epoch"), F.current_timestamp().alias("at")).first()
        spark.createDataFrame([last], "epoch string, at timestamp").write.mode("append").parquet(f"{store}/epochs")
        known = None
    path = f"{store}/{last.epoch}"
    new = present if known is None else present.join(known, whole, "left_anti")
    paths = [r.path for r in new.select("path").collect()]
    if paths:
        gen = uuid.uuid4().hex
        rows = spark.read.parquet(*paths).select(F.col(vector).cast("array<double>").alias("v"), F.lit(gen).alias("gen")).where("v is not null")
        V.moments(rows, ["gen"]).select("n", "s", "p", "gen").write.mode("append").parquet(f"{path}/moments")
        seen = spark.createDataFrame([(p, gen) for p in paths], "path string, gen string").join(present, "path")
        seen.select(*whole, "gen").write.mode("append").parquet(f"{path}/files")
    files, sums = _table(spark, f"{path}/files", FILES), _table(spark, f"{path}/moments", GENERATION)
    if files is None or sums is None:
        return spark.createDataFrame([], "n bigint, mean array<double>, cov array<double>")
    held = sums.join(files.select("gen").distinct(), "gen", "left_semi").withColumn("all", F.lit(0))
    return V.of_moments(V.merged(held, ["all"]), ["all"]).drop("all")
