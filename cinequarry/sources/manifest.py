"""Clip manifests as JSON lines, caption files as one JSON object, and media arrays in npz files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A manifest row; columns that a writer lacks are null.
MANIFEST = """item_id long, file_name string, text string, texts array<string>, source string, duration double, bucket string, split string,
  window int, start double, anchor_train_source string, anchor_train_text string, clip_similarity double"""
CAPTION_FIELDS = ("audio_visual_captions", "GPT_AV_captions", "visual_captions", "audio_captions")


def to_lines(rows: DataFrame) -> DataFrame:
    """(line): one JSON object a row, null columns left out."""
    return rows.select(F.to_json(F.struct("*")).alias("line"))


def parse_lines(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("line", MANIFEST).alias("r")).select("r.*")


def write_manifest(rows: DataFrame, path: str) -> None:
    """JSON lines in order of item_id within and across files; fails if ``path`` exists."""
    to_lines(rows.repartitionByRange("item_id").sortWithinPartitions("item_id")).write.mode("errorifexists").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines are skipped."""
    return parse_lines(spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "line"))


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """(stem, field, pos, caption) of a caption file: fields absent or null have no rows."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,array<string>>>").alias("m"))
    by_stem = whole.select(F.explode("m").alias("stem", "fields"))
    by_field = by_stem.select("stem", F.posexplode(F.transform(F.array(*map(F.lit, CAPTION_FIELDS)), lambda k: F.try_element_at("fields", k))).alias("field", "captions"))
    return by_field.select("stem", "field", F.posexplode("captions").alias("pos", "caption"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length), sorted; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path")


def write_buckets(rows: DataFrame, path: str, bucket: str = "bucket_id") -> None:
    rows.write.mode("errorifexists").partitionBy(bucket).parquet(path)


def read_arrays(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(path, kind, shape, data) of one array of each npz file; only its entry is unpacked.
    Files without the array give no row."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    if f"{key}.npy" not in z.namelist():
                        continue
                    array = np.lib.format.read_array(io.BytesIO(z.read(f"{key}.npy")), allow_pickle=False)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([array.dtype.str]), pa.array([list(array.shape)], pa.list_(pa.int64())), pa.array([array.tobytes()], pa.binary())], names=["path", "kind", "shape", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, kind string, shape array<bigint>, data binary")
