"""The npz data source: round trips, only whole writes, one entry of a file at a time."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cinequarry.sources import manifest, npz


def rows(spark, n, start=0):
    df = spark.range(start, start + n, numPartitions=4)
    frames = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: (i * F.col("id")).cast("double"))
    sound = F.when(F.col("id") % 2 == 0, F.array(F.col("id").cast("double")))
    return df.select(F.format_string("%05d", "id").alias("name"), npz.array_of(frames, F.array(F.lit(2), F.lit(3))).alias("frames"), npz.array_of(sound, F.array(F.lit(1))).alias("audio"))


def files(path):
    return sorted(p.name for p in Path(path).rglob("*.npz"))


def test_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/clips"
    npz.write_arrays(rows(spark, 20), path)
    assert files(tmp_path) == [f"{i:05d}.npz" for i in range(20)]
    got = {r.name: r for r in npz.read_array(spark, path, "frames").collect()}
    assert len(got) == 20
    for i in range(20):
        r = got[f"{i:05d}.npz"]
        assert r.kind == "<f8" and r.shape == [2, 3] and np.frombuffer(r.data).tolist() == [i * k for k in range(1, 7)]
    audio = npz.read_array(spark, path, "audio").select("name", npz.values_of(F.col("data")).alias("v"))
    assert sorted(map(tuple, audio.collect())) == [(f"{i:05d}.npz", [float(i)]) for i in range(0, 20, 2)]
    assert npz.read_array(spark, path, "none").count() == 0
    one = next(Path(tmp_path).rglob("00003.npz"))
    with np.load(one) as z:  # any reader of npz files can open them
        assert z["frames"].shape == (2, 3) and z.files == ["frames"]
    old = manifest.read_arrays(spark, f"{path}/part-*/*.npz", "frames")
    assert sorted(bytes(r.data) for r in old.collect()) == sorted(bytes(r.data) for r in got.values())


def test_modes(spark, tmp_path):
    path = f"file://{tmp_path}/clips"
    npz.write_arrays(rows(spark, 3), path)
    npz.write_arrays(rows(spark, 2, start=10), path)
    assert files(tmp_path) == ["00000.npz", "00001.npz", "00002.npz", "00010.npz", "00011.npz"]
    npz.write_arrays(rows(spark, 2, start=20), path, mode="overwrite")
    assert files(tmp_path) == ["00020.npz", "00021.npz"]


def test_failing_task_leaves_no_file(spark, tmp_path):
    path = f"file://{tmp_path}/clips"
    npz.write_arrays(rows(spark, 2), path)
    bad = rows(spark, 20, start=5).withColumn("name", F.when(F.col("name") == "00024", F.lit("a/b")).otherwise(F.col("name")))
    with pytest.raises(PySparkException):
        npz.write_arrays(bad, path)
    assert files(tmp_path) == ["00000.npz", "00001.npz"]
    assert [p.name for p in (tmp_path / "clips").iterdir() if p.name.startswith("_writing")] == []
    with pytest.raises(PySparkException):  # equal names in a task
        npz.write_arrays(rows(spark, 2).withColumn("name", F.lit("x")).coalesce(1), path)
    assert files(tmp_path) == ["00000.npz", "00001.npz"]


def test_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/clips"
    npz.write_arrays(rows(spark, 9), path)
    spark.dataSource.register(npz.NpzSource)
    load = lambda n: spark.read.format("npz").option("key", "frames").option("partitionBytes", n).load(path)
    assert load(0).rdd.getNumPartitions() == 9 and load(1 << 20).rdd.getNumPartitions() == 1
    assert load(0).count() == load(1000).count() == load(1 << 20).count() == 9
    with pytest.raises(PySparkException):
        spark.read.format("npz").load(path).count()
    (tmp_path / "empty").mkdir()
    assert npz.read_array(spark, f"file://{tmp_path}/empty", "frames").count() == 0
