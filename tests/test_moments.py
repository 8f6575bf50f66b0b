"""The store of moments: what it knows isn't read again, what is new is added, what changed begins anew."""

import os
from pathlib import Path

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from cinequarry.operators import similarity as V
from cinequarry.sources import fixtures as X
from cinequarry.sources import moments


def numbers(df):
    r = df.first()
    return r.n, np.array(r.mean), np.array(r.cov)


def same(a, b):
    return a[0] == b[0] and np.allclose(a[1], b[1], atol=1e-12) and np.allclose(a[2], b[2], atol=1e-10)


def test_updates(spark, tmp_path):
    f = X.feat(spark, SF)
    files, store = f"file://{tmp_path}/features", f"file://{tmp_path}/store"
    whole = lambda rows: numbers(V.gaussian(rows.withColumn("all", F.lit(0)), ["all"]))
    put = lambda rows: rows.select("v").repartition(2).write.mode("append").parquet(files)

    put(f.where("label < 5"))
    assert same(numbers(moments.update(spark, store, files, "v")), whole(f.where("label < 5")))

    for p in Path(tmp_path, "features").glob("*.parquet"):  # no byte of a known file is looked at
        told = p.stat()
        p.write_bytes(b"x" * told.st_size)
        os.utime(p, ns=(told.st_atime_ns, told.st_mtime_ns))
    assert same(numbers(moments.update(spark, store, files, "v")), whole(f.where("label < 5")))
    put(f.where("label >= 5"))
    assert same(numbers(moments.update(spark, store, files, "v")), whole(f))

    for p in list(Path(tmp_path, "features").glob("*.parquet")):
        if p.read_bytes()[:1] == b"x":
            p.unlink()
    assert same(numbers(moments.update(spark, store, files, "v")), whole(f.where("label >= 5")))


def test_no_vectors(spark, tmp_path):
    files, store = f"file://{tmp_path}/features", f"file://{tmp_path}/store"
    spark.createDataFrame([(None,)], "v array<double>").write.parquet(files)
    assert moments.update(spark, store, files, "v").count() == 0
    spark.createDataFrame([([1.0, 2.0],)], "v array<double>").write.mode("append").parquet(files)
    n, mean, cov = numbers(moments.update(spark, store, files, "v"))
    assert n == 1 and mean.tolist() == [1.0, 2.0] and not cov.any()
