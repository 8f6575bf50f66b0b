import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinequarry.functions import scalars as S
from cinequarry.operators import curation, metrics, ordering, packing, sampling, similarity


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_window_starts(spark):
    assert one(spark, S.window_starts(F.lit(20.1), 20.0, 20.0, 6)) == []
    assert one(spark, S.window_starts(F.lit(20.2), 5.0, 5.0, 6)) == [0.0, 5.0, 10.0, 15.0]


def test_scalars(spark):
    assert [one(spark, S.band(F.lit(t))) for t in (0.0, 0.125, 1.0)] == [0, 1, 7]
    assert one(spark, S.aspect_by_threshold(F.lit(0.9), F.lit(1.0))) == "288x512"
    assert one(spark, S.aspect_by_nearest(F.lit(0.9), F.lit(1.0))) == "512x384"
    assert one(spark, S.collect_captions(F.array(F.lit(" b "), F.lit("a")), F.lit(None).cast("array<string>"), F.array(F.lit("b"), F.lit("")))) == ["b", "a"]
    assert one(spark, S.blind_error(F.lit(0.5))) == 2.0
    assert [one(spark, S.parse_aspect(F.lit(x))) for x in ("16:9", "1.78", "x", "3:0")] == [16 / 9, 1.78, None, None]
    assert one(spark, S.stem(F.lit("a/b.c/d.tar.gz"))) == "d.tar"
    assert one(spark, S.timeshift(F.lit(0.25), 1.0)) == 0.25


def test_dense_ids_and_sums(spark):
    rows = [(f"k{i:04d}", i % 7) for i in random.Random(0).sample(range(5000), 3000)]
    df = spark.createDataFrame(rows, "k string, n int").repartition(7)
    got = ordering.exclusive_sum(ordering.dense_ids(df, ["k"], "id"), ["k"], "n", "before").orderBy("k").collect()
    assert [r.id for r in got] == list(range(3000))
    assert [r.before for r in got] == [0, *np.cumsum([r.n for r in got])[:-1].tolist()]
    assert ordering.dense_ids(df.where("n > 99"), ["k"], "id").count() == 0


def test_first_fit(spark):
    df = spark.createDataFrame([(1, 6), (2, 5), (3, 4), (4, 3)], "k long, n long")
    assert packing.first_fit(df, "k", "n", 10, 64) == [(1, 6), (3, 4)]
    rng = random.Random(2)
    items = [(i, rng.randint(1, 400)) for i in range(500)]
    df = spark.createDataFrame(items, "k long, n long")
    for tokens, most in ((1000, 64), (5000, 8), (300, 1)):
        want, room = [], tokens
        for k, n in items:
            if n <= room and len(want) < most:
                want.append((k, n))
                room -= n
        assert packing.first_fit(df, "k", "n", tokens, most) == want
    assert packing.first_fit(df.where("k < 0"), "k", "n", 10, 10) == []


def test_layouts(spark):
    columns = "layout string, frames long, rows long, columns long, audio long, patch int, patch_t int"
    layouts = packing.with_tokens(spark.createDataFrame([("a", 5, 8, 12, 11, 2, 2), ("b", 1, 8, 12, 0, 2, 1)], columns))
    assert [tuple(r) for r in layouts.select("layout", "times", "cells", "seq_len").orderBy("layout").collect()] == [("a", 3, 24, 83), ("b", 1, 24, 24)]
    ids = packing.position_ids(layouts.where("layout = 'a'"), 4).orderBy("pos").collect()
    assert len(ids) == 87 and (ids[71].t, ids[71].h, ids[71].w) == (2.0, 3.0, 5.0) and ids[-1].modality == packing.TEXT
    assert (ids[72].t, ids[72].h) == (0.0, -1.0) and ids[83].t == max(2.0, 10 * 3 / 11) + 1
    assert [r.t for r in packing.position_ids(layouts.where("layout = 'b'"), 2).orderBy("pos").collect()][-2:] == [1.0, 2.0]
    assert tuple(packing.budget(layouts, 4).first()) == (332, 14)


def test_masked_and_macro_means(spark):
    df = spark.createDataFrame([(1, 2.0, True), (1, 4.0, True), (2, 9.0, True), (3, 5.0, False)], "s int, e double, m boolean")
    assert df.agg(metrics.masked_mean(F.col("e"), F.col("m"))).first()[0] == 5.0
    assert df.agg(metrics.masked_mean(F.col("e"), F.lit(False))).first()[0] == 0.0
    assert tuple(metrics.macro_mean(df, ["s"], F.col("e"), F.col("m")).first()) == (6.0, 2)
    assert df.agg(metrics.upper_median(F.col("e"))).first()[0] == 5.0


def test_gaussian_and_frechet(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 6)), rng.normal(1, 2, size=(200, 6))
    rows = [("x", v.tolist()) for v in x] + [("y", v.tolist()) for v in y] + [("one", x[0].tolist())]
    g = {r.g: r for r in similarity.gaussian(spark.createDataFrame(rows, "g string, v array<double>").repartition(9), ["g"]).collect()}
    assert np.allclose(np.array(g["x"].cov).reshape(6, 6), np.cov(x.T)) and np.allclose(g["y"].mean, y.mean(axis=0))
    assert not np.any(g["one"].cov)
    a, b = np.cov(x.T), np.cov(y.T)
    values = np.linalg.eigvals(a @ b)
    want = ((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(a) + np.trace(b) - 2 * np.sqrt(values.real.clip(0)).sum()
    assert abs(similarity.frechet(np.array(g["x"].mean), np.array(g["x"].cov), np.array(g["y"].mean), np.array(g["y"].cov)) - want) < 1e-8


def test_cover_sizes(spark):
    rows = [(i, i / 10, 100, 90) for i in range(20)] + [(50, 9.0, 80, 100), (51, 8.0, 200, 100), (52, 10.0, 200, 100)]
    df = spark.createDataFrame(rows, "item_id long, duration double, w int, h int")
    got = [(r.item_id, r["size"]) for r in curation.cover_sizes(df, 4).collect()]
    assert got == [(0, "512x384"), (1, "512x384"), (51, "512x288"), (50, "288x512")]
    with pytest.raises(ValueError):
        curation.cover_sizes(df, 2)


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 3).alias("bucket"))
    a = sorted(r.id for r in sampling.hash_sample(df, "id", 50, 3).collect())
    assert a == sorted(r.id for r in sampling.hash_sample(df.repartition(13), "id", 50, 3).collect()) and len(a) == 50
    sizes = spark.createDataFrame([("a", 900), ("b", 100)], "bucket string, n long")
    drawn = {r.bucket: r["count"] for r in sampling.draw_buckets(sizes, 5000).groupBy("bucket").count().collect()}
    assert 4350 < drawn["a"] < 4650
    got = sampling.batches(df.select("bucket", F.col("id").alias("item")), 30, 4)
    assert got.count() == 120 and got.groupBy("batch").agg(F.count_distinct("bucket").alias("n")).where("n > 1").count() == 0
    assert got.where("item % 3 <> bucket").count() == 0
    t = sampling.timesteps(spark, 4000).agg(F.min("t"), F.max("t"), F.avg((F.col("t") == 1).cast("double")), F.avg(F.col("kept").cast("double")), F.min(F.col("t2") - F.col("t"))).first()
    assert 0 <= t[0] and t[1] == 1 and 0.03 < t[2] < 0.07 and 0.88 < t[3] < 0.92 and t[4] >= 0


def test_window_table_function(spark):
    from cinequarry.functions import udtf

    udtf.install(spark)
    rows = spark.sql("SELECT d, start FROM VALUES (20.1D), (20.2D), (7.0D), (CAST(NULL AS DOUBLE)) AS t(d), LATERAL clip_windows(d, 5.0D, 5.0D, 6) ORDER BY d, start").collect()
    assert [tuple(r) for r in rows] == [(7.0, 0.0), *[(d, s) for d in (20.1, 20.2) for s in (0.0, 5.0, 10.0, 15.0) if d > 20.15 or s < 15.0]]


def test_config(tmp_path):
    from cinequarry import config

    (tmp_path / "c.json").write_text('{"a": {"b": 2}}')
    got = config.load(str(tmp_path / "c.json"), {"a": {"b": 1, "c": 3}, "d": "x"}, ("a.c=[1, 2]", "e.f.g=text", "d=null"))
    assert got == {"a": {"b": 2, "c": [1, 2]}, "d": None, "e": {"f": {"g": "text"}}}
    for bad in ("a", "=1", "a..b=1", "d.x=1"):
        with pytest.raises(ValueError):
            config.override({"d": "x"}, bad)


def test_balanced_matrix(spark):
    x = np.random.default_rng(3).normal(size=(40, 5))
    rows = [(i, r.tolist(), "x") for i, r in enumerate(x)] + [(90, None, "x"), (91, [1.0], "x"), (92, [float("nan")] * 5, "x")]
    df = spark.createDataFrame(rows, "i long, v array<double>, last string").repartition(3)
    for rounds in (1, 3):
        want = np.exp(x)
        for _ in range(rounds):
            want = want / want.sum(axis=1, keepdims=True)
            want = want * 8 / want.sum(axis=0)
        got = {r.i: r.v for r in similarity.balance(df, "v", rounds).collect()}
        assert sorted(got) == list(range(40)) and np.allclose([got[i] for i in range(40)], want)
    done = np.array([r.v for r in similarity.balance(df, "v", 100, 1e-9).collect()])
    assert np.allclose(done.sum(axis=0), 8) and np.allclose(done.sum(axis=1), 1)
    assert similarity.balance(df.where("i < 0"), "v").count() == 0
