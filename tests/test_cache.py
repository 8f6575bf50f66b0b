import numpy as np
import pytest
from pyspark.sql import functions as F

from cinequarry.functions import scalars as S
from cinequarry.operators import metrics, ordering, sampling, similarity
from cinequarry.sources import cache


def test_cache_round_trip(spark, tmp_path):
    items = spark.createDataFrame([(i, i % 3) for i in range(30)], "item_id long, bucket_id int")
    latents = items.where("item_id < 29").select("item_id", F.array(F.col("item_id") * 1.5).alias("latent"))
    captions = spark.createDataFrame([(i, [f"a{i}", f"b{i}"]) for i in range(20)], "stem long, texts array<string>")
    cache.write_cache(f"{tmp_path}/c", items, latents, captions)
    got = {r.item_id: r for r in cache.read_cache(spark, f"{tmp_path}/c", with_audio=False).collect()}
    assert len(got) == 30 and got[29].latent is None and got[25].caption_count == 0 and got[4].texts == ["a4", "b4"] and got[4].latent == [6.0]
    one = cache.read_cache(spark, f"{tmp_path}/c", bucket=1, with_audio=False)
    assert {r.item_id for r in one.collect()} == set(range(1, 30, 3))
    assert "bucket_id#" in (plan := one._jdf.queryExecution().executedPlan().toString()) and "= 1)]" in plan
    with pytest.raises(Exception, match="exists"):
        cache.write_cache(f"{tmp_path}/c", items, latents, captions)


def test_point_lookup_reads_one_file(spark, tmp_path):
    path = f"{tmp_path}/c"
    items = spark.range(0, 6000, 3).select(F.col("id").alias("item_id"), (F.xxhash64("id") % 2).cast("int").alias("bucket_id"))
    latents = items.select("item_id", F.array(F.col("item_id") * 1.5).alias("latent"))
    captions = spark.createDataFrame([], "stem long, texts array<string>")
    cache.write_cache(path, items, latents, captions)
    spark.read.parquet(f"{path}/latents").repartition(8, "item_id").write.partitionBy("bucket_id").parquet(f"{tmp_path}/d/latents")
    cache.write_zones(spark, f"{tmp_path}/d")
    held = spark.read.parquet(f"{tmp_path}/d/latents")
    files = {r.item_id: r.file for r in held.select("item_id", F.col("_metadata.file_path").alias("file")).collect()}
    assert len(set(files.values())) > 10
    keys = list(range(0, 6000, 60))
    told = [(r.item_id, r.file) for r in cache.files_of(spark, f"{tmp_path}/d", keys + [1, 2, 7001]).collect()]
    assert {(k, files[k]) for k in keys} <= set(told) and len(told) <= 1.2 * len(keys)
    found = cache.look_up(spark, f"{tmp_path}/d", [300])
    assert [r.latent for r in found.collect()] == [[450.0]] and len(found.inputFiles()) <= 2
    for absent in ([301], [300, 9000]):
        with pytest.raises(LookupError, match=str(absent[-1])):
            cache.look_up(spark, f"{tmp_path}/d", absent)


def test_low_rank_distance(spark):
    rng = np.random.default_rng(0)
    real, video = rng.normal(size=(500, 16)), rng.normal(0.3, 1.4, size=(12, 16))
    mean, cov = real.mean(axis=0), np.cov(real.T)
    want = similarity.frechet(video.mean(axis=0), np.cov(video.T), mean, cov)
    assert abs(similarity.frechet_low_rank(mean, cov, video) - want) < 1e-6
    assert similarity.frechet_low_rank(mean, cov, video[:1]) > 0


def test_places_and_medians_of_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", float(i * 37 % 101), i) for i in range(600)]
    df = spark.createDataFrame(rows + [("none", None, 600)], "k string, x double, i long").repartition(5)
    got = {r.i: r.place for r in ordering.places_within(df.where("x is not null"), ["k"], ["x", "i"], "place").collect()}
    for key in {k for k, *_ in rows}:
        own = sorted((x, i) for k, x, i in rows if k == key)
        assert [got[i] for _, i in own] == list(range(len(own)))
    for upper in (False, True):
        told = {r.k: r.middle for r in ordering.middle_values(df, "k", "x", upper).collect()}
        for key in {k for k, *_ in rows}:
            own = sorted(x for k, x, _ in rows if k == key)
            assert told[key] == (own[len(own) // 2] if upper else np.median(own))
        assert "none" not in told


def test_draws(spark):
    df = spark.range(3000).select(F.col("id"), sampling.draw_caption(F.array(*map(F.lit, "abc")), F.col("id"), 1).alias("c"), sampling.draw_caption(F.array().cast("array<string>"), F.col("id")).alias("none"))
    counts = {r.c: r["count"] for r in df.groupBy("c").count().collect()}
    assert set(counts) == set("abc") and min(counts.values()) > 900 and df.where("none is not null").count() == 0


def test_folded_case(spark):
    rows = ["  Straße\tSTRASSE ", "ΣΊΣΥΦΟΣ σίσυφος", "ſo So"]
    df = spark.createDataFrame([(x,) for x in rows], "t string").select("t", S.normalize_caption(F.col("t")).alias("n"))
    assert all(r.n == " ".join(r.t.casefold().split()) for r in df.collect())


def test_a_metric_that_fails_is_left_out():
    with pytest.warns(UserWarning, match="clip is left out: no model"):
        assert metrics.available({"fid": lambda: 1.5, "clip": lambda: (_ for _ in ()).throw(RuntimeError("no model"))}) == {"fid": 1.5}
