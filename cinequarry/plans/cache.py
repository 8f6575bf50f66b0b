"""Queries on the feature cache, split manifests, draws from them and what is asked of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import curation as C
from ..operators import packing as P
from ..operators import sampling as R
from ..operators import similarity as V
from ..operators.ordering import places_within
from ..sources import cache, moments, npz
from ..sources import fixtures as X
from ..sources.shared import new_path
from .curation import BUCKETS, CAPTIONS, NEAREST
from .packing import BINS, TEXT_LEN, UNIFORM, bins
from .registry import query

SPLIT = "CASE WHEN item_id % 10 = 0 THEN 'test' ELSE 'train' END"
PRIMARY = "512x384"


@query(f"""WITH {X.CLIP_SRC}, {BUCKETS}, h AS (SELECT {SPLIT} AS split, bucket, count(*) AS n FROM bucketed GROUP BY 1, 2),
  t AS (SELECT split, '{{' || string_agg('"' || bucket || '":' || n, ',' ORDER BY bucket) || '}}' AS histogram, sum(n)::BIGINT AS n FROM h GROUP BY split)
  SELECT 7::BIGINT AS seed, max(histogram) FILTER (split = 'train') AS train_histogram, max(histogram) FILTER (split = 'test') AS test_histogram, max(n) FILTER (split = 'train') AS n_train, max(n) FILTER (split = 'test') AS n_test FROM t""")
def q77_split_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A split's manifest, written and read back: seed and both histograms; the item lists are
    tables beside it, counted here."""
    clips = C.assign_buckets(X.clip_src(spark, sf).drop("text")).withColumn("split", F.when(F.col("item_id") % 10 == 0, "test").otherwise("train"))
    by = clips.groupBy("split", "bucket").agg(F.count(F.lit(1)).alias("n"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "n"))), lambda x: F.concat(F.lit('"'), x["bucket"], F.lit('":'), x["n"].cast("string")))
    halves = by.groupBy("split").agg(F.concat(F.lit("{"), F.array_join(told, ","), F.lit("}")).alias("histogram"))
    header = halves.agg(*[F.max(F.when(F.col("split") == x, F.col("histogram"))).alias(f"{x}_histogram") for x in ("train", "test")]).withColumn("seed", F.lit(7).cast("long"))
    path = new_path(spark, "split")
    cache.write_split(path, header, clips.select("split", S.clip_name(F.col("item_id")).alias("file_name"), "item_id", "source", "duration", "bucket"))
    items = spark.read.schema("file_name string, item_id long, split string").json(f"{path}/items")
    counts = items.agg(*[F.count_if(F.col("split") == x).alias(f"n_{x}") for x in ("train", "test")])
    return spark.read.schema("seed long, train_histogram string, test_histogram string").json(f"{path}/header").join(F.broadcast(counts))  # one row each


@query(f"""WITH {X.CLIP_SRC}, {BUCKETS}, {CAPTIONS} SELECT item_id, bucket, coalesce(len(v), 0)::BIGINT AS latent_len, round(list_sum(v), 6) AS latent_sum, coalesce(len(texts), 0)::BIGINT AS captions, texts[1] AS primary_caption, CASE WHEN item_id % 2 = 0 THEN round(list_sum(v[1:8]), 6) END AS audio_sum
  FROM bucketed LEFT JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) ON vec_id = item_id LEFT JOIN clip_captions ON stem = item_id""")
def q78_feature_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Latents by bucket, index, texts and audio: written as tables, then joined by the loader."""
    items = C.assign_buckets(X.clip_src(spark, sf).drop("text")).select("item_id", F.col("bucket").alias("bucket_id"))
    latents = X.feat(spark, sf).select(F.col("vec_id").alias("item_id"), F.col("v").alias("latent"))
    audio = latents.where("item_id % 2 = 0").select("item_id", F.slice("latent", 1, 8).alias("audio"))
    path = new_path(spark, "feature-cache")
    cache.write_cache(path, items, latents, C.captions_by_clip(X.caption_fields(spark, sf)), audio)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)
    df = cache.read_cache(spark, path)
    length = F.coalesce(F.array_size("latent"), F.lit(0)).cast("long")
    return df.select("item_id", F.col("bucket_id").alias("bucket"), length.alias("latent_len"), total("latent").alias("latent_sum"), F.col("caption_count").cast("long").alias("captions"), F.get("texts", F.lit(0)).alias("primary_caption"), total("audio").alias("audio_sum"))


@query(f"""WITH {CAPTIONS} SELECT stem, texts[floor({UNIFORM.format(seed=3, key="stem")} * len(texts))::BIGINT + 1] AS caption, len(texts)::BIGINT AS n FROM clip_captions""")
def q79_caption_draw(spark: SparkSession, sf: str) -> DataFrame:
    df = C.captions_by_clip(X.caption_fields(spark, sf))
    return df.select("stem", R.draw_caption(F.col("texts"), F.col("stem"), seed=3).alias("caption"), F.size("texts").cast("long").alias("n"))


@query(f"""WITH {X.CLIP_SRC}, p AS (SELECT item_id AS item, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS n FROM clip_src WHERE {NEAREST} = '{PRIMARY}'),
  d AS (SELECT i AS draw, floor({UNIFORM.format(seed=5, key="i")} * (SELECT max(n) FROM p))::BIGINT AS place FROM range(500) r(i)) SELECT draw, item FROM d JOIN p USING (place)""")
def q80_primary_bucket_draw(spark: SparkSession, sf: str) -> DataFrame:
    members = X.clip_src(spark, sf).select(S.aspect_by_nearest(F.col("w"), F.col("h")).alias("bucket"), F.col("item_id").alias("item"))
    return R.draw_from_primary(members, F.lit(PRIMARY), 500, seed=5)


FRAMES_PER_CLIP = 12


@query(f"""WITH {X.FEAT}, f AS (SELECT vec_id // {FRAMES_PER_CLIP} AS clip, vec_id % {FRAMES_PER_CLIP} AS frame, v FROM feat), n AS (SELECT clip, count(*) AS n FROM f GROUP BY clip),
  k AS (SELECT DISTINCT clip, round_even(j * (n - 1) / (least(n, 8) - 1)::DOUBLE, 0)::BIGINT AS frame FROM n, range(8) t(j) WHERE j < least(n, 8)),
  s AS (SELECT f.clip, list_dot_product(f.v, c.v) / sqrt(list_dot_product(f.v, f.v)) / sqrt(list_dot_product(c.v, c.v)) AS cosine FROM f JOIN k USING (clip, frame) JOIN feat c ON c.vec_id = f.clip)
  SELECT clip, count(*) AS frames, round(avg(cosine) * 100, 4) AS score FROM s GROUP BY clip""")
def q81_frame_caption_score(spark: SparkSession, sf: str) -> DataFrame:
    """Mean cosine of a clip's eight even frames with its caption, times 100."""
    f = X.feat(spark, sf).select(F.floor(F.col("vec_id") / FRAMES_PER_CLIP).alias("clip"), (F.col("vec_id") % FRAMES_PER_CLIP).alias("frame"), "v")
    n = F.least(F.col("n"), F.lit(8))
    wanted = f.groupBy("clip").agg(F.count(F.lit(1)).alias("n")).select("clip", F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda j: F.coalesce(F.bround(F.try_divide(j * (F.col("n") - 1), n - 1)).cast("long"), F.lit(0)))).alias("wanted"))
    captions = X.feat(spark, sf).select(F.col("vec_id").alias("clip"), F.col("v").alias("c"))
    unit = lambda x: F.sqrt(S.dot(F.col(x), F.col(x)))
    picked = f.join(wanted, "clip").where(F.array_contains("wanted", F.col("frame"))).join(captions, "clip")
    return picked.groupBy("clip").agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg(S.dot(F.col("v"), F.col("c")) / unit("v") / unit("c")) * 100, 4).alias("score"))


TRAINED = [("10s_512x384", 61, 512, 384), ("10s_512x288", 61, 512, 288), ("10s_288x512", 61, 288, 512), ("20s_512x384", 121, 512, 384), ("20s_512x288", 121, 512, 288)]


@query(f"""WITH {X.CLIP_SRC}, t AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{n}', {t}, {w}::DOUBLE / {h})" for i, (n, t, w, h) in enumerate(TRAINED))}) t(place, name, frames, ratio)),
  far AS (SELECT item_id, arg_min(t, row(round(abs(ln(t.ratio / (w::DOUBLE / h))), 6), abs(frames - CASE WHEN duration > 15 THEN 121 ELSE 61 END), place)) AS t FROM clip_src, t GROUP BY item_id)
  SELECT item_id, t.name AS bucket, t.frames::BIGINT AS frames, round_even(157 * (t.frames - 1) / 60.0::DOUBLE, 0)::BIGINT AS audio_len FROM far""")
def q82_snap_to_bucket(spark: SparkSession, sf: str) -> DataFrame:
    """The trained bucket nearest to each wanted shape, and its audio length."""
    hit = S.snap_to_bucket(F.col("w") / F.col("h"), F.when(F.col("duration") > 15, 121).otherwise(61), TRAINED)
    df = X.clip_src(spark, sf).select("item_id", hit.alias("b"))
    return df.select("item_id", F.col("b.name").alias("bucket"), F.col("b.frames").cast("long").alias("frames"), S.audio_length(157, F.col("b.frames"), 61).alias("audio_len"))


#: Names looked for, in order, and what they stand for.
CONTAINED = {"ECONOMY": 2250.0, "STANDARD": 989.0, "PROMO": 312.0, "O": 1.0}


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN contains(p_type, '{k}') THEN {v}::DOUBLE" for k, v in CONTAINED.items()) + " END AS peak FROM part")
def q83_first_contained(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "part").select("p_partkey", S.first_contained(F.col("p_type"), CONTAINED).alias("peak"))


@query(f"WITH {CAPTIONS} SELECT max(len(texts))::BIGINT AS width, round(avg(len(texts)), 6) AS mean_captions, count(*) AS items FROM clip_captions")
def q84_caption_width(spark: SparkSession, sf: str) -> DataFrame:
    """Most captions of an item, to which the others are padded, and their mean."""
    n = F.size("texts").cast("long")
    return C.captions_by_clip(X.caption_fields(spark, sf)).agg(F.max(n).alias("width"), F.round(F.avg(n), 6).alias("mean_captions"), F.count(F.lit(1)).alias("items"))


MOST_SLOTS = 64


@query(f"""WITH {BINS}, b AS (SELECT bin, max(joint_off + seq_len + {TEXT_LEN}) AS used, count(*) AS n, list(joint_off ORDER BY slot) AS offs, list(joint_off - x_off ORDER BY slot) AS shifts, list(joint_off + seq_len ORDER BY slot) AS texts FROM placed GROUP BY bin)
  SELECT bin, used, array_to_string(list_concat(offs, list_transform(range({MOST_SLOTS + 1} - n), lambda i: used)), ' ') AS bounds, array_to_string(shifts, ' ') AS x_shifts, array_to_string(texts, ' ') AS text_at FROM b""")
def q85_pack_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of a bin's segments, padded to a fixed width, and the way back from the joint order."""
    plan = P.pack_plan(P.with_offsets(bins(spark, sf), TEXT_LEN), MOST_SLOTS, TEXT_LEN)
    joined = lambda c: F.array_join(c.cast("array<string>"), " ")
    return plan.select("bin", "used", joined(F.col("bounds")).alias("bounds"), joined(F.col("inverse.x_shift")).alias("x_shifts"), joined(F.col("inverse.text_at")).alias("text_at"))


@query()
def q86_video_frechet(spark: SparkSession, sf: str) -> DataFrame:
    """Mean distance of the videos (twelve frames each) to all frames, by the low-rank identity."""
    f = X.feat(spark, sf).select(F.floor(F.col("vec_id") / FRAMES_PER_CLIP).alias("video"), "v")
    real = V.gaussian(f.select("v", F.lit(0).alias("all")), ["all"])
    return V.video_distances(f, real, "video").agg(F.count(F.lit(1)).alias("videos"), F.round(F.avg("distance"), 6).alias("mean_distance"))


@query("""WITH e AS (SELECT p_brand, arg_min(p_size, p_partkey) AS x0, arg_max(p_size, p_partkey) AS x1, arg_min(p_partkey % 50, p_partkey) AS y0, arg_max(p_partkey % 50, p_partkey) AS y1 FROM part GROUP BY p_brand)
  SELECT p_brand, (x1 - x0)::BIGINT AS dx, (y1 - y0)::BIGINT AS dy, CASE WHEN abs(x1 - x0) > abs(y1 - y0) THEN CASE WHEN x1 > x0 THEN 'right' ELSE 'left' END WHEN y1 > y0 THEN 'down' ELSE 'up' END AS direction FROM e""")
def q87_motion_direction(spark: SparkSession, sf: str) -> DataFrame:
    """Direction of a blob from its first and last place."""
    at = F.struct("p_partkey", F.col("p_size").cast("long").alias("x"), (F.col("p_partkey") % 50).alias("y"))
    ends = X.table(spark, sf, "part").groupBy("p_brand").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    ends = ends.select("p_brand", (F.col("b.x") - F.col("a.x")).alias("dx"), (F.col("b.y") - F.col("a.y")).alias("dy"))
    return ends.select("p_brand", "dx", "dy", S.motion(F.col("dx"), F.col("dy")).alias("direction"))


@query(f"""WITH {X.FEAT} SELECT vec_id, list_transform(v[1:4], lambda x: floor((greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x * 4)) + 1) * 127.5::DOUBLE)::BIGINT)::VARCHAR AS pixels, round(round_even(v[1] * 32767, 0) / 32767.0::DOUBLE, 9) AS sound, round((v[2] - 0.5::DOUBLE) / 0.25::DOUBLE * 0.25::DOUBLE + 0.5::DOUBLE, 9) AS level, round(list_sum(list_transform(v, lambda x, i: x * i)), 6) AS grid FROM feat""")
def q88_ways_back(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels, sound, standardised values and patches, there and back."""
    v = F.col("v")
    pixels = F.transform(F.slice(v, 1, 4), lambda x: S.to_pixel_bytes(x * 4))
    level = S.destandardize((v[1] - 0.5) / 0.25, F.lit(0.5), F.lit(0.25))
    grid = P.unpatch(P.patches(v, 4, 4, 4, 2), 4, 4, 4, 2)
    digest = F.aggregate(F.transform(grid, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    text = F.concat(F.lit("["), F.array_join(pixels.cast("array<string>"), ", "), F.lit("]"))
    return X.feat(spark, sf).select("vec_id", text.alias("pixels"), F.round(S.from_pcm(F.bround(v[0] * 32767)), 9).alias("sound"), F.round(level, 9).alias("level"), F.round(digest, 6).alias("grid"))


@query(f"""WITH {X.CLIP_SRC} SELECT {NEAREST} AS size, row_number() OVER (PARTITION BY {NEAREST} ORDER BY duration, source, w, h, item_id) - 1 AS place, item_id FROM clip_src""")
def q89_ordered_members(spark: SparkSession, sf: str) -> DataFrame:
    """Members of each size in order of (duration, source, width, height): a row for each."""
    clips = X.clip_src(spark, sf).withColumn("size", S.aspect_by_nearest(F.col("w"), F.col("h"))).drop("text")
    return places_within(clips, ["size"], ["duration", "source", "w", "h", "item_id"], "place").select("size", "place", "item_id")


@query(f"""WITH {X.FEAT} SELECT printf('%05d.npz', vec_id // {FRAMES_PER_CLIP}) AS name, count(*) AS frames, round(sum(list_sum(v)), 6) AS total, round(arg_max(v[1], vec_id), 9) AS last_first FROM feat GROUP BY vec_id // {FRAMES_PER_CLIP}""")
def q91_array_files(spark: SparkSession, sf: str) -> DataFrame:
    """A file of arrays for each clip (twelve frames), written and read back by the data source."""
    clips = X.feat(spark, sf).groupBy(F.floor(F.col("vec_id") / FRAMES_PER_CLIP).alias("clip")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("r"))
    flat = clips.select("clip", F.flatten("r.v").alias("values"), F.array(F.size("r"), F.size(F.get("r.v", F.lit(0)))).alias("shape"))
    path = new_path(spark, "clips")
    npz.write_arrays(flat.select(S.clip_name(F.col("clip")).alias("name"), npz.array_of(F.col("values"), F.col("shape")).alias("frames")), path)
    back = npz.read_array(spark, path, "frames").select("name", "shape", npz.values_of(F.col("data")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    last = F.get("v", ((F.col("shape")[0] - 1) * F.col("shape")[1]).cast("int"))
    return back.select("name", F.col("shape")[0].alias("frames"), F.round(total, 6).alias("total"), F.round(last, 9).alias("last_first"))


@query(f"""WITH {X.FEAT}, x AS (SELECT label::BIGINT AS label, v[1] AS a, v[2] AS b FROM feat) SELECT label, n, mean_a, mean_b, c_aa, c_ab, c_bb FROM (SELECT max(label) AS label, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(var_samp(a), 6) AS c_aa, round(covar_samp(a, b), 6) AS c_ab, round(var_samp(b), 6) AS c_bb FROM x)""")
def q94_moment_store(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and covariance of features that arrive in two parts: the second update opens the new files alone."""
    f = X.feat(spark, sf).select("label", F.slice("v", 1, 2).alias("v"))
    files, store = new_path(spark, "features"), new_path(spark, "moments")
    for part in ("label % 2 = 0", "label % 2 <> 0 or label is null"):
        f.where(part).write.mode("append").parquet(files)
        g = moments.update(spark, store, files, "v")
    last = f.agg(F.max("label").cast("long").alias("label"))
    cells = {"mean_a": F.col("mean")[0], "mean_b": F.col("mean")[1], "c_aa": F.col("cov")[0], "c_ab": F.col("cov")[1], "c_bb": F.col("cov")[3]}
    return last.join(F.broadcast(g)).select("label", "n", *[F.round(c, 6).alias(x) for x, c in cells.items()])  # one row each


@query(f"""WITH {X.CLIP_SRC}, {BUCKETS}, held AS (SELECT item_id, bucket, embedding::DOUBLE[] AS v FROM bucketed JOIN embeddings ON vec_id = item_id),
  ends AS (SELECT bucket, min(item_id) AS a, max(item_id) AS b FROM held GROUP BY bucket)
  SELECT item_id, bucket, len(v)::BIGINT AS latent_len, round(list_sum(v), 6) AS latent_sum FROM held JOIN ends USING (bucket) WHERE item_id IN (a, b)""")
def q95_point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The first and the last item of every bucket, looked up by zones and Bloom filters in a
    written cache of all items."""
    items = C.assign_buckets(X.clip_src(spark, sf).drop("text")).select("item_id", F.col("bucket").alias("bucket_id"))
    latents = X.feat(spark, sf).select(F.col("vec_id").alias("item_id"), F.col("v").alias("latent"))
    path = new_path(spark, "zoned-cache")
    cache.write_cache(path, items, latents, C.captions_by_clip(X.caption_fields(spark, sf)))
    cache.write_zones(spark, path)
    ends = spark.read.parquet(f"{path}/latents").groupBy("bucket_id").agg(F.min("item_id").alias("a"), F.max("item_id").alias("b"))  # a row for each bucket
    df = cache.look_up(spark, path, sorted({i for r in ends.collect() for i in (r.a, r.b)}))
    return df.select("item_id", F.col("bucket_id").alias("bucket"), F.size("latent").cast("long").alias("latent_len"), F.round(F.aggregate("latent", F.lit(0.0), lambda s, x: s + x), 6).alias("latent_sum"))
