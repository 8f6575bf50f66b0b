"""Queries on metric logs and evaluation records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metrics as M
from ..operators.ordering import middle_values, scan
from ..sources import fixtures as X
from .registry import query


@query(f"WITH {X.METRIC_EVENTS} SELECT step, clip, loss FROM metric_events ORDER BY loss DESC, step DESC LIMIT 3")
def q19_hardest_topk(spark: SparkSession, sf: str) -> DataFrame:
    return X.metric_events(spark, sf).select("step", "clip", "loss").orderBy(F.desc("loss"), F.desc("step")).limit(3)


@query(f"WITH {X.METRIC_EVENTS} SELECT clip, list_sort(list(loss))[count(*) // 2 + 1] AS upper_median, min(loss) AS least, max(loss) AS most FROM metric_events GROUP BY clip")
def q24_upper_median(spark: SparkSession, sf: str) -> DataFrame:
    df = X.metric_events(spark, sf).select("clip", "loss")
    ends = df.groupBy("clip").agg(F.min("loss").alias("least"), F.max("loss").alias("most"))
    return ends.join(middle_values(df, "clip", "loss", upper=True), "clip").select("clip", F.col("middle").alias("upper_median"), "least", "most")


STATS = f"""{X.FEAT}, chan AS (SELECT i - 1 AS channel, v[i] AS x FROM feat, range(1, 65) r(i)), s AS (SELECT channel, avg(x) AS mean, stddev_samp(x) AS std FROM chan GROUP BY channel),
  stats AS (SELECT channel, mean, greatest(std, (SELECT max(std) FROM s) * 0.05, 1e-4) AS std FROM s)"""


@query(f"WITH {STATS} SELECT channel::BIGINT AS channel, round(mean, 6) AS mean, round(std, 6) AS std FROM stats")
def q27_channel_stats(spark: SparkSession, sf: str) -> DataFrame:
    return M.channel_stats(X.feat(spark, sf)).select(F.col("channel").cast("long").alias("channel"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {STATS} SELECT vec_id, round(sum((v[channel + 1] - mean) / std), 4) AS total, round(max((v[channel + 1] - mean) / std), 4) AS top FROM feat, stats GROUP BY vec_id")
def q28_channel_standardize(spark: SparkSession, sf: str) -> DataFrame:
    """Features standardised by the statistics of their channels, which are a row for each
    channel and so gathered into one row and broadcast."""
    features = X.feat(spark, sf)
    stats = M.channel_stats(features).agg(F.array_sort(F.collect_list(F.struct("channel", "mean", "std"))).alias("stats"))
    joined = features.join(F.broadcast(stats))
    z = F.zip_with("v", "stats", lambda x, s: (x - s["mean"]) / s["std"])
    return joined.select("vec_id", z.alias("z")).select("vec_id", F.round(F.aggregate("z", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.array_max("z"), 4).alias("top"))


BANDED = f"{X.METRIC_EVENTS}, banded AS (SELECT *, least(floor(t * 8)::INT, 7)::VARCHAR AS band, loss * (1 - t) * (1 - t) AS x1 FROM metric_events)"
PROBE = f"""WITH {BANDED}, long AS (SELECT 't' AS axis, band AS key, loss AS v FROM banded UNION ALL SELECT 't_x1', band, x1 FROM banded
  UNION ALL SELECT 'bucket', bucket, loss FROM banded UNION ALL SELECT 'clip', clip::VARCHAR, loss FROM banded)"""


@query(f"{PROBE} SELECT axis, key, round(avg(v), 6) AS mean, count(*) AS n FROM long GROUP BY axis, key")
def q30_loss_probe_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return M.probe(X.metric_events(spark, sf))


@query(f"WITH {BANDED} SELECT band, format('{{:.3f}}-{{:.3f}}', band::INT / 8.0::DOUBLE, (band::INT + 1) / 8.0::DOUBLE) AS label, round(avg(loss), 6) AS loss, round(avg(x1), 6) AS x1, count(*) AS n FROM banded GROUP BY band")
def q29_loss_probe(spark: SparkSession, sf: str) -> DataFrame:
    band = S.band(F.col("t"))
    df = X.metric_events(spark, sf).select(band.alias("band"), "loss", S.clean_error(F.col("loss"), F.col("t")).alias("x1"))
    return df.groupBy("band").agg(F.round(F.avg("loss"), 6).alias("loss"), F.round(F.avg("x1"), 6).alias("x1"), F.count(F.lit(1)).alias("n")).select(F.col("band").cast("string").alias("band"), S.band_label(F.col("band"), digits=3).alias("label"), "loss", "x1", "n")


@query("SELECT l_linestatus, round(sum(CASE WHEN l_returnflag = 'N' THEN l_discount ELSE 0 END) / greatest(sum(CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0 END) * 2, 1), 6) AS mean FROM lineitem GROUP BY l_linestatus")
def q31_masked_mean(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.round(M.masked_mean(F.col("l_discount"), F.col("l_returnflag") == "N", 2), 6).alias("mean"))


@query("WITH s AS (SELECT l_orderkey, avg(l_extendedprice) FILTER (l_returnflag <> 'R') AS m FROM lineitem GROUP BY l_orderkey) SELECT round(avg(m), 6) AS mean, count(m) AS samples FROM s")
def q32_macro_mean(spark: SparkSession, sf: str) -> DataFrame:
    return M.macro_mean(X.table(spark, sf, "lineitem"), ["l_orderkey"], F.col("l_extendedprice"), F.col("l_returnflag") != "R")


@query("""WITH p AS (SELECT quality, toxic, CASE WHEN n_chars > 0 THEN (n_chars >= 200)::INT END AS q, contains(lower(text), 'idiot')::INT AS t FROM documents JOIN labels USING (doc_id))
  SELECT round(avg((q IS NOT DISTINCT FROM quality)::INT::DOUBLE), 6) AS quality, round(avg((t IS NOT DISTINCT FROM toxic)::INT::DOUBLE), 6) AS toxic,
    round(avg((q IS NOT DISTINCT FROM quality AND t IS NOT DISTINCT FROM toxic)::INT::DOUBLE), 6) AS all_right, round(avg((q IS NULL OR t IS NULL)::INT::DOUBLE), 6) AS missing, count(*) AS n FROM p""")
def q33_accuracy_report(spark: SparkSession, sf: str) -> DataFrame:
    """How well two rules tell the labels."""
    d = X.table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 0, (F.col("n_chars") >= 200).cast("int")).alias("q"), F.contains(F.lower("text"), F.lit("idiot")).cast("int").alias("t"))
    rows = d.join(X.table(spark, sf, "labels"), "doc_id")
    return M.accuracy(rows, {"quality": (F.col("q"), F.col("quality")), "toxic": (F.col("t"), F.col("toxic"))})


@query("WITH d AS (SELECT event_type, ts::DATE AS day, avg(value) AS m, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, round(sum(m * n) / sum(n), 6) AS mean, sum(n)::BIGINT AS n FROM d GROUP BY event_type")
def q34_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    days = X.table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    return days.groupBy("event_type").agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("mean"), F.sum("n").alias("n"))


@query(f"""WITH {BANDED}, e AS (SELECT band, bucket, sum(loss) FILTER (clip % 2 = 0) / greatest(count(*) FILTER (clip % 2 = 0), 1) AS train, sum(loss) FILTER (clip % 2 = 1) / greatest(count(*) FILTER (clip % 2 = 1), 1) AS test FROM banded GROUP BY band, bucket)
  SELECT band, round(avg(train), 6) AS train, round(avg(test), 6) AS test, round(avg(CASE WHEN train > 0 THEN test / train END), 6) AS gap, round(2 - pow(2 * (band::INT + 0.5) / 8 - 1, 2) / (pow((band::INT + 0.5) / 8, 2) + pow(1 - (band::INT + 0.5) / 8, 2)), 6)::DOUBLE AS blind FROM e GROUP BY band""")
def q35_heldout_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Errors on seen (even) and held-out (odd) clips by noise band, and their mean ratio over buckets."""
    log = X.metric_events(spark, sf).withColumn("band", S.band(F.col("t")))
    side = lambda odd: F.coalesce(F.sum(F.when(F.col("clip") % 2 == odd, F.col("loss"))), F.lit(None)) / F.greatest(F.count_if(F.col("clip") % 2 == odd), F.lit(1))
    e = log.groupBy("band", "bucket").agg(side(0).alias("train"), side(1).alias("test"))
    gap = F.when(F.col("train") > 0, F.col("test") / F.col("train"))
    out = e.groupBy("band").agg(F.round(F.avg("train"), 6).alias("train"), F.round(F.avg("test"), 6).alias("test"), F.round(F.avg(gap), 6).alias("gap"))
    return out.select(F.col("band").cast("string").alias("band"), "train", "test", "gap", F.round(S.blind_error((F.col("band") + 0.5) / 8), 6).alias("blind"))


@query("WITH e AS (SELECT user_id, arg_min(value, row(ts, event_id)) AS a, arg_max(value, row(ts, event_id)) AS b FROM events GROUP BY user_id) SELECT CASE WHEN b > a * 1.25 THEN 'up' WHEN a > b * 1.25 THEN 'down' ELSE 'flat' END AS direction, count(*) AS clips FROM e GROUP BY 1")
def q37_direction(spark: SparkSession, sf: str) -> DataFrame:
    """Direction told from the first and the last value of each clip."""
    at = F.struct("ts", "event_id")
    e = X.table(spark, sf, "events").groupBy("user_id").agg(F.min_by("value", at).alias("a"), F.max_by("value", at).alias("b"))
    return e.groupBy(F.when(F.col("b") > F.col("a") * 1.25, "up").when(F.col("a") > F.col("b") * 1.25, "down").otherwise("flat").alias("direction")).agg(F.count(F.lit(1)).alias("clips"))


@query("""SELECT s AS step, round(CASE WHEN s < 100 THEN (s + 1) / 100.0::DOUBLE ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * (s - 100) / 900)) END, 9)::DOUBLE AS lr, round(least(0.999, (1 + s) / (10.0::DOUBLE + s)), 9)::DOUBLE AS ema,
  round(1 - 3 * (1 - s / 1000.0::DOUBLE) / (1 + 2 * (1 - s / 1000.0::DOUBLE)), 9)::DOUBLE AS shifted, (6.0::DOUBLE * 1000000 + 12.0 * 12 * 768 * s) * 8 * s AS flops FROM range(1001) r(s)""")
def q38_schedules(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("id")
    return spark.range(1001).select(
        s.alias("step"), F.round(S.lr_scale(s, 100, 1000, 0.1), 9).alias("lr"), F.round(S.ema_decay(s, 0.999, 10), 9).alias("ema"),
        F.round(S.timeshift(s / 1000.0, 3.0), 9).alias("shifted"), S.step_flops(1_000_000, 12, 768, s, F.lit(8)).alias("flops"),
    )


@query(f"WITH {X.METRIC_EVENTS} SELECT (step - 1) // 100 AS flush, bucket, round(avg(loss), 6) AS mean, count(*) AS n FROM metric_events GROUP BY 1, 2")
def q43_tumbling_steps(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming.metrics import by_flush

    return by_flush(X.metric_events(spark, sf))


@query(f"""WITH RECURSIVE {X.METRIC_EVENTS}, d AS (SELECT bucket, (step - 1) // 100 AS flush, avg(loss) AS loss FROM metric_events GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY flush) AS rn FROM d),
  f AS (SELECT bucket, rn, flush, loss AS ema FROM n WHERE rn = 1 UNION ALL SELECT n.bucket, n.rn, n.flush, 0.9::DOUBLE * f.ema + 0.1::DOUBLE * n.loss FROM f JOIN n ON n.bucket = f.bucket AND n.rn = f.rn + 1)
  SELECT bucket, flush, round(ema, 6) AS ema FROM f""")
def q55_ema_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Exponential moving average of each bucket's means by flush (rows are flushes, not steps):
    m' = 0.9 m + 0.1 x, from the first mean on."""
    flushes = X.metric_events(spark, sf).groupBy("bucket", F.floor((F.col("step") - 1) / 100).alias("flush")).agg(F.avg("loss").alias("loss"))
    ema = scan(flushes, ["bucket"], ["flush"], F.lit(0.9), 0.1 * F.col("loss"), "ema", start=F.col("loss"))
    return ema.select("bucket", "flush", F.round("ema", 6).alias("ema"))


@query(f"""WITH {X.FEAT}, l AS (SELECT vec_id, i - 1 AS expert, exp(v[i] * 4) AS e FROM feat, range(1, 9) r(i)), p AS (SELECT vec_id, expert, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM l),
  k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, expert) AS rnk FROM p), n AS (SELECT *, CASE WHEN rnk <= 2 THEN p / sum(CASE WHEN rnk <= 2 THEN p END) OVER (PARTITION BY vec_id) END AS w FROM k)
  SELECT expert::BIGINT AS expert, round(avg(p), 6) AS importance, round(count(*) FILTER (rnk <= 2) / (count(*) * 2.0::DOUBLE), 6) AS load, round(sum(w), 4) AS weight FROM n GROUP BY expert""")
def q58_topk_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Two best of eight experts for each row, weights made to sum to 1; importance and load by expert."""
    e = F.transform(F.slice("v", 1, 8), lambda x: F.exp(x * 4))
    df = X.feat(spark, sf).select("vec_id", e.alias("e")).select("vec_id", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y)).alias("p"))
    best = F.slice(F.sort_array(F.transform("p", lambda p, i: F.struct(p.alias("p"), (-i).alias("at"))), asc=False), 1, 2)
    df = df.select("p", F.transform(best, lambda x: x["p"]).alias("top"), F.transform(best, lambda x: -x["at"]).alias("who"))
    long = df.select("top", "who", F.posexplode("p").alias("expert", "p"))
    chosen = F.array_contains("who", F.col("expert"))
    weight = F.when(chosen, F.col("p") / (F.get("top", F.lit(0)) + F.get("top", F.lit(1))))
    n = F.count(F.lit(1))
    return long.groupBy(F.col("expert").cast("long").alias("expert")).agg(F.round(F.avg("p"), 6).alias("importance"), F.round(F.count_if(chosen) / (n * 2.0), 6).alias("load"), F.round(F.sum(weight), 4).alias("weight"))


@query(f"""{PROBE}, m AS (SELECT axis, key, avg(v) AS mean FROM long GROUP BY axis, key) SELECT axis, count(*) AS groups, round(min(mean), 6) AS least, round(list_sort(list(mean))[count(*) // 2 + 1], 6) AS middle, round(max(mean), 6) AS most FROM m GROUP BY axis""")
def q68_probe_report(spark: SparkSession, sf: str) -> DataFrame:
    means = M.probe(X.metric_events(spark, sf))
    w = Window.partitionBy("axis")
    ranked = means.select("axis", "mean", F.row_number().over(w.orderBy("mean", "key")).alias("at"), F.count(F.lit(1)).over(w).alias("n"))
    return ranked.groupBy("axis").agg(F.count(F.lit(1)).alias("groups"), F.min("mean").alias("least"), F.max(F.when(F.col("at") == F.floor(F.col("n") / 2) + 1, F.col("mean"))).alias("middle"), F.max("mean").alias("most"))


@query("""SELECT p_brand, min(p_size)::BIGINT AS left_x, max(p_size)::BIGINT AS right_x, min(p_partkey % 50) AS top_y, max(p_partkey % 50) AS bottom_y, round(avg(p_size), 6) AS centre_x, median(p_retailprice) AS price,
  CASE WHEN count(*) < 5 THEN NULL ELSE round(avg((p_size < 10 AND p_partkey % 50 < 10)::INT), 6) END AS corner FROM part GROUP BY p_brand""")
def q69_bounding_box(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("p_size"), F.col("p_partkey") % 50
    corner = F.avg(((x < 10) & (y < 10)).cast("int"))
    part = X.table(spark, sf, "part")
    boxes = part.groupBy("p_brand").agg(
        F.min(x).cast("long").alias("left_x"), F.max(x).cast("long").alias("right_x"), F.min(y).alias("top_y"), F.max(y).alias("bottom_y"), F.round(F.avg(x), 6).alias("centre_x"),
        F.when(F.count(F.lit(1)) >= 5, F.round(corner, 6)).alias("corner"),
    )
    return boxes.join(middle_values(part, "p_brand", "p_retailprice").withColumnRenamed("middle", "price"), "p_brand", "left")


@query(f"WITH {X.FEAT}, b AS (SELECT vec_id, (i - 1) * 40 AS hz, v[i] AS power FROM feat, range(1, 65) r(i) WHERE (i - 1) * 40 > 100 AND (i - 1) * 40 < 2000) SELECT vec_id, arg_max(hz, row(power, -hz))::BIGINT AS dominant FROM b GROUP BY vec_id")
def q70_band_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """Strongest frequency within a band; the lowest of equals."""
    bins = F.transform("v", lambda p, i: F.struct(p.alias("power"), (-i * 40).alias("at")))
    inside = F.filter(bins, lambda x: (-x["at"] > 100) & (-x["at"] < 2000))
    return X.feat(spark, sf).select("vec_id", (-F.array_max(inside)["at"]).cast("long").alias("dominant"))
