"""Queries over ordered rows of clips: offsets, fills, first and last, event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.ordering import exclusive_sum
from ..sources import fixtures as X
from .registry import query


@query(f"WITH {X.CLIP_SRC}, n AS (SELECT item_id, (SELECT count(*) FROM range(6) r(i) WHERE i * 5.0::DOUBLE + 5 <= duration - 0.2::DOUBLE) AS n FROM clip_src) SELECT item_id, n, (sum(n) OVER (ORDER BY item_id ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS first_clip FROM n WHERE n > 0")
def q16_window_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Number of a source's first window among all windows."""
    n = F.size(S.window_starts(F.col("duration"), 5.0, 5.0, 6)).cast("long")
    return exclusive_sum(X.clip_src(spark, sf).select("item_id", n.alias("n")).where("n > 0"), ["item_id"], "n", "first_clip")


@query(f"WITH {X.FRAMES}, r AS (SELECT clip, frame, role, row_number() OVER (PARTITION BY clip ORDER BY frame, role, md5(text)) AS rn, count(*) OVER (PARTITION BY clip) AS n FROM frames) SELECT clip, max(role) FILTER (rn = 1) AS first_role, max(role) FILTER (rn = n) AS last_role, max(role) FILTER (rn = n // 2 + 1) AS middle_role, max(n) AS n FROM r GROUP BY clip")
def q25_first_last_mid(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("clip")
    r = X.frames(spark, sf).select("clip", "role", F.row_number().over(w.orderBy("frame", "role", F.md5("text"))).alias("rn"), F.count(F.lit(1)).over(w).alias("n"))
    at = lambda place: F.max(F.when(F.col("rn") == place, F.col("role")))
    return r.groupBy("clip").agg(at(F.lit(1)).alias("first_role"), at(F.col("n")).alias("last_role"), at(F.floor(F.col("n") / 2) + 1).alias("middle_role"), F.max("n").alias("n"))


@query(f"WITH {X.FRAMES}, h AS (SELECT clip, frame, role, md5(text) AS m, CASE WHEN role = 'assistant' THEN NULL ELSE md5(text) END AS x FROM frames) SELECT clip, frame, m, coalesce(x, last_value(x IGNORE NULLS) OVER (PARTITION BY clip ORDER BY frame, role, m ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS filled FROM h")
def q26_last_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Missing frames take the last good one of the whole clip."""
    whole = Window.partitionBy("clip").orderBy("frame", "role", "m").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = X.frames(spark, sf).select("clip", "frame", "role", F.md5("text").alias("m"), F.when(F.col("role") != "assistant", F.md5("text")).alias("x"))
    return h.select("clip", "frame", "m", F.coalesce("x", F.last("x", ignorenulls=True).over(whole)).alias("filled"))


@query(f"""WITH {X.FRAMES}, r AS (SELECT clip, frame, role, md5(text) AS m, row_number() OVER (PARTITION BY clip ORDER BY frame, role, md5(text)) - 1 AS rn, count(*) OVER (PARTITION BY clip) AS n FROM frames),
  k AS (SELECT DISTINCT clip, round_even(j * (n - 1) / 7.0::DOUBLE, 0)::BIGINT AS rn FROM (SELECT DISTINCT clip, n FROM r), range(8) t(j))
  SELECT clip, count(*) AS picked, sum(length(role))::BIGINT AS letters FROM r JOIN k USING (clip, rn) GROUP BY clip""")
def q36_even_frames_score(spark: SparkSession, sf: str) -> DataFrame:
    """Eight evenly spaced frames of each clip, fewer where it is shorter."""
    w = Window.partitionBy("clip")
    r = X.frames(spark, sf).select("clip", "role", (F.row_number().over(w.orderBy("frame", "role", F.md5("text"))) - 1).alias("rn"), F.count(F.lit(1)).over(w).alias("n"))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.bround(j * (F.col("n") - 1) / 7.0).cast("int"))
    return r.where(F.array_contains(wanted, F.col("rn"))).groupBy("clip").agg(F.count(F.lit(1)).alias("picked"), F.sum(F.length("role")).alias("letters"))


@query(f"""WITH {X.FRAMES}, r AS (SELECT DISTINCT clip, frame FROM frames), n AS (SELECT clip, max(frame) + 1 AS n FROM r GROUP BY clip),
  slots AS (SELECT clip, rate, i, round_even(i / rate * 2.0::DOUBLE, 0)::BIGINT AS frame FROM n, (VALUES (1.0::DOUBLE), (3.0::DOUBLE)) s(rate), range(1000) t(i) WHERE i < floor(n * rate / 2.0::DOUBLE))
  SELECT rate, count(*) AS slots, count(r.frame) AS matched, count(DISTINCT (slots.clip, r.frame)) FILTER (r.frame IS NOT NULL) AS frames FROM slots LEFT JOIN r USING (clip, frame) GROUP BY rate""")
def q63_frame_need_join(spark: SparkSession, sf: str) -> DataFrame:
    """Output slots at 1 and 3 frames a second over frames at 2: every slot keeps its frame,
    also where several need the same one."""
    r = X.frames(spark, sf).select("clip", "frame").distinct()
    n = r.groupBy("clip").agg((F.max("frame") + 1).alias("n")).select("clip", "n", F.explode(F.array(F.lit(1.0), F.lit(3.0))).alias("rate"))
    count = F.floor(F.col("n") * F.col("rate") / 2.0)
    slots = n.select("clip", "rate", F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1))).alias("i")).select("clip", "rate", F.bround(F.col("i") / F.col("rate") * 2.0).cast("long").alias("frame"))
    joined = slots.join(r.withColumn("hit", F.lit(1)), ["clip", "frame"], "left")
    return joined.groupBy("rate").agg(F.count(F.lit(1)).alias("slots"), F.count("hit").alias("matched"), F.count_distinct(F.when(F.col("hit") == 1, F.struct("clip", "frame"))).alias("frames"))


@query("WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings) SELECT label::BIGINT AS label, vec_id, place FROM r WHERE place <= 5")
def q66_first_k_per_group(spark: SparkSession, sf: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    return X.table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("label"), "vec_id", at.cast("long").alias("place")).where("place <= 5")


@query("SELECT event_id, epoch(ts) - epoch(lag(ts) OVER w) AS seconds, round(value / nullif(epoch(ts) - epoch(lag(ts) OVER w), 0), 6) AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def q67_throughput(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds since a user's last event, and value a second."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    e = X.table(spark, sf, "events").select("event_id", "user_id", "ts", "value", at.alias("at"))
    e = e.select("event_id", "value", (F.col("at") - F.lag("at").over(w)).alias("seconds"))
    return e.select("event_id", "seconds", F.round(F.try_divide("value", "seconds"), 6).alias("rate"))


@query(f"WITH {X.FRAMES} SELECT clip, frame, chunk, least(2, CASE WHEN chunk = 0 THEN 0 ELSE 1 + (chunk - 1) * 4 END)::BIGINT AS carried FROM (SELECT DISTINCT clip, frame, CASE WHEN frame = 0 THEN 0 ELSE 1 + (frame - 1) // 4 END AS chunk FROM frames)")
def q56_chunk_state(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of a clip's frames (one, then four at a time) with the frames carried over."""
    from ..streaming.metrics import chunk_of

    df = X.frames(spark, sf).select("clip", "frame").distinct().withColumn("chunk", chunk_of(F.col("frame")))
    return df.withColumn("carried", F.least(F.lit(2), F.when(F.col("chunk") == 0, 0).otherwise(1 + (F.col("chunk") - 1) * 4)).cast("long"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def q59_session_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that end after 30 minutes without an event."""
    e = X.table(spark, sf, "events").select("user_id", "ts")
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def q60_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = X.table(spark, sf, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "mean")


@query(f"""WITH {X.FEAT}, p AS (SELECT vec_id // 30 AS clip, vec_id % 30 AS frame, v[1] AS value, row_number() OVER (PARTITION BY vec_id // 30 ORDER BY vec_id) - 1 AS place FROM feat),
  c AS (SELECT clip, frame, CASE WHEN place = 0 THEN 0 ELSE 1 + (place - 1) // 4 END AS chunk FROM p), d AS (SELECT *, CASE WHEN chunk = 0 THEN 0 ELSE 1 + (chunk - 1) * 4 END AS first_place FROM c)
  SELECT d.clip, d.frame, d.chunk, concat_ws(' ', a.frame, b.frame) AS carried_frames, round(coalesce(a.value + b.value, b.value), 9) AS carried_sum
  FROM d LEFT JOIN p a ON a.clip = d.clip AND a.place = d.first_place - 2 LEFT JOIN p b ON b.clip = d.clip AND b.place = d.first_place - 1""")
def q92_chunk_carry(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of clips (thirty frames) with the numbers and values of the frames carried into each."""
    from ..streaming.metrics import carried_batch

    rows = X.feat(spark, sf).select(F.floor(F.col("vec_id") / 30).alias("clip"), (F.col("vec_id") % 30).alias("frame"), F.col("v")[0].alias("value"))
    total = F.when(F.size("carried") > 0, F.aggregate("carried.value", F.lit(0.0), lambda s, x: s + x))
    return carried_batch(rows).select("clip", "frame", "chunk", F.array_join(F.col("carried.frame").cast("array<string>"), " ").alias("carried_frames"), F.round(total, 9).alias("carried_sum"))


@query(f"""WITH {X.FRAMES}, r AS (SELECT clip, frame, min(md5(text)) AS value FROM frames GROUP BY clip, frame), k AS (SELECT DISTINCT clip FROM r),
  n AS (SELECT clip, win, slot, 2 * (win + slot) AS frame FROM k, range(2) w(win), range(2) s(slot)),
  s AS (SELECT clip, count(*) FILTER (frame < 4) + max(CASE WHEN frame >= 4 THEN 1 ELSE 0 END) AS seen FROM r GROUP BY clip)
  SELECT n.clip, n.win, n.slot, n.frame, r.value, s.seen::BIGINT AS seen FROM n JOIN s USING (clip) LEFT JOIN r ON r.clip = n.clip AND r.frame = n.frame""")
def q93_served_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Two overlapping windows of two seconds, a frame a second of two, from one pass over a clip's
    frames that ends at the last one needed."""
    from ..functions.udtf import serve_windows

    r = X.frames(spark, sf).groupBy("clip", "frame").agg(F.min(F.md5("text")).alias("value"))
    pairs = F.array(*[F.struct(F.lit(w).cast("long").alias("win"), F.lit(s).cast("long").alias("slot"), F.lit(2 * (w + s)).cast("long").alias("frame")) for w in range(2) for s in range(2)])
    needs = r.select("clip").distinct().select("clip", F.explode(pairs).alias("n")).select("clip", "n.*")
    served = serve_windows(r, needs)
    return served.select("clip", F.col("win").cast("long").alias("win"), F.col("slot").cast("long").alias("slot"), "frame", "value", "seen")
