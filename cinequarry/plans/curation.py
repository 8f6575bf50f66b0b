"""Queries on clip manifests: buckets, captions, filters, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import curation as C
from ..operators.ordering import dense_ids, middle_values, places_within
from ..sources import fixtures as X
from .registry import query

NEAREST = """CASE WHEN abs(ln(w / h / (512/384))) <= abs(ln(w / h / (512/288))) AND abs(ln(w / h / (512/384))) <= abs(ln(w / h / (288/512))) THEN '512x384'
  WHEN abs(ln(w / h / (512/288))) <= abs(ln(w / h / (288/512))) THEN '512x288' ELSE '288x512' END"""
THRESHOLD = "CASE WHEN w / h < 1.0 THEN '288x512' WHEN w / h > 1.55 THEN '512x288' ELSE '512x384' END"
NORMAL = r"trim(regexp_replace(replace(translate(lower(text), 'ςſ', 'σs'), 'ß', 'ss'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
#: Clips whose windows are told apart in one task.
PART_CLIPS = 1 << 15
BUCKETS = f"""sized AS (SELECT *, {NEAREST} AS size FROM clip_src),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY duration, item_id) - 1 AS rn FROM sized),
  bucketed AS (SELECT *, CASE WHEN size = '288x512' OR rn % 2 = 0 THEN 10.0::DOUBLE ELSE 20.0::DOUBLE END AS clip_seconds,
    (CASE WHEN size = '288x512' OR rn % 2 = 0 THEN '10' ELSE '20' END) || 's_' || size AS bucket FROM numbered)"""


@query(f"WITH {X.CLIP_SRC}, {BUCKETS} SELECT bucket, count(*) AS clips FROM bucketed GROUP BY bucket")
def q01_bucket_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return C.assign_buckets(X.clip_src(spark, sf).drop("text")).groupBy("bucket").agg(F.count(F.lit(1)).alias("clips"))


@query(f"WITH {X.CLIP_SRC} SELECT {THRESHOLD} AS size, count(*) AS clips FROM clip_src GROUP BY 1")
def q02_aspect_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return X.clip_src(spark, sf).groupBy(S.aspect_by_threshold(F.col("w"), F.col("h")).alias("size")).agg(F.count(F.lit(1)).alias("clips"))


@query(f"WITH {X.CLIP_SRC} SELECT item_id, {THRESHOLD} AS by_threshold, {NEAREST} AS by_nearest FROM clip_src WHERE {THRESHOLD} <> {NEAREST}")
def q03_aspect_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    w, h = F.col("w"), F.col("h")
    both = X.clip_src(spark, sf).select("item_id", S.aspect_by_threshold(w, h).alias("by_threshold"), S.aspect_by_nearest(w, h).alias("by_nearest"))
    return both.where("by_threshold <> by_nearest")


@query(f"SELECT lang, count(DISTINCT {NORMAL}) AS captions, count(*) AS clips FROM documents GROUP BY lang")
def q04_caption_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "documents").groupBy("lang").agg(F.count_distinct(F.md5(S.normalize_caption(F.col("text")))).alias("captions"), F.count(F.lit(1)).alias("clips"))


CAPTIONS = f"""{X.CAPTION_FIELDS}, firsts AS (SELECT stem, trim(caption) AS caption, min(row(field, pos)) AS place FROM caption_fields WHERE trim(caption) <> '' GROUP BY 1, 2),
  clip_captions AS (SELECT stem, list(caption ORDER BY place) AS texts FROM firsts GROUP BY stem)"""


@query(f"WITH {CAPTIONS} SELECT stem, len(texts)::BIGINT AS n, texts[1] AS primary_caption, md5(array_to_string(texts, '|')) AS all_md5 FROM clip_captions")
def q05_collect_captions(spark: SparkSession, sf: str) -> DataFrame:
    df = C.captions_by_clip(X.caption_fields(spark, sf))
    return df.select("stem", F.size("texts").cast("long").alias("n"), F.element_at("texts", 1).alias("primary_caption"), F.md5(F.array_join("texts", "|")).alias("all_md5"))


def _windows_sql(seconds: float, stride: float, most: int) -> str:
    return f"""windows AS (SELECT c.*, i AS "window", round(i * {stride}::DOUBLE, 3) AS start FROM clip_src c, range({most}) r(i) WHERE i * {stride}::DOUBLE + {seconds} <= duration - 0.2::DOUBLE)"""


@query(f'WITH {X.CLIP_SRC}, {_windows_sql(5.0, 5.0, 6)} SELECT item_id, "window"::BIGINT AS "window", start FROM windows')
def q06_window_starts(spark: SparkSession, sf: str) -> DataFrame:
    return C.windows_of(X.clip_src(spark, sf), 5.0).select("item_id", F.col("window").cast("long").alias("window"), "start")


@query(f"WITH {X.CLIP_SRC}, {_windows_sql(10.0, 4.0, 12)} SELECT source, start, count(*) AS clips FROM windows GROUP BY 1, 2")
def q07_overlapping_windows(spark: SparkSession, sf: str) -> DataFrame:
    return C.windows_of(X.clip_src(spark, sf), 10.0, 4.0, 12).groupBy("source", "start").agg(F.count(F.lit(1)).alias("clips"))


@query(
    f"""WITH {X.CLIP_SRC}, {_windows_sql(5.0, 5.0, 6)}, slots AS (SELECT item_id, start, i FROM windows, range(41) r(i))
  SELECT item_id, start, count(DISTINCT round_even((start + i / 8.0::DOUBLE) * 29.97::DOUBLE, 0)::BIGINT) AS frames, min(round_even((start + i / 8.0::DOUBLE) * 29.97::DOUBLE, 0)::BIGINT) AS first_frame,
    max(round_even((start + i / 8.0::DOUBLE) * 29.97::DOUBLE, 0)::BIGINT) AS last_frame FROM slots GROUP BY item_id, start"""
)
def q08_frame_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Frames follow from a window's start, so windows stay rows with an array of their own;
    clips are dealt to as many tasks as the table's rows ask for."""
    clips = X.clip_src(spark, sf).select("item_id", "duration")
    clips = clips.repartition(-(-clips.count() // PART_CLIPS) or 1, "item_id")
    slots = F.sequence(F.lit(0), S.frame_count(F.lit(5.0), 8.0) - 1)
    frames = F.transform(slots, lambda i: S.source_frame(i, F.col("start"), 8.0, 29.97))
    windows = C.windows_of(clips, 5.0).select("item_id", "start").distinct().withColumn("frames", frames)
    return windows.select("item_id", "start", F.size(F.array_distinct("frames")).cast("long").alias("frames"), F.array_min("frames").alias("first_frame"), F.array_max("frames").alias("last_frame"))


@query(f"WITH {X.CLIP_SRC} SELECT item_id, duration, quality::BIGINT AS quality FROM clip_src JOIN labels ON item_id = doc_id WHERE duration >= 10 AND w > 0 AND h > 0 AND trim(text) <> ''")
def q09_eligible_sources(spark: SparkSession, sf: str) -> DataFrame:
    labels = X.table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").cast("long").alias("quality"))
    usable = C.eligible(X.clip_src(spark, sf), F.lit(10.0)).where(F.trim("text") != "")
    return usable.join(labels, "item_id").select("item_id", "duration", "quality")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q10_unseen_sources(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "documents").select("doc_id", "source").join(X.table(spark, sf, "labels"), "doc_id", "left_anti")


@query(f"WITH train AS (SELECT {NORMAL} AS c FROM documents JOIN labels USING (doc_id)) SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND {NORMAL} NOT IN (SELECT c FROM train)")
def q11_unseen_captions(spark: SparkSession, sf: str) -> DataFrame:
    docs = X.table(spark, sf, "documents").select("doc_id", "source", F.xxhash64(S.normalize_caption(F.col("text"))).alias("c"), F.md5(S.normalize_caption(F.col("text"))).alias("m"))
    labelled = X.table(spark, sf, "labels").select("doc_id")
    train = docs.join(labelled, "doc_id", "left_semi").select("c", "m")
    return docs.join(labelled, "doc_id", "left_anti").join(train, ["c", "m"], "left_anti").select("doc_id", "source")


@query("SELECT DISTINCT lang, source FROM documents EXCEPT SELECT lang, source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
def q12_except_classes(spark: SparkSession, sf: str) -> DataFrame:
    docs = X.table(spark, sf, "documents")
    toxic = docs.join(X.table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi")
    return docs.select("lang", "source").subtract(toxic.select("lang", "source"))


@query(r"SELECT page_id, list_last(string_split(url, '/')) AS name, regexp_replace(list_last(string_split(url, '/')), '\.[^.]*$', '') AS stem FROM pages")
def q13_path_stem(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "pages").select("page_id", S.file_name(F.col("url")).alias("name"), S.stem(F.col("url")).alias("stem"))


@query("SELECT event_id + 1 AS step, substr(replace(event_type || ' ' || user_id::VARCHAR, ' ', '_'), 1, 50) AS slug FROM events WHERE (event_id + 1) % 50 = 0")
def q14_every_nth_and_trigger(spark: SparkSession, sf: str) -> DataFrame:
    """Steps at which a periodic job is due (every 50th)."""
    e = X.table(spark, sf, "events").select((F.col("event_id") + 1).alias("step"), S.slug(F.concat_ws(" ", "event_type", F.col("user_id").cast("string"))).alias("slug"))
    return e.where(F.pmod("step", F.lit(50)) == 0)


@query(f"WITH {X.CLIP_SRC}, {BUCKETS} SELECT item_id, size, clip_seconds, bucket FROM bucketed")
def q15_alternate_duration(spark: SparkSession, sf: str) -> DataFrame:
    """Clip seconds of every source: see ``assign_buckets``."""
    return C.assign_buckets(X.clip_src(spark, sf).drop("text")).select("item_id", "size", "clip_seconds", "bucket")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 100")
def q17_shortest_n(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "documents").select("doc_id", "n_chars").orderBy("n_chars", "doc_id").limit(100)


PRIORITIES = ("2-HIGH", "1-URGENT", "5-LOW", "3-MEDIUM", "4-NOT SPECIFIED")


@query(f"""SELECT o_orderkey, o_orderpriority, coalesce(list_position({list(PRIORITIES)}, o_orderpriority), 0)::BIGINT AS place,
  row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(list_position({list(PRIORITIES)}, o_orderpriority), 0), o_orderkey)::BIGINT AS at FROM orders""")
def q18_custom_order(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of each customer by a given order of priorities, unknown ones first."""
    place = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("o_orderpriority"))
    df = X.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", place.alias("place"))
    return df.withColumn("at", F.row_number().over(Window.partitionBy("o_custkey").orderBy("place", "o_orderkey")).cast("long")).drop("o_custkey")


@query("WITH d AS (SELECT DISTINCT text FROM documents), ids AS (SELECT text, row_number() OVER (ORDER BY md5(text), text) - 1 AS caption_id FROM d) SELECT doc_id, caption_id FROM documents JOIN ids USING (text)")
def q20_dictionary_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Captions as dense ids, in order of their digests. A digest stands for its text in
    the shuffles, and a copied caption's rows are spread by AQE's skew join."""
    docs = X.table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    ids = dense_ids(docs.select("digest").distinct(), ["digest"], "caption_id")
    return docs.join(ids, "digest").select("doc_id", "caption_id")


@query(f"""WITH {X.CLIP_SRC}, s AS (SELECT {NEAREST} AS size, count(*) AS n, min(item_id) AS first_item, sum(item_id)::BIGINT AS id_sum FROM clip_src GROUP BY 1)
  SELECT size, n, first_item, id_sum, n / sum(n) OVER () AS weight, row_number() OVER (ORDER BY n DESC, first_item) - 1 AS bucket_id FROM s""")
def q21_shape_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Shape buckets, largest first; a row for each shape."""
    size = S.aspect_by_nearest(F.col("w"), F.col("h")).alias("size")
    s = X.clip_src(spark, sf).groupBy(size).agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_item"), F.sum("item_id").alias("id_sum"))
    shapes = Window.orderBy(F.desc("n"), "first_item")
    return s.select("size", "n", "first_item", "id_sum", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("weight"), (F.row_number().over(shapes).cast("long") - 1).alias("bucket_id"))


@query(f"""WITH {X.CLIP_SRC}, p AS (SELECT item_id, source, row_number() OVER (PARTITION BY source ORDER BY item_id) - 1 AS pos FROM clip_src),
  v AS (SELECT vec_id, 'src' || label::VARCHAR AS source, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings) SELECT item_id, vec_id, source, pos FROM p JOIN v USING (source, pos)""")
def q22_bucket_position_join(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of two tables at the same place of the same bucket."""
    p = places_within(X.clip_src(spark, sf).select("item_id", "source"), ["source"], ["item_id"], "pos")
    v = X.table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("src"), F.col("label").cast("string")).alias("source"))
    v = places_within(v, ["source"], ["vec_id"], "pos")
    return p.join(v, ["source", "pos"]).select("item_id", "vec_id", "source", "pos")


@query("""SELECT lang, count(*) AS clips, count(DISTINCT source) AS sources, count(*) / greatest(count(DISTINCT source), 1) AS clips_per_source,
  round(sum(n_chars)::DOUBLE / 100 / 3600, 6) AS hours, coalesce(median(n_chars::DOUBLE / 100), 0) AS median_seconds FROM documents GROUP BY lang""")
def q23_split_summary(spark: SparkSession, sf: str) -> DataFrame:
    n, sources = F.count(F.lit(1)), F.count_distinct("source")
    docs = X.table(spark, sf, "documents").select("lang", "source", "n_chars", (F.col("n_chars") / 100.0).alias("seconds"))
    counts = docs.groupBy("lang").agg(n.alias("clips"), sources.alias("sources"), (n / F.greatest(sources, F.lit(1))).alias("clips_per_source"), F.round(F.sum("n_chars").cast("double") / 100 / 3600, 6).alias("hours"))
    return counts.join(middle_values(docs, "lang", "seconds"), "lang", "left").select(*counts.columns, F.coalesce("middle", F.lit(0.0)).alias("median_seconds"))


@query(f"""WITH {X.CLIP_SRC}, {CAPTIONS} SELECT item_id, format('{{:05d}}.npz', item_id) AS file_name, source, duration, texts[1] AS caption, len(texts)::BIGINT AS captions
  FROM clip_src JOIN clip_captions ON item_id = stem""")
def q61_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest rows of the clips that have captions, after a round through its JSON form."""
    from ..sources.manifest import parse_lines, to_lines

    clips = X.clip_src(spark, sf).join(C.captions_by_clip(X.caption_fields(spark, sf)).withColumnRenamed("stem", "item_id"), "item_id")
    rows = parse_lines(to_lines(clips.select(S.clip_name(F.col("item_id")).alias("file_name"), F.element_at("texts", 1).alias("text"), "texts", "source", "duration", "item_id")))
    return rows.select("item_id", "file_name", "source", "duration", F.col("text").alias("caption"), F.size("texts").cast("long").alias("captions"))


@query("WITH f AS (SELECT text, min(doc_id) AS primary_id, count(*) AS copies FROM documents GROUP BY text) SELECT doc_id, primary_id, copies FROM documents JOIN f USING (text)")
def q62_primary_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The first item with the same caption."""
    docs = X.table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    return docs.join(docs.groupBy("digest").agg(F.min("doc_id").alias("primary_id"), F.count(F.lit(1)).alias("copies")), "digest").select("doc_id", "primary_id", "copies")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS line, l_extendedprice, l_shipdate::VARCHAR AS ship, greatest(-1.0, least(1.0, l_quantity / 127.5 - 1))::DOUBLE AS pixel, round_even(l_quantity / 50 * 32767, 0)::BIGINT AS pcm, [10.0, 20.0][(l_linenumber % 2 + 1)::BIGINT]::DOUBLE AS seconds FROM lineitem")
def q65_scalings(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    return X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("line"), "l_extendedprice", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("ship"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / 127.5 - 1)).alias("pixel"), F.bround(q / 50 * 32767).cast("long").alias("pcm"),
        F.element_at(F.array(F.lit(10.0), F.lit(20.0)), F.pmod(F.col("l_linenumber"), F.lit(2)) + 1).alias("seconds"),
    )


@query("""SELECT p_brand, count(*) FILTER (p_name LIKE 'part%' OR contains(p_type, 'STEEL') OR p_type LIKE '%BRASS') AS matched, sum(CASE WHEN p_name LIKE 'part%' OR contains(p_type, 'STEEL') OR p_type LIKE '%BRASS' THEN p_size ELSE 0 END)::BIGINT AS sizes, count(*) AS parts FROM part GROUP BY p_brand""")
def q71_name_predicates(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.col("p_name").startswith("part") | F.col("p_type").contains("STEEL") | F.col("p_type").endswith("BRASS")
    return X.table(spark, sf, "part").groupBy("p_brand").agg(F.count_if(hit).alias("matched"), F.sum(F.when(hit, F.col("p_size")).otherwise(0)).alias("sizes"), F.count(F.lit(1)).alias("parts"))


COLORS, SHAPES = ("red", "green", "blue", "yellow", "cyan", "magenta"), ("circle", "square", "triangle")
MOVES, GROUNDS = ("left", "right", "up", "down"), ("black", "white", "gray")


@query(f"""SELECT row_number() OVER (ORDER BY c.i, s.i, m.i, g.i) - 1 AS combo, 'a ' || {list(COLORS)}[c.i] || ' ' || {list(SHAPES)}[s.i] || ' moving ' || {list(MOVES)}[m.i] || ' on a ' || {list(GROUNDS)}[g.i] || ' background' AS prompt
  FROM range(1, 7) c(i), range(1, 4) s(i), range(1, 5) m(i), range(1, 4) g(i)""")
def q53_combos(spark: SparkSession, sf: str) -> DataFrame:
    """Every combination of labels as a prompt: digits of one counter, no join."""
    n = len(COLORS) * len(SHAPES) * len(MOVES) * len(GROUNDS)
    pick = lambda names, over: F.element_at(F.array(*map(F.lit, names)), (F.floor(F.col("id") / over) % len(names)).cast("int") + 1)
    return spark.range(n).select(F.col("id").alias("combo"), F.concat(F.lit("a "), pick(COLORS, 36), F.lit(" "), pick(SHAPES, 12), F.lit(" moving "), pick(MOVES, 3), F.lit(" on a "), pick(GROUNDS, 1), F.lit(" background")).alias("prompt"))


PALETTE = {"small": 5, "middle": 20, "large": 35, "huge": 48}


@query(f"""WITH pal AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}', {v})" for i, (k, v) in enumerate(PALETTE.items()))}) p(place, name, size)),
  far AS (SELECT p_partkey, arg_min(name, row(abs(p_size - size), place)) AS nearest FROM part, pal GROUP BY p_partkey) SELECT nearest, count(*) AS parts FROM far GROUP BY nearest""")
def q57_nearest_palette(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest entry of a fixed palette, the first of equals."""
    options = [F.struct(F.abs(F.col("p_size") - v).alias("far"), F.lit(i).alias("at"), F.lit(k).alias("name")) for i, (k, v) in enumerate(PALETTE.items())]
    return X.table(spark, sf, "part").groupBy(F.array_min(F.array(*options))["name"].alias("nearest")).agg(F.count(F.lit(1)).alias("parts"))


@query()
def q47_cover_select(spark: SparkSession, sf: str) -> DataFrame:
    return C.cover_sizes(X.clip_src(spark, sf), 12)
