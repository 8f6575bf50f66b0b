"""A feature cache as tables: latents dealt by bucket, an index of items, their texts, audio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("latents", "index", "texts", "audio")


def write_cache(path: str, items: DataFrame, latents: DataFrame, captions: DataFrame, audio: DataFrame | None = None) -> None:
    """Write items (item_id, bucket_id), their latents (item_id, latent), captions (stem,
    texts) and, if there are any, audio latents (item_id, audio). Latents lie in a folder
    for each bucket; of an item's texts the first is the primary one."""
    placed = items.select("item_id", "bucket_id")
    placed.write.mode("errorifexists").parquet(f"{path}/index")
    latents.join(placed, "item_id").write.mode("errorifexists").partitionBy("bucket_id").parquet(f"{path}/latents")
    texts = captions.select(F.col("stem").alias("item_id"), "texts", F.size("texts").alias("caption_count"))
    texts.write.mode("errorifexists").parquet(f"{path}/texts")
    if audio is not None:
        audio.join(placed, "item_id").write.mode("errorifexists").partitionBy("bucket_id").parquet(f"{path}/audio")


def read_cache(spark: SparkSession, path: str, bucket: int | None = None, with_audio: bool = True) -> DataFrame:
    """(item_id, bucket_id, latent, texts, caption_count, audio): every item of the cache, or
    of one bucket, of which alone the folders are read then. Items without texts have none
    and a count of 0; a cache without audio has null there."""
    of = lambda name: spark.read.parquet(f"{path}/{name}").where(F.lit(True) if bucket is None else F.col("bucket_id") == bucket)
    df = of("index").join(of("latents").drop("bucket_id"), "item_id", "left").join(spark.read.parquet(f"{path}/texts"), "item_id", "left")
    df = df.withColumn("caption_count", F.coalesce("caption_count", F.lit(0)))
    if not with_audio:
        return df.withColumn("audio", F.lit(None).cast("array<double>"))
    return df.join(of("audio").drop("bucket_id"), "item_id", "left")


def write_split(path: str, header: DataFrame, items: DataFrame) -> None:
    """A split's manifest: one JSON object with what is counted, and the items as JSON lines
    in a folder for each split. Item lists are tables, never one value."""
    header.coalesce(1).write.mode("errorifexists").json(f"{path}/header")
    items.write.mode("errorifexists").partitionBy("split").json(f"{path}/items")


#: Bits of a bitmap of Spark's, bits of a file's filter for each item at least, and how many of them an item sets.
BITMAP, BITS, PROBES = 32768, 12, 5


def _probes(item: Column, bits: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(item.cast("long"), F.lit(i)), bits) for i in range(PROBES)])


def write_zones(spark: SparkSession, path: str) -> None:
    """Beside a written cache, for each file of its latents: least and greatest item and a Bloom
    filter of its items, in bitmaps (file, least, most, bits, part, bitmap)."""
    items = spark.read.parquet(f"{path}/latents").select("item_id", F.col("_metadata.file_path").alias("file"))
    zones = items.groupBy("file").agg(F.min("item_id").alias("least"), F.max("item_id").alias("most"), (F.ceil(F.count(F.lit(1)) * BITS / BITMAP) * BITMAP).alias("bits"))
    # A row for each file: small beside the items, and joined by its name.
    places = items.join(zones, "file").select("file", "least", "most", "bits", F.explode(_probes(F.col("item_id"), F.col("bits"))).alias("at"))
    maps = places.groupBy("file", "least", "most", "bits", F.floor(F.col("at") / BITMAP).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % BITMAP).alias("bitmap"))
    maps.write.mode("errorifexists").parquet(f"{path}/zones")


def files_of(spark: SparkSession, path: str, items: list[int]) -> DataFrame:
    """(item_id, file): the files that can hold each item: within its zone, and all bits set."""
    wanted = F.explode(F.array(*[F.lit(i).cast("long") for i in sorted(set(items))]))
    zones = spark.read.parquet(f"{path}/zones").withColumn("item_id", wanted).where("item_id between least and most")
    asked = zones.withColumn("at", F.explode(_probes(F.col("item_id"), F.col("bits")))).where(F.floor(F.col("at") / BITMAP) == F.col("part"))
    bit = (F.col("at") % BITMAP).cast("int")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, bit % 8) == 1
    return asked.where(is_set).groupBy("item_id", "file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == PROBES).select("item_id", "file")


def look_up(spark: SparkSession, path: str, items: list[int]) -> DataFrame:
    """(item_id, bucket_id, latent) of a few items of a cache with zones. Only files that can
    hold them are read. An item that isn't there is a LookupError."""
    files = [r.file for r in files_of(spark, path, items).select("file").distinct().collect()] if items else []
    latents = spark.read.option("basePath", f"{path}/latents").parquet(*files) if files else spark.read.parquet(f"{path}/latents").limit(0)
    found = latents.where(F.col("item_id").isin(items)).select("item_id", "bucket_id", "latent")
    if absent := set(items) - {r.item_id for r in found.select("item_id").distinct().collect()}:
        raise LookupError(f"not in the cache: {sorted(absent)}")
    return found
