"""Helpers that the operators share: shared tables, word splitting, keyed joins
that survive hot keys, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path

#: What separates words everywhere in this package (ASCII white space).
WORD_SEPARATOR = r"[\x20\x09-\x0D]+"
#: Sub-groups into which every key is split before a hot group is summed up.
SALTS = 64
#: Spark's setting for deleting shuffle files as soon as their query has ended, and not when the driver next collects garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start
    from files that outlive any executor, so what was shuffled for it goes."""
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(FILE_CLEANUP, None)
    conf.set(FILE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(FILE_CLEANUP) if before is None else conf.set(FILE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | Column) -> Column:
    """All words of a text, empty for null: ``[^\\x20\\x09-\\x0D]+``."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SEPARATOR), "")


def int_table(values: list[int], kind: str = "int") -> Column:
    """A literal array of integers, folded once into a constant of the plan. Meant
    for model tables of a fixed, documented number of entries."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def keep_rows(df: DataFrame, condition: Column) -> DataFrame:
    """A filter that stays above the columns it needs. An ordinary one is pushed down
    with a copy of every expression it stands on, and nested array functions then
    repeat exponentially."""
    return df.select("*", F.explode(F.when(condition, F.array(F.lit(1)))).alias("_keep")).drop("_keep")


def salt_of(identity: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(identity), F.lit(salts)).cast("int")


def group_minimum(rows: DataFrame, key: str, value: str, salts: int = SALTS) -> DataFrame:
    """(key, salt, least, n): the least ``value`` and row count of every key, once
    for each salt in which the key occurs. ``rows`` carries ``salt``.

    A key with a third of all rows is first summed within each of ``salts``
    sub-groups; joining back on (key, salt) keeps its rows spread out as well."""
    part = rows.groupBy(key, "salt").agg(F.min(value).alias("least"), F.count(F.lit(1)).alias("n"))
    whole = part.groupBy(key).agg(F.min("least").alias("least"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
    return whole


def connected_components(links: DataFrame, spark: SparkSession) -> DataFrame:
    """(node, label): for every node of ``links`` (a, b: long) the least node that
    can be reached from it.

    Each round takes the least label among a node and its neighbours, then jumps
    to the label of that label, and is written to the shared folder; rounds end
    when no label has changed. A hub's links are spread by AQE's skew join since
    both sides of each join are shuffled straight from files."""
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        goals = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = least.join(goals, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        step = materialize(step, "labels")
        changed = step.where("label <> old").limit(1).count()
        discard(labels)
        labels = step.select("node", "label")
        if not changed:
            discard(both)
            return labels


def merge_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label: least node of its component) after more ``links``
    (a, b: long). Only the components that the links touch are searched again, each as
    one node, so a few new links cost little however large the components are."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = connected_components(ends.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")), labels.sparkSession)
    moved = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    merged = materialize(moved.union(joined.join(labels, "node", "left_anti").select("node", "label")), "labels")
    discard(joined)
    return merged
