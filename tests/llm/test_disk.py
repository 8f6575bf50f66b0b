"""What near-dedup and line dedup leave on disk, and what they take off it on the way."""

import random
import time
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from cinequarry.llm import linededup, resemblance
from cinequarry.llm.common import materialize
from cinequarry.sources.shared import new_path
from test_resemblance import alike, naive_set, texts


def left(spark):
    """The tables in the shared folder."""
    return {p.name for p in Path(new_path(spark, "x").removeprefix("file://")).parent.glob("*")}


def test_shuffle_files_go_with_their_query(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before, conf = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    df = materialize(spark.range(1000).repartition(7, F.col("id")), "some-rows")
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before and df.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == conf


def test_tables_go(spark, tmp_path):
    before = left(spark)
    line = " ".join(f"w{chr(97 + i)}" for i in range(24))
    docs = spark.createDataFrame([(i, f"{line}\nown {'abcdefgh'[i]} line", "en", "s", 1) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    lines = materialize(linededup.dedup_lines(docs, keep_first=True).select(docs.columns), "lines")
    assert lines.where(F.col("text").contains(line)).count() == 1
    kept = corpus_pipeline.near_dedup(spark, lines, str(tmp_path))
    names = {x.rsplit("-", 1)[0] for x in left(spark) - before}
    assert "near-kept" in names and not names & {"shingle-sets", "whole-sets", "set-parities", "wanted-sets", "line-places", "recurring-templates"}
    assert kept.count() >= 1


def test_unlike_pairs_are_not_counted_out(spark, monkeypatch):
    """Sets that share a passage aren't read whole to be told apart."""
    rng, seen, counted = random.Random(3), [], resemblance._counted

    def told(pairs, sets, only_alike):
        if only_alike:
            seen.append(pairs.count())
        return counted(pairs, sets, only_alike)

    monkeypatch.setattr(resemblance, "_counted", told)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join([passage, *(f"w{rng.randint(0, 10**6)}" for _ in range(100))])) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert resemblance.keep_one_per_group(docs).count() == 50
    assert seen and sum(seen) < 50


def test_parities_lose_no_alike_pair():
    rng = random.Random(5)
    more = [[f"x{rng.randint(0, 10**6)}" for _ in range(n)] for n in (63, 68, 69, 70, 131, 133, 1028, 1040)]
    edited = [" ".join([*w[: len(w) * 9 // 10], *(["new"] * k)]) for w in more for k in (0, 1)] + [" ".join(w) for w in more]
    some = [t for t in texts() + edited if t]
    sets, raw = [naive_set(t) for t in some], [resemblance.packed(resemblance.shingle_set(t)) for t in some]
    odd, n_alike, n_folded = list(map(resemblance.parities, raw)), 0, 0
    for i in range(len(some)):
        for j in range(i):
            differ = resemblance.unlike(odd[i], odd[j])
            assert differ <= len(sets[i] ^ sets[j])
            if alike(sets[i], sets[j]):
                n_alike, n_folded = n_alike + 1, n_folded + (len(odd[i]) != len(odd[j]))
                assert 9 * differ <= len(sets[i]) + len(sets[j])
    assert n_alike > 50 and n_folded


def test_few_sets_are_wanted(spark, monkeypatch):
    """Among a million sets in pairs, few others are taken for wanted ones; no pair is lost."""
    few, kept = [], resemblance.materialize

    def told(df, name):
        out = kept(df, name)
        if name == "wanted-sets":
            few.append(out.count())
        return out

    monkeypatch.setattr(resemblance, "materialize", told)
    one = resemblance.packed(resemblance.shingle_set("a b c d e f g"))
    sets = spark.range(2 * 10**6).select(F.xxhash64("id").alias("fp"), F.lit(one).alias("items"))
    pairs = spark.range(0, 10**6, 2).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    assert resemblance._counted(pairs, sets, True).count() == 500_000
    assert 10**6 <= few[0] < 1.1 * 10**6
