"""Quality rules: fixed counts over a text and the log-likelihood ratio of its
hashed words and word pairs under a trusted and a raw-corpus multinomial.

DataFrame functions only: no Python runs on executors."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import int_table, words_of

#: Buckets into which words and pairs are hashed; the size of both multinomials.
BUCKETS = 16384
#: Labelled rows used at most: those with the least hash of their id. Half of them fit the trusted multinomial, half calibrate the threshold.
MAX_LABELLED = 50_000
#: Weight of the raw multinomial within the trusted one.
PRIOR = 2000.0
#: Share of the calibration documents that may score below the threshold.
LOST = 0.002
#: Weights are held as integers, so a sum doesn't depend on its order.
SCALE = 1000
WINDOW = 8


@dataclass(frozen=True)
class QualityModel:
    """weights: SCALE * log-likelihood ratio by bucket; threshold: least mean of a kept document (None: no labelled rows, all are kept)."""

    weights: list[int]
    threshold: float | None


def _pairs(a: Column, k: int) -> Column:
    """Hash of each element with the one ``k`` places on."""
    n = F.greatest(F.size(a) - k, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + k), n), lambda x, y: F.xxhash64(x, y))


def _hashed(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds _w (words), _h (their hashes) and _g (hashes of pairs)."""
    df = docs.withColumn("_w", words_of(text_col))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    return df.withColumn("_g", _pairs(F.col("_h"), 1))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words within windows of 8 words that occur twice or more.
    Windows are compared by a 64-bit hash, built from pairs of pairs of pairs. Only
    texts with an equal pair of windows are sorted."""
    df = df.withColumn("_f", _pairs(F.col("_g"), 2)).withColumn("_e", _pairs(F.col("_f"), 4))
    entry = "array<struct<h:bigint,i:int>>"
    repeats = F.size(F.array_distinct("_e")) < F.size("_e")
    df = df.withColumn("_s", F.when(repeats, F.array_sort(F.transform("_e", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast(entry)))
    s = F.col("_s")
    twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")),
    )["n"]
    return df.withColumn("n_repeat_words", covered).drop("_f", "_e", "_s")


def _counts(df: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "_l": lines,
        }
    )
    df = df.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).drop("_l")
    df = _repeat_words(df)
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))


def labelled_sample(labels: DataFrame, wanted: Column, most: int = MAX_LABELLED) -> DataFrame:
    """At most ``most`` labelled ids, those with the least hash; the same at every call."""
    ids = labels.where(wanted & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _score(weights: list[int]) -> Column:
    table = int_table(weights)
    one = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.get(table, F.pmod(x, F.lit(len(weights))).cast("int")))
    n = F.size("_h") + F.size("_g")
    return F.when(n > 0, (one(F.col("_h")) + one(F.col("_g"))) / (n * SCALE)).otherwise(F.lit(0.0))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most: int = MAX_LABELLED, lost: float = LOST) -> QualityModel:
    """Raw counts are taken over all documents, trusted ones over labelled documents
    of quality 1 that aren't toxic. Both are sums by bucket, so what reaches the
    driver is bounded by ``buckets``. Only the bounded sample of ids is broadcast."""
    trusted = labelled_sample(labels, (F.col("quality") == 1) & (F.col("toxic") == 0), most)
    half = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(2)) == 0
    to_fit = F.broadcast(trusted.where(half).select(F.col("doc_id").alias("_id"), F.lit(1).alias("_t")))
    df = docs.select("doc_id", "text").join(to_fit, F.col("doc_id") == F.col("_id"), "left")
    df = _hashed(df, "text").select("_t", F.explode(F.concat("_h", "_g")).alias("x"))
    rows = df.groupBy(F.pmod("x", F.lit(buckets)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("raw"), F.count("_t").alias("trusted")).collect()
    raw, own = [0.5] * buckets, [0] * buckets
    for r in rows:
        raw[r.b], own[r.b] = r.raw + 0.5, r.trusted
    total, mine = sum(raw), sum(own)
    if not mine:
        return QualityModel([0] * buckets, None)
    weights = [round(SCALE * math.log((o + PRIOR * r / total) / (mine + PRIOR) / (r / total))) for o, r in zip(own, raw, strict=True)]
    held = F.broadcast(trusted.where(~half).select("doc_id"))
    scored = _hashed(docs.select("doc_id", "text").join(held, "doc_id", "left_semi"), "text").where(F.size("_w") >= 20).select(_score(weights).alias("s"))
    threshold = scored.agg(F.percentile("s", F.lit(lost)).alias("t")).first().t
    return QualityModel(weights, threshold)


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, score (double) and kept (boolean).

    A null or empty text has no words: all counts 0, base_failed, not kept. Repeated
    rows are judged one by one; other columns pass through, but columns of the names
    above are replaced."""
    df = _counts(_hashed(docs, "text"), "text").withColumn("score", _score(model.weights))
    good = F.lit(True) if model.threshold is None else F.col("score") >= F.lit(model.threshold)
    return df.withColumn("kept", ~F.col("base_failed") & good).drop("_w", "_h", "_g")
