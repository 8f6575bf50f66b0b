"""Queries on feature vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import similarity as V
from ..operators.ordering import places_within
from ..sources import fixtures as X
from .registry import query

ANCHOR = f"""{X.FEAT}, s AS (SELECT c.vec_id AS id, a.vec_id AS anchor, list_dot_product(c.v, a.v) AS sim FROM feat c, feat a WHERE c.label < 5 AND a.label >= 5),
  best AS (SELECT id, arg_max(anchor, row(sim, -anchor)) AS anchor, max(sim) AS similarity FROM s GROUP BY id)"""


def anchored(spark: SparkSession, sf: str) -> DataFrame:
    f = X.feat(spark, sf).withColumnRenamed("vec_id", "id")
    return V.best_anchors(f.where("label < 5").select("id", "v"), f.where("label >= 5").select("id", "v"))


@query(f"WITH {ANCHOR} SELECT id, anchor, round(similarity, 6) AS similarity FROM best")
def q44_best_anchor(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest training feature (labels 5 to 9) of every candidate (labels 0 to 4)."""
    return anchored(spark, sf).select("id", "anchor", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {ANCHOR} SELECT id, round(similarity, 6) AS similarity FROM best WHERE similarity BETWEEN 0.35 AND 0.45")
def q45_similarity_band(spark: SparkSession, sf: str) -> DataFrame:
    return anchored(spark, sf).where(F.col("similarity").between(0.35, 0.45)).select("id", F.round("similarity", 6).alias("similarity"))


@query()
def q46_greedy_mmr(spark: SparkSession, sf: str) -> DataFrame:
    """Two diverse candidates of each label whose nearest anchor is near enough."""
    f = X.feat(spark, sf).select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("grp"), "v")
    pool = anchored(spark, sf).select("id", "similarity").join(f, "id").where(F.col("similarity") >= 0.3)
    return V.select_diverse(pool, 2, 0.5, partial=True).select("id", "grp", "similarity", "score")


@query(f"WITH {X.FEAT}, x AS (SELECT label, v[1] AS a, v[2] AS b, v[3] AS c, v[4] AS d FROM feat) SELECT label::BIGINT AS label, count(*) AS n, " + ", ".join(f"round(coalesce(covar_samp({p}, {q}), 0), 6) AS c_{p}{q}" for i, p in enumerate("abcd") for q in "abcd"[i:]) + " FROM x GROUP BY label")
def q48_covariance_lowdim(spark: SparkSession, sf: str) -> DataFrame:
    four = X.feat(spark, sf).select("label", F.slice("v", 1, 4).alias("v"))
    g = V.gaussian(four, ["label"])
    cells = [F.round(F.col("cov")[i * 4 + j], 6).alias(f"c_{'abcd'[i]}{'abcd'[j]}") for i in range(4) for j in range(i, 4)]
    return g.select(F.col("label").cast("long").alias("label"), "n", *cells)


@query()
def q49_frechet(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of the features of even and of odd labels."""
    g = V.gaussian(X.feat(spark, sf).withColumn("side", F.col("label") % 2), ["side"])
    return V.frechet_to(g.where("side = 0"), g.where("side = 1")).select("n", F.round("distance", 6).alias("distance"))


@query()
def q50_per_group_frechet(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of each label's features to those of all."""
    f = X.feat(spark, sf)
    every = V.gaussian(f.select("v", F.lit(0).alias("all")), ["all"])
    return V.frechet_to(V.gaussian(f, ["label"]), every).select("label", "n", F.round("distance", 6).alias("distance"))


@query(f"""WITH {X.FEAT}, p AS (SELECT label // 2 AS grp, label % 2 AS side, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM feat)
  SELECT a.grp::BIGINT AS grp, count(*) AS pairs, round(avg(list_dot_product(a.v, b.v)) * 100, 4) AS score, round(avg(list_distance(a.v, b.v)), 6) AS distance FROM p a JOIN p b ON a.grp = b.grp AND a.pos = b.pos AND a.side = 0 AND b.side = 1 GROUP BY a.grp""")
def q64_paired_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of two labels paired by place: mean cosine times 100 (of unit vectors) and mean distance."""
    placed = places_within(X.feat(spark, sf), ["label"], ["vec_id"], "pos")
    p = placed.select((F.floor(F.col("label") / 2)).alias("grp"), (F.col("label") % 2).alias("side"), "v", "pos")
    a, b = p.where("side = 0").select("grp", "pos", "v"), p.where("side = 1").select("grp", "pos", F.col("v").alias("w"))
    gap = F.zip_with("v", "w", lambda x, y: x - y)
    both = a.join(b, ["grp", "pos"]).select("grp", S.dot(F.col("v"), F.col("w")).alias("s"), F.sqrt(F.aggregate(gap, F.lit(0.0), lambda t, x: t + x * x)).alias("d"))
    return both.groupBy("grp").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("s") * 100, 4).alias("score"), F.round(F.avg("d"), 6).alias("distance"))


@query()
def q74_pooled_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of a fixed sample, drawn by hash and pooled over labels, to all features."""
    from ..operators.sampling import hash_sample

    f = X.feat(spark, sf)
    real = V.gaussian(f.select("v", F.lit(0).alias("pool")), ["pool"])
    return V.frechet_to(V.gaussian(hash_sample(f, "vec_id", 200, seed=7).select("v", F.lit(0).alias("pool")), ["pool"]), real).select("n", F.round("distance", 6).alias("distance"))


def _balanced_sql(rounds: int) -> str:
    """Rows, then columns, in turn."""
    steps = [f"e0 AS (SELECT vec_id, j, exp(v[j]) AS x FROM feat, range(1, (SELECT max(len(v)) FROM feat) + 1) t(j)), s AS (SELECT count(DISTINCT vec_id) / count(DISTINCT j)::DOUBLE AS share FROM e0)"]
    for i in range(rounds):
        steps.append(f"r{i} AS (SELECT vec_id, j, x / sum(x) OVER (PARTITION BY vec_id) AS x FROM e{i})")
        steps.append(f"e{i + 1} AS (SELECT vec_id, j, x * share / sum(x) OVER (PARTITION BY j) AS x FROM r{i}, s)")
    return ", ".join(steps)


@query(f"WITH {X.FEAT}, {_balanced_sql(8)} SELECT vec_id, round(sum(x), 6) AS row_sum, round(max(x), 6) AS greatest, round(min(x), 6) AS least FROM e8 GROUP BY vec_id")
def q96_balanced_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings as a matrix of exponents, rows and columns scaled in turn eight times."""
    df = V.balance(X.feat(spark, sf).select("vec_id", "v"), "v")
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return df.select("vec_id", F.round(total, 6).alias("row_sum"), F.round(F.array_max("v"), 6).alias("greatest"), F.round(F.array_min("v"), 6).alias("least"))
