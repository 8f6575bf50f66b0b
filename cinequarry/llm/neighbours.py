"""Approximate nearest neighbours by a permutation index.

Every vector is told by the order of its nearest pivots. It is posted in the inverted
files of the first few; a query looks into the files of more of its own, ranks what it
finds by footrule distance of the orders, and reranks the nearest by inner product.

There are about as many pivots as the root of the number of vectors, and a query looks
into a fixed number of files, so what it meets grows with that root. One footrule
distance holds for all files of a query: that of its NEAREST-th nearest pivot."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import materialize

#: Pivots for each root of the number of distinct vectors: those with the least hash of their id. At most so many, a bound on what the driver holds.
PIVOTS, MOST_PIVOTS = 4, 1 << 16
#: Pivots of an order that are kept, files a vector is posted in, files a query looks into.
PREFIX, POSTS, PROBES = 96, 6, 80
#: Of a query's pivots, told as vectors themselves, that its footrule distance takes in; pivots looked at for that, and the least number taken in.
NEAREST, SAMPLE, LEAST = 64, 4096, 16
#: Vectors and queries that meet in one task; longer files are dealt out in such blocks.
FILE_BLOCK, QUERY_BLOCK = 4096, 16384


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of each vector's ``prefix`` nearest pivots, nearest first. Pivots have length
    one: a long one isn't near to everything."""
    out = np.zeros((len(x), prefix), np.uint16)
    step = max(1, (1 << 22) // len(pivots))
    for at in range(0, len(x), step):
        near = x[at : at + step] @ pivots.T
        some = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix]
        out[at : at + step] = np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)
    return out


def footrule(places: np.ndarray, order: np.ndarray, n_pivots: int) -> np.ndarray:
    """Footrule distance of one order from many, but for a constant: a pivot that only one
    of them has stands at the end of the other."""
    prefix = len(order)
    rank = np.full(n_pivots, prefix, np.int32)
    rank[order] = np.arange(prefix)
    theirs = rank[places]
    return np.abs(theirs - np.arange(prefix)).sum(axis=1) + theirs.sum(axis=1)


def with_orders(vectors: DataFrame, pivots: np.ndarray, prefix: int, kind: str) -> DataFrame:
    """(rep, asks, vector: binary, places: binary, files: array<int>, cut: int) of vectors
    (rep, asks, vector). ``files`` are the pivots whose files it is posted in or looks into,
    ``cut`` is the footrule distance up to which a query looks, null if there is none."""
    sample = orders(pivots[:SAMPLE], pivots, prefix)
    taken = max(LEAST, NEAREST * len(sample) // len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            near, asks = orders(x, pivots, prefix), batch.column("asks").fill_null(False).to_numpy(zero_copy_only=False)
            cut = [int(np.partition(footrule(sample, o, len(pivots)), taken - 1)[taken - 1]) if a and taken < len(sample) else None for o, a in zip(near, asks, strict=True)]
            files = [o[: PROBES if a else POSTS] for o, a in zip(near.astype(np.int32), asks, strict=True)]
            columns = [batch.column("rep"), batch.column("asks"), pa.array([v.tobytes() for v in x.astype(kind)]), pa.array([o.tobytes() for o in near]), pa.array(files, pa.list_(pa.int32())), pa.array(cut, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "asks", "vector", "places", "files", "cut"])

    return vectors.mapInArrow(run, "rep bigint, asks boolean, vector binary, places binary, files array<int>, cut int")


def _rows(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


class File:
    """A block of an inverted file: vectors that have ``pivot`` among their first ``posts``."""

    def __init__(self, pivot: int, ids: np.ndarray, x: np.ndarray, places: np.ndarray, posts: int, n_pivots: int) -> None:
        self.ids, self.x, (n, self.prefix) = ids, x, places.shape
        own, local = np.unique(places, return_inverse=True)
        local = local.reshape(places.shape)
        self.local = np.full(n_pivots, len(own), np.int32)  # a pivot that no vector here has: the last row
        self.local[own] = np.arange(len(own))
        self.ranks = np.full((len(own) + 1, n), self.prefix, np.int16)
        self.ranks[local, np.arange(n)[:, None]] = np.arange(self.prefix, dtype=np.int16)
        self.steps = np.arange(self.prefix, dtype=np.int16)[:, None]
        self.posts = local[:, :posts]
        self.before = np.cumsum(places[:, :posts] == pivot, axis=1) == 0

    def nearest(self, q: np.ndarray, order: np.ndarray, cut: int | None, probes: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the ``k`` nearest by inner product, ties to the smaller id, of those
        within footrule distance ``cut`` that no earlier of their files shows the query;
        and their inner products."""
        order = self.local[order]
        theirs = self.ranks[order]
        # The distance as in footrule(): summed over the query's pivots instead of the vector's, the constants are the same.
        far = (np.abs(theirs - self.steps) + theirs).sum(axis=0, dtype=np.int32)
        asked = np.zeros(len(self.ranks), bool)
        asked[order[:probes]] = True
        asked[-1] = False
        rows = np.arange(len(far)) if cut is None else np.flatnonzero(far <= cut)
        rows = rows[~(asked[self.posts[rows]] & self.before[rows]).any(axis=1)]
        scores = np.einsum("ij,j->i", self.x[rows], q)
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[best], scores[best]


def search(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pivots: float = PIVOTS) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the ``k`` nearest rows found for every row
    with ``is_query``: largest inner product in double precision, ties to the smaller id.

    Rows whose vector is null, zero, of another length than most, or holds a null or
    non-finite component take no part, nor do rows without an id. Equal vectors are
    indexed once, by their smallest id; of their ids the k + 1 smallest can be among
    anyone's nearest, so no copies crowd out others. A query's own row is never its
    neighbour; rows that repeat an id are one row. If fewer rows are found, all are
    returned. Long files are met in blocks, never cut off. Extra columns are not read."""
    kind = "<f4" if isinstance(rows.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    vectors = rows.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asks"))
    length = vectors.agg(F.mode(F.size("vector"), deterministic=True).alias("n")).first().n
    vectors = materialize(vectors.where(F.size("vector") == F.lit(length)).groupBy("id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks")), "vectors")
    distinct = materialize(vectors.groupBy("vector").agg(F.min("id").alias("rep"), F.max("asks").alias("asks")), "distinct-vectors")
    n_pivots = min(MOST_PIVOTS, math.ceil(pivots * math.sqrt(distinct.count())))
    first = distinct.orderBy(F.xxhash64("rep"), "rep").limit(n_pivots).select("vector").collect()
    n_pivots, centres = max(1, len(first)), np.array([r.vector for r in first] or [[1.0] * (length or 1)], np.float64)
    centres /= np.sqrt(np.einsum("ij,ij->i", centres, centres))[:, None]
    prefix = min(PREFIX, n_pivots)
    named = materialize(with_orders(distinct.select("rep", "asks", "vector"), centres, prefix, kind), "orders")

    posts = named.select("rep", "vector", "places", F.explode(F.slice("files", 1, POSTS)).alias("pivot"))
    probes = named.where("asks").select("rep", "vector", "places", "cut", F.explode("files").alias("pivot"))
    blocks = lambda df, block, name: df.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    shape = F.broadcast(materialize(blocks(posts, FILE_BLOCK, "files").join(blocks(probes, QUERY_BLOCK, "asked"), "pivot"), "blocks"))  # a row for each pivot at most
    spread = lambda count: F.pmod(F.xxhash64("rep"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    posted = posts.join(shape, "pivot").withColumn("file", spread("files")).withColumn("block", every("asked")).select("pivot", "file", "block", "rep", "vector", "places")
    asking = probes.join(shape, "pivot").withColumn("block", spread("asked")).withColumn("file", every("files")).select("pivot", "file", "block", F.col("rep").alias("asker"), F.col("vector").alias("asks"), F.col("places").alias("asks_places"), "cut")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        askers, reps, scores = [], [], []
        if left.num_rows and right.num_rows:
            file = File(key[0].as_py(), left["rep"].to_numpy(), _rows(left["vector"], kind).astype(np.float64), _rows(left["places"], "<u2"), POSTS, n_pivots)
            asked = zip(right["asker"].to_pylist(), _rows(right["asks"], kind).astype(np.float64), _rows(right["asks_places"], "<u2"), right["cut"].to_pylist(), strict=True)
            for asker, q, order, cut in asked:
                near, own = file.nearest(q, order, cut, PROBES, k + 1)
                if len(near):
                    askers.append(asker)
                    reps.append(file.ids[near])
                    scores.append(own)
        return pa.table({"asker": pa.array(askers, pa.int64()), "reps": pa.array(reps, pa.list_(pa.int64())), "scores": pa.array(scores, pa.list_(pa.float64()))})

    key = ["pivot", "file", "block"]
    found = posted.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(run, "asker bigint, reps array<bigint>, scores array<double>")
    # Of each file a query has k + 1 rows at most, so what is gathered for one query is bounded.
    pairs = found.groupBy("asker").agg(F.flatten(F.collect_list(F.zip_with("reps", "scores", lambda r, s: F.struct((-s).alias("s"), r.alias("rep"))))).alias("near"))
    pairs = pairs.select("asker", F.explode(F.slice(F.array_sort("near"), 1, k + 1)).alias("x")).select("asker", F.col("x.rep").alias("rep"), (-F.col("x.s")).alias("score"))

    members = vectors.join(distinct.select("rep", F.col("vector").alias("_v")), F.col("vector") == F.col("_v")).select("rep", "id", "asks")
    members = materialize(members, "members")
    smallest = members.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("at") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    listed = pairs.join(smallest, "rep").select("asker", "score", F.explode("ids").alias("id"))
    listed = listed.withColumn("at", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "id"))).where(F.col("at") <= k + 1)
    listed = materialize(listed.groupBy(F.col("asker").alias("rep")).agg(F.sort_array(F.collect_list(F.struct("at", "id", "score"))).alias("near")), "nearest")
    answers = members.where("asks").join(listed, "rep").select(F.col("id").alias("query_id"), F.filter("near", lambda x: x["id"] != F.col("id")).alias("near"))
    answers = answers.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("rank", "x"))
    return answers.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
