"""Nearest anchors, diverse selection, and Gaussian statistics of features."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import new_path

#: Rows of either side that meet as a matrix, and blocks of either side that one task holds.
BLOCK, BLOCKS = 4096, 8
#: Anchors of a cell on average; cells, and bytes of their centres, at most.
CELL, MOST_CELLS, CENTRE_BYTES = 1024, 4096, 32 << 20
#: Groups that a round of choices looks at, rows of each it takes along, and choices at most.
GROUPS, TAKEN, MOST_CHOSEN = 64, 256, 100_000


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _vectors(rows: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    lists = rows.column(column)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)


class Cells:
    """Cells of anchors around centres, and how near to a vector an anchor of each can be."""

    def __init__(self, centres: np.ndarray) -> None:
        self.centres = centres
        self.norms = np.linalg.norm(centres, axis=1)
        self.reach = self.angle = self.longest = np.zeros(len(centres))
        self.sizes = np.zeros(len(centres), np.int64)

    def angles(self, x: np.ndarray, dots: np.ndarray) -> np.ndarray:
        """Between each vector and each centre; none to a vector of length zero."""
        scale = np.linalg.norm(x, axis=1)[:, None] * self.norms
        return np.arccos(np.clip(np.divide(dots, scale, out=np.ones_like(dots), where=scale > 0), -1, 1))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nearest centre of each vector, its distance, angle and the vector's length."""
        dots = x @ self.centres.T
        at = (self.norms**2 - 2 * dots).argmin(axis=1)
        row = np.arange(len(x))
        length = np.linalg.norm(x, axis=1)
        angle = np.where(length * self.norms[at] > 0, self.angles(x, dots)[row, at], np.pi)
        return at, np.linalg.norm(x - self.centres[at], axis=1), angle, length

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """The largest inner product that an anchor of each cell can have with each vector: by
        its distance from the centre, and by the angle that is left at least."""
        dots = x @ self.centres.T
        length = np.linalg.norm(x, axis=1)[:, None]
        left = np.where(self.norms > 0, np.maximum(0, self.angles(x, dots) - self.angle), 0)
        most = np.minimum(dots + length * self.reach, length * self.longest * np.maximum(0, np.cos(left)))
        return np.where(self.sizes > 0, most + 1e-9 * (1 + length * self.longest), -np.inf)


def _cells_of(anchors: DataFrame, m: int, cell: int) -> tuple[DataFrame, Cells]:
    """Anchors (anchor, w, cell) and their cells. Centres are anchors drawn by a hash."""
    dims = len(anchors.select("v").first().v)
    k = max(1, min(-(-m // cell), MOST_CELLS, CENTRE_BYTES // (8 * max(1, dims))))
    cells = Cells(np.array([r.v for r in anchors.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(k).collect()], np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, reach, angle, length = cells.place(_vectors(batch, "w"))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (at.astype(np.int32), reach, angle, length))], names=["anchor", "w", "cell", "reach", "angle", "length"])

    placed = written(anchors.select(F.col("id").alias("anchor"), F.col("v").alias("w")).mapInArrow(run, "anchor bigint, w array<double>, cell int, reach double, angle double, length double"), "anchors")
    told = placed.groupBy("cell").agg(F.max("reach"), F.max("angle"), F.max("length"), F.count(F.lit(1))).collect()
    cells.reach, cells.angle, cells.longest = np.zeros(k), np.zeros(k), np.zeros(k)
    for at, *row in told:
        cells.reach[at], cells.angle[at], cells.longest[at], cells.sizes[at] = row
    return placed.select("anchor", "w", "cell"), cells


def _met(asks: DataFrame, placed: DataFrame, sizes: np.ndarray, block: int) -> DataFrame:
    """(id, m: struct of similarity and -anchor, more): the best anchor among the cells asked.

    Cells make bundles of BLOCKS blocks of anchors, so an asker is copied once for each bundle
    that it asks and not for each cell. A bundle's askers and anchors are dealt to parts of as
    many blocks, each side copied for the other's parts. Within a part a cell's anchors meet
    its own askers block by block as matrices; a part gives one row for each asker."""
    spark = asks.sparkSession
    part = BLOCKS * block
    bundle_of = (np.cumsum(sizes) - sizes) // part
    held = np.bincount(bundle_of, weights=sizes)
    bundles = F.broadcast(spark.createDataFrame([([int(x) for x in bundle_of],)], "bundles array<int>"))  # one row
    of = lambda c: F.get("bundles", c)
    each = asks.select("id", "v", "cells").join(bundles).withColumn("bundle", F.explode(F.array_distinct(F.transform("cells", of))))
    each = each.select("id", "v", "bundle", F.filter("cells", lambda c: of(c) == F.col("bundle")).alias("cells"))
    askers = {r.bundle: r.n for r in each.groupBy("bundle").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = spark.createDataFrame([(b, -(-n // part), max(1, int(held[b]) // part)) for b, n in askers.items()], "bundle int, left_parts int, right_parts int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    asked = asks.select(F.explode("cells").alias("cell")).distinct()
    left = each.join(F.broadcast(parts), "bundle").select("bundle", "id", "v", "cells", own("id", "left_parts").alias("a"), every("right_parts").alias("b"))
    right = placed.join(F.broadcast(asked), "cell", "left_semi").join(bundles).withColumn("bundle", of(F.col("cell"))).join(F.broadcast(parts), "bundle")
    right = right.select("bundle", "cell", "anchor", "w", own("anchor", "right_parts").alias("b"), every("left_parts").alias("a"))

    def run(l: pa.Table, r: pa.Table) -> pa.Table:
        n = l.num_rows
        best, at, seen = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        if n and r.num_rows:
            r = r.sort_by([("cell", "ascending"), ("anchor", "ascending")])
            x, y, anchor, cell = _vectors(l, "v"), _vectors(r, "w"), r["anchor"].to_numpy(), r["cell"].to_numpy()
            lists = l["cells"].to_pylist()
            row, want = np.repeat(np.arange(n), [len(c) for c in lists]), np.concatenate(lists)
            order = np.argsort(want, kind="stable")
            row, want = row[order], want[order]
            for c in np.unique(cell):
                own_rows = row[slice(*np.searchsorted(want, [c, c + 1]))]
                first, last = np.searchsorted(cell, [c, c + 1])
                for i in range(0, len(own_rows), block):
                    some = own_rows[i : i + block]
                    for j in range(first, last, block):
                        s = x[some] @ y[j : min(j + block, last)].T
                        k = s.argmax(axis=1)
                        s, k = s[np.arange(len(k)), k], anchor[j + k]
                        same = (s == best[some]) | (np.isnan(s) & np.isnan(best[some]))
                        good = (seen[some] == 0) | (s > best[some]) | (np.isnan(s) & ~np.isnan(best[some])) | (same & (k < at[some]))
                        best[some[good]], at[some[good]] = s[good], k[good]
                        seen[some] += min(j + block, last) - j
        got = seen > 0
        return pa.table({"id": pa.array(l["id"].to_numpy()[got], pa.int64()), "anchor": pa.array(at[got]), "similarity": pa.array(best[got]), "seen": pa.array(seen[got])})

    pairs = left.groupBy("bundle", "a", "b").cogroup(right.groupBy("bundle", "a", "b")).applyInArrow(run, "id bigint, anchor bigint, similarity double, seen bigint")
    return pairs.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("anchor")).alias("minus"))).alias("m"), F.sum("seen").alias("more"))


def best_anchors(candidates: DataFrame, anchors: DataFrame, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """(id, anchor, similarity, seen): for each candidate the anchor with the largest inner
    product, the smallest id of equals, and how many anchors it was compared with. Both
    sides have id (long, distinct) and v. Without anchors there are no rows.

    Exact without all pairs: anchors lie in cells around centres drawn from them. How near
    an anchor of a cell can be to a candidate follows from the cell's reach and angle. A
    candidate visits cells in order of that bound, twice as many in each round, and is done
    when the next bound is below its best. Where vectors have no clusters, as random ones
    of many dimensions, no bound holds much back and most cells are visited."""
    m = anchors.count()
    kind = "id bigint, anchor bigint, similarity double, seen bigint"
    if not m:
        return candidates.sparkSession.createDataFrame([], kind)
    placed, cells = _cells_of(anchors, m, cell)

    def asking(count: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                most = cells.bounds(_vectors(batch, "v"))
                order = np.argsort(-most, axis=1, kind="stable")
                best, at = batch.column("similarity").to_numpy(zero_copy_only=False), batch.column("at").to_numpy()
                asked = [[int(c) for c in row[i : i + count] if bound[c] > -np.inf and not bound[c] < b] for row, bound, b, i in zip(order, most, best, at, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(asked, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

        return run

    state = candidates.select("id", "v", F.lit(None).cast("long").alias("anchor"), F.lit(float("-inf")).alias("similarity"), F.lit(0).cast("long").alias("seen"), F.lit(0).alias("at"))
    done, count = [], 1
    while True:
        asks = written(state.mapInArrow(asking(count), "id bigint, v array<double>, anchor bigint, similarity double, seen bigint, at int, cells array<int>"), "asks")
        done.append(asks.where(F.size("cells") == 0))
        asks = asks.where(F.size("cells") > 0)
        if not asks.limit(1).count():
            break
        old = F.struct("similarity", (-F.col("anchor")).alias("minus"))
        both = asks.join(_met(asks, placed, cells.sizes, block), "id").withColumn("best", F.when(F.col("anchor").isNull(), F.col("m")).otherwise(F.greatest(old, "m")))
        state = both.select("id", "v", (-F.col("best.minus")).alias("anchor"), F.col("best.similarity").alias("similarity"), (F.col("seen") + F.col("more")).alias("seen"), (F.col("at") + count).alias("at"))
        state = written(state, "best")
        count *= 2
    return reduce(DataFrame.union, done).select("id", "anchor", "similarity", "seen")


def _choose(top: pd.DataFrame, before: np.ndarray, order: list[str], left: dict[str, int], weight: float, taken: int) -> tuple[list[tuple], pd.DataFrame]:
    """Choices (id, grp, similarity, score, v) among the rows taken along, and the others of
    these with their running maxima as they are now.

    A row that wasn't taken along can't beat the last one of its group that was, whose bound
    is stale. So choices go on while the best one is above it, and end at the first that isn't."""
    near = top["near"].to_numpy(copy=True)
    vectors = np.stack(top["v"].to_numpy()) if len(top) else np.zeros((0, 0))
    if len(before) and len(top):
        near = np.maximum(near, (vectors @ before.T).max(axis=1))
    similarity, ids = top["similarity"].to_numpy(), top["id"].to_numpy()
    free, choices = np.ones(len(top), bool), []
    for group in order:
        at = np.flatnonzero(top["grp"].to_numpy() == group)
        floor = None
        if len(at) > taken:
            stale = [(similarity[i] - weight * top["near"].iloc[i], similarity[i], ids[i], i) for i in at]
            *floor, last = min(stale)
            at = at[at != last]
        for _ in range(left[group]):
            own = at[free[at]]
            best = max(((similarity[i] - weight * near[i], similarity[i], ids[i], i) for i in own), default=None)
            if best is None or (floor is not None and list(best[:3]) <= floor):
                return choices, top.assign(near=near)[free]
            i = best[3]
            free[i] = False
            choices.append((int(ids[i]), group, float(similarity[i]), float(best[0]), vectors[i].tolist()))
            near = np.maximum(near, vectors @ vectors[i])
    return choices, top.assign(near=near)[free]


_CHOICES = "place long, id long, grp string, similarity double, score double, v array<double>, near double"


def _choosing(order: list[str], wanted: dict[str, int], number: int, weight: float, taken: int) -> Callable:
    """A round's choices, numbered from ``number`` on, and the running maxima of the other rows."""

    def run(top: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        before = np.stack(held["v"].to_numpy()) if len(held) else np.zeros((0, 0))
        picks, seen = _choose(top, before, order, wanted, weight, taken)
        out = [(number + i, *p, None) for i, p in enumerate(picks)] + [(None, r.id, r.grp, r.similarity, None, None, r.near) for r in seen.itertuples()]
        return pd.DataFrame(out, columns=["place", "id", "grp", "similarity", "score", "v", "near"])

    return run


def _nearer(chosen: np.ndarray) -> Callable:
    """Running maxima by all that has been chosen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.maximum(batch.column("near").to_numpy(), (_vectors(batch, "v") @ chosen.T).max(axis=1))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "grp", "similarity")), pa.array(near)], names=["id", "grp", "similarity", "near"])

    return run


def select_diverse(candidates: DataFrame, per_group: int, weight: float, partial: bool = False, taken: int = TAKEN, groups: int = GROUPS) -> DataFrame:
    """(place, id, grp, similarity, score): a greedy choice of ``per_group`` rows for each
    group, groups in order of size, then name: the largest similarity less ``weight`` (0 or
    more) times the largest similarity to what has been chosen (0 at least); of equals the
    larger similarity, then the larger id. Candidates have id (long, distinct), grp (string),
    v and similarity. A group with too few raises, or with ``partial`` gives what it has.

    Lazy: a row's score can only fall, so its score by the running maximum that it had when
    it was last looked at is a bound. A round takes along the rows with the best bounds of
    the groups that are next, ``taken`` of each, chooses among them as long as the best one
    beats every bound left behind, and writes back their running maxima. Only if a round
    chooses nothing, the maxima of all rows of these groups are told anew. So rounds follow
    from how often bounds mislead, not from how many rows are chosen. Choices are a report:
    MOST_CHOSEN at most, whose vectors go to the task that chooses."""
    spark = candidates.sparkSession
    if weight < 0:
        raise ValueError("bounds hold for weights of 0 or more")
    sizes = [(r.grp, r["count"]) for r in candidates.groupBy("grp").count().orderBy("count", "grp").limit(MOST_CHOSEN + 1).collect()]
    if not partial and (short := [g for g, n in sizes if n < per_group]):
        raise ValueError(f"not enough candidates for {short[0]}: {per_group} wanted")
    left = {g: min(n, per_group) for g, n in sizes}
    if sum(left.values()) > MOST_CHOSEN:
        raise ValueError(f"more than {MOST_CHOSEN} choices")
    rows = written(candidates.select("id", F.col("grp").cast("string").alias("grp"), F.col("similarity").cast("double").alias("similarity"), F.col("v").cast("array<double>").alias("v")), "candidates")
    maxima = rows.select("id", "grp", "similarity", F.lit(0.0).alias("near"))
    chosen: list[DataFrame] = []
    while order := [g for g, n in left.items() if n][:groups]:
        ahead = maxima.where(F.col("grp").isin(order))
        bound = F.col("similarity") - weight * F.col("near")
        best = Window.partitionBy("grp").orderBy(bound.desc(), F.desc("similarity"), F.desc("id"))
        top = ahead.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= taken + 1).drop("_n").join(rows.select("id", "v"), "id")
        held = reduce(DataFrame.union, chosen).select("v") if chosen else rows.select("v").limit(0)
        number = sum(min(n, per_group) for _, n in sizes) - sum(left.values())
        wanted = {g: left[g] for g in order}

        one = lambda df: df.withColumn("_one", F.lit(0)).groupBy("_one")
        looked = written(one(top.select("id", "grp", "similarity", "near", "v")).cogroup(one(held)).applyInPandas(_choosing(order, wanted, number, weight, taken), _CHOICES), "choices")
        picks = looked.where(F.col("place").isNotNull())
        found = {r.grp: r.n for r in picks.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
        left = {g: n - found.get(g, 0) for g, n in left.items()}
        if found:
            chosen.append(picks)
            now = looked.select("id", F.col("near").alias("now"), F.col("place").isNotNull().alias("gone"))
            maxima = maxima.join(now, "id", "left").where(~F.coalesce("gone", F.lit(False)))
            maxima = maxima.select("id", "grp", "similarity", F.greatest("near", F.coalesce("now", F.lit(0.0))).alias("near"))
        elif chosen:
            near = _nearer(np.array([r.v for r in held.collect()], np.float64))
            told = maxima.where(F.col("grp").isin(order)).join(rows.select("id", "v"), "id").mapInArrow(near, "id bigint, grp string, similarity double, near double")
            maxima = told.union(maxima.where(~F.col("grp").isin(order)))
        maxima = written(maxima.where(F.col("grp").isin([g for g, n in left.items() if n])), "maxima")
    if not chosen:
        return spark.createDataFrame([], "place long, id long, grp string, similarity double, score double")
    return reduce(DataFrame.union, chosen).select("place", "id", "grp", "similarity", "score")


def moments(features: DataFrame, by: list[str], vector: str = "v") -> DataFrame:
    """(by..., n, s, p): counts, sums and products (row by row), which add up over any parts.

    Every batch of rows becomes those of its groups before anything is shuffled, so a
    group's size doesn't matter."""
    keys = [f for f in features.schema if f.name in by]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(by, dropna=False):
                x = np.stack(part[vector].to_numpy()).astype(np.float64)
                yield pd.DataFrame([[*key, len(x), x.sum(axis=0), (x.T @ x).ravel()]], columns=[*by, "n", "s", "p"])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys)
    parts = features.select(*by, vector).mapInPandas(partial, f"{names}, n bigint, s array<double>, p array<double>")
    return merged(merged(parts.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(16))), [*by, "_salt"]).drop("_salt"), by)


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Moments of the same keys added up."""

    def some(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*rows[by].iloc[0], rows["n"].sum(), np.sum(np.stack(rows["s"]), axis=0), np.sum(np.stack(rows["p"]), axis=0)]], columns=[*by, "n", "s", "p"])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema if f.name in by)
    return parts.select(*by, "n", "s", "p").groupBy(*by).applyInPandas(some, f"{names}, n bigint, s array<double>, p array<double>")


def of_moments(stats: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, mean, cov) with n - 1 in the covariance, which is zero for a single row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for *key, n, s, p in batch.itertuples(index=False):
                s, p = np.asarray(s), np.asarray(p)
                mean = s / n
                cov = (p.reshape(len(s), -1) - n * np.outer(mean, mean)) / (n - 1) if n > 1 else np.zeros((len(s), len(s)))
                out.append([*key, n, mean, cov.ravel()])
            yield pd.DataFrame(out, columns=[*by, "n", "mean", "cov"])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema if f.name in by)
    return stats.select(*by, "n", "s", "p").mapInPandas(run, f"{names}, n bigint, mean array<double>, cov array<double>")


def gaussian(features: DataFrame, by: list[str], vector: str = "v") -> DataFrame:
    """(by..., n, mean, cov) of the groups. Matrices are row by row."""
    return of_moments(moments(features, by, vector), by)


def frechet(mean_a: np.ndarray, cov_a: np.ndarray, mean_b: np.ndarray, cov_b: np.ndarray) -> float:
    """Squared distance of means, plus tr(A + B - 2 sqrt(A B)); the root's trace is the sum of
    the roots of the product's eigenvalues, which are those of a symmetric product."""
    a, b = (x.reshape(len(mean_a), -1) for x in (cov_a, cov_b))
    values, vectors = np.linalg.eigh(a)
    root = (vectors * np.sqrt(np.clip(values, 0, None))) @ vectors.T
    cross = np.sqrt(np.clip(np.linalg.eigvalsh(root @ b @ root), 0, None)).sum()
    gap = mean_a - mean_b
    return float(gap @ gap + np.trace(a) + np.trace(b) - 2 * cross)


def frechet_to(stats: DataFrame, other: DataFrame) -> DataFrame:
    """``stats`` (one row a group) with the distance to ``other``, a single row of the same shape."""
    one = other.select("mean", "cov").limit(1).collect()
    kept = [f for f in stats.schema if f.name not in ("mean", "cov")]
    if not one:
        return stats.drop("mean", "cov").withColumn("distance", F.lit(None).cast("double"))
    mean, cov = np.array(one[0].mean), np.array(one[0].cov)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[[f.name for f in kept]].copy()
            out["distance"] = [frechet(np.array(m), np.array(c), mean, cov) for m, c in zip(batch["mean"], batch["cov"], strict=True)]
            yield out

    return stats.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", distance double")


def frechet_low_rank(mean: np.ndarray, cov: np.ndarray, rows: np.ndarray) -> float:
    """Distance of a few rows to a Gaussian. Their covariance is C'C / (T - 1), so the
    product's eigenvalues that aren't zero are those of the T x T matrix C cov C' / (T - 1)."""
    gap, t = rows.mean(axis=0) - mean, len(rows)
    centred = (rows - rows.mean(axis=0)) / np.sqrt(max(t - 1, 1))
    values = np.linalg.eigvalsh(centred @ cov @ centred.T)
    return float(gap @ gap + np.einsum("ij,ij->", centred, centred) + np.trace(cov) - 2 * np.sqrt(np.clip(values, 0, None)).sum())


def video_distances(frames: DataFrame, other: DataFrame, by: str, vector: str = "v") -> DataFrame:
    """(by, n, distance): each video's frames, which are few, against the Gaussian of ``other`` (one row)."""
    one = other.select("mean", "cov").limit(1).collect()
    mean = np.array(one[0].mean) if one else np.zeros(0)
    cov = np.array(one[0].cov).reshape(len(mean), -1) if one else np.zeros((0, 0))
    kind = frames.schema[by].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows[vector].to_numpy()).astype(np.float64)
        return pd.DataFrame([[rows[by].iloc[0], len(x), frechet_low_rank(mean, cov, x) if len(mean) else None]], columns=[by, "n", "distance"])

    return frames.select(by, vector).groupBy(by).applyInPandas(run, f"{by} {kind}, n bigint, distance double")


def balance(rows: DataFrame, vector_col: str, rounds: int = 8, tolerance: float = 0.0) -> DataFrame:
    """``rows`` with ``vector_col`` as positive matrix rows whose sums are brought to 1 and
    whose columns' sums to rows / columns, in turn, ``rounds`` times or until the columns'
    sums after a scaling of rows are within ``tolerance`` of that share. Entries are exponents.

    A row's own scale follows from the columns' scales, so a round is one sum by column and
    only as many numbers as there are columns reach the driver. Rows with a null vector or
    one of another length than most don't take part."""
    usable = rows.where(F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x)))
    shape = usable.groupBy(F.size(vector_col).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if shape is None or not shape.d:
        return usable
    entries = usable.where(F.size(vector_col) == shape.d).withColumn(vector_col, F.transform(vector_col, F.exp))
    scales = [1.0] * shape.d

    def scaled(of: list[float]) -> DataFrame:
        """Rows that sum to 1 once columns have these scales."""
        by = F.zip_with(vector_col, F.array(*map(F.lit, of)), lambda x, c: x * c)
        return entries.withColumn(vector_col, by).withColumn(vector_col, F.transform(vector_col, lambda x: x / F.aggregate(vector_col, F.lit(0.0), lambda s, y: s + y)))

    share = shape.n / shape.d
    for _ in range(rounds):
        sums = {r.j: r.s for r in scaled(scales).select(F.posexplode(vector_col).alias("j", "x")).groupBy("j").agg(F.sum("x").alias("s")).collect()}
        last, scales = scales, [c * share / sums[j] for j, c in enumerate(scales)]
        if max(abs(s / share - 1) for s in sums.values()) <= tolerance:
            break
    # The last scaling is that of columns, after that of rows by the scales before it.
    by = F.array(*[F.lit(c / b) for c, b in zip(scales, last, strict=True)])
    return scaled(last).withColumn(vector_col, F.zip_with(vector_col, by, lambda x, c: x * c))
