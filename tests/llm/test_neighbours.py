import math

import numpy as np
from pyspark.sql import functions as F

from cinequarry.llm import neighbours
from cinequarry.llm.queries import QUERIES


def exact(rows, k):
    out = []
    known = {i: v for i, v in rows}
    ids = np.array(sorted(known))
    x = np.array([known[i] for i in ids], np.float64)
    for q in [i for i in ids if i % 20 == 0]:
        s = x @ np.array(known[q])
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != q][:k]
        out += [(int(q), rank + 1, int(ids[j]), s[j]) for rank, j in enumerate(order)]
    return out


def run(spark, rows, k=20, **kw):
    df = spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    return [tuple(r) for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k, **kw).orderBy("query_id", "rank").collect()]


def test_recall_and_exact_scores(spark):
    x = np.random.default_rng(0).normal(size=(1500, 24)).astype(np.float32)
    rows = list(enumerate(x))
    got, want = run(spark, rows), exact(rows, 20)
    assert len(got) == len(want)
    assert len({g[::2] for g in got} & {w[::2] for w in want}) / len(want) >= 0.9
    right = {w[::2]: w[3] for w in want}
    assert all(abs(g[3] - right[g[::2]]) < 1e-12 for g in got if g[::2] in right)


def test_recall_of_the_registered_table(spark):
    """The query's own table: at least 0.9, and a query meets a part of it only."""
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op6_permutation_index"](spark, sf).toPandas()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.array(table["embedding"].tolist(), np.float64), table["vec_id"].to_numpy()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits += len(want & set(got[got["query_id"] == ids[q]]["vec_id"].tolist()))
        total += len(want)
    assert hits / total >= 0.9


def test_candidates_grow_slower_than_the_table():
    """Share of the table that a query's files show, and that is reranked, at two sizes."""
    shares = []
    for n in (2000, 18000):
        x = np.random.default_rng(7).normal(size=(n, 32))
        m = math.ceil(neighbours.PIVOTS * math.sqrt(n))
        pivots = x[:m] / np.linalg.norm(x[:m], axis=1)[:, None]
        near = neighbours.orders(x, pivots, neighbours.PREFIX)
        sample, seen, kept, hits = near[:m], 0, 0, 0
        for q in range(m, m + 20):
            asked = np.zeros(m, bool)
            asked[near[q, : neighbours.PROBES]] = True
            met = asked[near[:, : neighbours.POSTS]].any(axis=1)
            cut = np.sort(neighbours.footrule(sample, near[q], m))[neighbours.NEAREST - 1]
            taken = met & (neighbours.footrule(near, near[q], m) <= cut)
            seen, kept = seen + met.mean() / 20, kept + taken.mean() / 20
            hits += taken[np.argsort(-(x @ x[q]) / np.linalg.norm(x, axis=1))[1:21]].mean() / 20
        shares.append((seen, kept))
        assert hits >= 0.85
    assert shares[1][0] < shares[0][0] * 0.7 and shares[1][1] < shares[0][1] * 0.5


def test_file_shows_a_vector_once():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 8))
    pivots = x[:60] / np.linalg.norm(x[:60], axis=1)[:, None]
    near = neighbours.orders(x, pivots, 20)
    q, seen = near[499], []
    for p in q[:15]:
        rows = np.flatnonzero((near[:, :4] == p).any(axis=1))
        if len(rows):
            file = neighbours.File(int(p), rows, x[rows], near[rows], 4, 60)
            got, scores = file.nearest(x[499], q, 600, 15, 500)
            assert np.allclose(scores, x[rows][got] @ x[499])
            seen += rows[got].tolist()
    asked = np.isin(near[:, :4], q[:15]).any(axis=1) & (neighbours.footrule(near, q, 60) <= 600)
    assert sorted(seen) == np.flatnonzero(asked).tolist() and asked.sum() > 50


def test_small_tables_are_exact(spark):
    x = np.random.default_rng(1).normal(size=(60, 8)).astype(np.float32)
    rows = list(enumerate(x))
    assert [(g[0], g[1], g[2]) for g in run(spark, rows)] == [(w[0], w[1], w[2]) for w in exact(rows, 20)]
    few = rows[:5]
    assert [(g[0], g[1], g[2]) for g in run(spark, few)] == [(0, i + 1, w[2]) for i, w in enumerate(exact(few, 20))]


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(300, 8)).astype(np.float32)
    rows = list(enumerate(x))
    whole = run(spark, rows)
    monkeypatch.setattr(neighbours, "FILE_BLOCK", 40)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 3)
    assert run(spark, rows) == whole


def test_copies_ties_and_odd_rows(spark):
    x = np.random.default_rng(3).normal(size=(40, 6)).astype(np.float32)
    rows = list(enumerate(x)) + [(100 + i, x[1]) for i in range(200)] + [(105, x[1])]
    odd = [(1000, None), (1020, [0.0] * 6), (1040, [float("nan")] + [1.0] * 5), (1060, [float("inf")] + [1.0] * 5), (1080, [1.0] * 5), (1100, [])]
    got = run(spark, rows + odd)
    want = exact(list(dict(rows).items()), 20)
    assert [(g[0], g[1], g[2]) for g in got] == [(w[0], w[1], w[2]) for w in want]
    only = [g for g in got if g[0] == 120]
    assert [g[2] for g in only] == [1, *range(100, 119)]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.search(df, F.col("vec_id") % 20 == 0).count() == 0
