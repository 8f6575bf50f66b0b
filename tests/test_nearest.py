"""Nearest anchors by bounds of cells, and lazy greedy choices, against all pairs."""

import random

import numpy as np
import pytest

from cinequarry.operators import similarity


def frame(spark, m, parts=3):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>").repartition(parts)


def clustered(rng, n, dims, centres):
    x = centres[rng.integers(len(centres), size=n)] + rng.normal(scale=0.05, size=(n, dims))
    return x / np.linalg.norm(x, axis=1)[:, None]


def nearest(a, b):
    s = np.round(a @ b.T, 12)
    return [(i, int(s[i].argmax())) for i in range(len(a))]


@pytest.mark.parametrize("block,cell", [(4096, 1024), (25, 30), (4096, 4)])
def test_all_kinds_of_vectors(spark, block, cell):
    """Uneven lengths, equal anchors, a zero on each side."""
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(120, 5)) * rng.lognormal(sigma=2, size=(120, 1)), rng.normal(size=(90, 5)) * rng.lognormal(sigma=2, size=(90, 1))
    b[7], b[60], a[5], b[80] = b[3], b[3], 0, 0
    got = similarity.best_anchors(frame(spark, a), frame(spark, b), block, cell).collect()
    assert sorted((r.id, r.anchor) for r in got if r.id != 5) == [x for x in nearest(a, b) if x[0] != 5]
    assert [r.anchor for r in got if r.id == 5] == [0]
    assert all(abs(r.similarity - a[r.id] @ b[r.anchor]) < 1e-9 for r in got)


def test_bounds_hold():
    rng = np.random.default_rng(8)
    b, x = rng.normal(size=(400, 6)) * rng.lognormal(size=(400, 1)), rng.normal(size=(50, 6))
    cells = similarity.Cells(b[:20])
    at, reach, angle, length = cells.place(b)
    most = lambda v: np.array([v[at == c].max(initial=0) for c in range(20)])
    cells.reach, cells.angle, cells.longest, cells.sizes = most(reach), most(angle), most(length), np.bincount(at, minlength=20)
    bounds = cells.bounds(x)
    assert all((bounds[:, c] >= (x @ b[at == c].T).max(axis=1)).all() for c in range(20) if (at == c).any())


def test_share_of_pairs_falls(spark):
    """Of clustered vectors, each candidate sees a part of the anchors, less of a larger table."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    shares = []
    for n in (600, 2400):
        a, b = clustered(rng, 150, 16, centres), clustered(rng, n, 16, centres)
        got = similarity.best_anchors(frame(spark, a), frame(spark, b), cell=30).collect()
        assert sorted((r.id, r.anchor) for r in got) == nearest(a, b)
        shares.append(sum(r.seen for r in got) / (150 * n))
    assert shares[0] < 0.6 and shares[1] < shares[0]


def test_hot_cell_and_empty_sides(spark):
    """A third of the anchors are equal: their cell is dealt out in blocks."""
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(60, 4)), rng.normal(size=(300, 4))
    b[:100] = b[0]
    got = similarity.best_anchors(frame(spark, a), frame(spark, b), 16, 20).collect()
    assert sorted((r.id, r.anchor) for r in got) == nearest(a, b)
    assert similarity.best_anchors(frame(spark, a), frame(spark, b).where("id < 0")).collect() == []
    assert similarity.best_anchors(frame(spark, a).where("id < 0"), frame(spark, b)).collect() == []


def greedy(rows, per_group, weight):
    """(id, grp) in order of choice; rows are (id, grp, v, similarity)."""
    chosen = []
    for g in sorted({r[1] for r in rows}, key=lambda g: (sum(r[1] == g for r in rows), g)):
        for _ in range(per_group):
            score = lambda r: r[3] - weight * max([0.0] + [float(np.dot(r[2], c[2])) for c in chosen])
            free = [r for r in rows if r[1] == g and r not in chosen]
            if free:
                chosen.append(max(free, key=lambda r: (score(r), r[3], r[0])))
    return [(r[0], r[1]) for r in chosen]


def rows_of(n, groups, dims, seed, ties=False):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1)[:, None]
    draw = random.Random(seed)
    return [(i, f"g{draw.randrange(groups)}", v[i].tolist(), round(draw.random(), 1 if ties else 6)) for i in range(n)]


def chosen_of(spark, rows, *args, **options):
    df = spark.createDataFrame(rows, "id long, grp string, v array<double>, similarity double").repartition(3)
    got = similarity.select_diverse(df, *args, **options).orderBy("place").collect()
    assert [r.place for r in got] == list(range(len(got)))
    return [(r.id, r.grp) for r in got]


@pytest.mark.parametrize("taken,groups,weight", [(256, 64, 0.5), (3, 64, 0.5), (2, 1, 2.0), (1, 2, 0.9)])
def test_greedy_choice(spark, taken, groups, weight):
    """However few rows a round takes along, stale bounds don't change what is chosen."""
    rows = rows_of(60, 3, 4, 5)
    assert chosen_of(spark, rows, 4, weight, taken=taken, groups=groups) == greedy(rows, 4, weight)


def test_greedy_ties(spark):
    rows = rows_of(40, 2, 3, 9, ties=True)
    rows += [(i + 100, *r[1:]) for i, r in enumerate(rows[:15])]
    for taken in (2, 256):
        assert chosen_of(spark, rows, 5, 0.0, taken=taken) == greedy(rows, 5, 0.0)


def test_rounds_do_not_grow_with_choices(spark, monkeypatch):
    """Rounds are counted by the tables they write."""
    rows, written = rows_of(300, 3, 8, 11), []
    plain = similarity.written
    monkeypatch.setattr(similarity, "written", lambda df, name: written.append(name) or plain(df, name))
    rounds = []
    for per_group in (3, 30):
        written.clear()
        assert chosen_of(spark, rows, per_group, 0.3) == greedy(rows, per_group, 0.3)
        rounds.append(written.count("choices"))
    assert rounds == [1, 1]


def test_candidates_run_out(spark):
    rows = rows_of(12, 2, 3, 3) + [(99, "few", [1.0, 0.0, 0.0], 0.5)]
    with pytest.raises(ValueError, match="few"):
        chosen_of(spark, rows, 2, 0.5)
    assert chosen_of(spark, rows, 2, 0.5, partial=True) == greedy(rows, 2, 0.5)
    assert chosen_of(spark, rows, 50, 0.5, partial=True) == greedy(rows, 50, 0.5)
    df = spark.createDataFrame(rows, "id long, grp string, v array<double>, similarity double")
    assert similarity.select_diverse(df.where("id < 0"), 2, 0.5).collect() == []
