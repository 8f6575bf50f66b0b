import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinequarry.llm import mixing


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    base, bad, rude = [f"w{i}" for i in range(300)], [f"!{i}" for i in range(15)], [f"r{i}" for i in range(15)]
    rows, labels = [], []
    for i in range(900):
        kind = 2 if i % 10 == 0 else 1 if i % 10 in (1, 2) else 0
        words = [rng.choice(base) for _ in range(rng.randint(20, 120))] + [rng.choice((base, bad, rude)[kind]) for _ in range(8)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), "x", i))
        if i < 600:
            labels.append((i, int(kind != 1), int(kind == 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate string, _extra int")
    return docs.repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_posteriors_on_held_out_rows(spark, tables):
    got = mixing.mix(*tables).where("doc_id >= 600").collect()
    right = sum((r.p_good, r.p_poor, r.p_toxic).index(max(r.p_good, r.p_poor, r.p_toxic)) == (2 if r.doc_id % 10 == 0 else 1 if r.doc_id % 10 in (1, 2) else 0) for r in got)
    assert right / len(got) > 0.95
    assert all(abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-5 for r in got)


def nonnegative(n, p, aims, rounds=20000):
    """Plain projected gradient over all rates, one step length."""
    a = n[:, None] * p
    length = 1 / np.linalg.norm(a, 2) ** 2
    r = np.ones(len(n))
    for _ in range(rounds):
        r = np.clip(r - length * a @ (r @ a - aims), 0, mixing.MAX_RATE)
    return np.linalg.norm(r @ a - aims)


def test_targets_are_met(spark, tables):
    for targets in (None, {"good": 0.6, "poor": 0.3, "toxic": 0.1}, {"good": 0.5, "poor": 0.5, "toxic": 0.0}):
        got = mixing.mix(*tables, targets).collect()
        n, r = np.array([x.n_tokens for x in got], float), np.array([x.rate for x in got])
        p = np.array([[x.p_good, x.p_poor, x.p_toxic] for x in got])
        assert r.min() >= 0 and r.max() <= mixing.MAX_RATE
        now, have = (n[:, None] * p).sum(0), ((n * r)[:, None] * p).sum(0)
        w = np.array(list((targets or mixing.TARGETS).values()))
        aims = w / w[0] * now[0]
        missed = np.abs(have - aims).sum() / aims.sum()
        told = got[0]
        assert np.allclose([told.wanted_good, told.wanted_poor, told.wanted_toxic], aims, rtol=1e-4)
        assert np.allclose([told.expected_good, told.expected_poor, told.expected_toxic], have, rtol=1e-3, atol=1e-3 * aims.sum())
        assert abs(told.missed - missed) < 2e-3
        assert missed < 1e-3 or np.linalg.norm(have - aims) <= 1.05 * nonnegative(n, p, aims) + 1e-3 * aims.sum(), (targets, have, aims)


def test_what_cannot_be_met_is_told(spark, tables):
    docs, labels = tables
    sized = mixing.with_posteriors(docs, mixing.learn(docs, labels)).select("_n", "_p")
    met = mixing.solve(sized, {"good": 0.7, "poor": 0.2, "toxic": 0.1})
    assert met.missed < 1e-3 and len(met.steps) < mixing.ROUNDS
    own = sized.selectExpr("sum(_n)").first()[0]
    far = mixing.solve(sized, {"good": 0.0, "poor": 0.0, "toxic": 1.0}, size=10 * own)
    assert far.missed > 0.5 and far.wanted[2] == 10 * own


def test_draw_follows_rates(spark, tables):
    docs, labels = tables
    rates = {r.doc_id: r.rate for r in mixing.mix(docs, labels).collect()}
    out = mixing.draw(docs, labels)
    assert out.columns == docs.columns
    copies = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(np.floor(rates[i] - 1e-5) <= copies.get(i, 0) <= np.floor(rates[i]) + 1 for i in rates)
    assert all(copies.get(i, 0) >= 1 for i, r in rates.items() if r >= 1)
    again = {r.doc_id: r["count"] for r in mixing.draw(docs.repartition(7), labels).groupBy("doc_id").count().collect()}
    assert again == copies


def test_nulls_and_empty_tables(spark, tables):
    _, labels = tables
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "w1 w2"), (3, "word " * 50_000)], "doc_id long, text string")
    got = mixing.mix(docs, labels)
    assert got.count() == 5 and got.where("p_good is null or rate is null").count() == 0
    none = labels.where(F.lit(False))
    assert [round(r.p_good, 3) for r in mixing.mix(docs, none).collect()] == [0.333] * 5
    empty = docs.where(F.lit(False))
    assert mixing.mix(empty, labels).count() == 0 and mixing.draw(empty, labels).count() == 0
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 1), (2, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert mixing.mix(docs, odd).count() == 5
