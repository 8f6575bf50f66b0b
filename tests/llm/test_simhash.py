import random

import xxhash

from cinequarry.llm import simhash


def naive_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    votes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))


def naive_components(ids, fps, radius=4):
    group = list(range(len(ids)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                group[top(i)] = top(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[top(i)] = min(least.get(top(i), x), x)
    return [least.get(top(i)) for i in range(len(ids))]


def texts():
    rng = random.Random(5)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota".split()) + str(rng.randint(0, 40)) for _ in range(rng.randint(5, 120))) for _ in range(60)]
    near = [" ".join(w if rng.random() > 0.02 else "x" for w in rng.choice(base).split()) for _ in range(60)]
    return base + near + [base[0]] * 12 + [None, "", " \t\n", "one", "One\x0bTWO", "É É É É", "long word " * 4000]


def test_matches_brute_force(spark):
    rows = [(i * 3, t, "extra", i) for i, t in enumerate(texts())] + [(6, texts()[2], "extra", 2), (None, texts()[0], "x", 0), (None, "nothing like it", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, salt int").repartition(5)
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    fps = [naive_fingerprint(t) for _, t, *_ in rows]
    want = naive_components([r[0] for r in rows], fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    assert got == sorted([(r[0], f, c) for r, f, c in zip(rows, signed, want)], key=str)
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for i, c in zip([r[0] for r in rows], want) if i == c and i is not None})
    assert kept.where("doc_id is null").count() == 2


def test_links_of_every_shard_split(spark):
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    values = {rng.getrandbits(64) for _ in range(200)} | {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(300)}
    fps = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = naive_components(sorted(fps), sorted(values, key=lambda v: v - (1 << 64) if v >> 63 else v))
    for target, limit in ((64, 4096), (1, 4096), (64, 20)):
        from cinequarry.llm.common import connected_components

        labels = dict(map(tuple, connected_components(simhash.fingerprint_links(df, 4, target, limit), spark).collect()))
        assert [labels.get(f, f) for f in sorted(fps)] == want


def test_copies_of_a_fingerprint_do_not_grow_with_the_table(spark, monkeypatch):
    """With more fingerprints the blocks are more (here 5, 6 and 8), but not the rows dealt to tasks."""
    from pyspark.sql.classic.dataframe import DataFrame

    from cinequarry.llm.common import connected_components

    dealt, plain = [], DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda df, *columns: dealt.append(df.count()) or plain(df, *columns))
    rng = random.Random(11)
    centres = [rng.getrandbits(64) for _ in range(100)]
    values = {rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for _ in range(500)}
    fps = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = naive_components(sorted(fps), sorted(values, key=lambda v: v - (1 << 64) if v >> 63 else v))
    for target in (64, 2**-10, 2**-20):
        labels = dict(map(tuple, connected_components(simhash.fingerprint_links(df, 4, target, 4096), spark).collect()))
        assert [labels.get(f, f) for f in sorted(fps)] == want
    assert dealt == [5 * len(fps)] * 3


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one_per_group(docs).count() == 0
