import math
import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from cinequarry.llm import quality


def naive(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "日本", "#", "a|b", "x\x85y", " "]
    out = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 200))) for _ in range(80)]
    out += [t + "\n" + t for t in out[:20]] + [t + "\n\n" + t[:100] + "\n" + t for t in out[20:40]]
    return out + [None, "", " \t\n", "a b c d e f g", "a b c d e f g h", "a " * 400, "a b c d " * 30, "\x0bx\x0cy\x1cz", "line\nline\n \n \nline ", "one " * 7 + "two " + "one " * 7 + "two one", "long " * 30_000]


def test_counts(spark):
    rows = [(i, t, 7, "x") for i, t in enumerate(texts())] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, score string").repartition(3)
    model = quality.QualityModel([0] * 64, None)
    got = quality.judge(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = sorted((i, *n, not n[-1]) for i, t, *_ in rows for n in [naive(t)])
    assert sorted(map(tuple, got)) == want


def test_model_tells_junk_on_held_out_rows(spark):
    rng = random.Random(9)
    good = [f"g{i}" for i in range(200)]
    junk = [f"J{i}!!" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, " ".join(rng.choice(junk if bad and rng.random() < 0.7 else good) for _ in range(80))))
        if i < 400:
            labels.append((i, int(not bad), 0))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, known, lost=0.0)
    again = quality.fit(docs.repartition(5), known)
    assert again.weights == model.weights
    held = {r.doc_id: r.kept for r in quality.judge(docs.where("doc_id >= 400"), model).collect()}
    assert sum(held[i] == (i % 5 != 0) for i in held) / len(held) >= 0.97


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "word " * 19 + "end"), (None, "some words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, none)
    assert model.threshold is None
    assert quality.judge(docs, model).count() == 2
    empty = docs.where(F.lit(False))
    assert quality.judge(empty, quality.fit(empty, none)).count() == 0


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def grams(text):
    """Hashes of words and of pairs of words; a pair's is that of the second under the first's as seed."""
    words = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    one = lambda h, seed: xxhash.xxh64(struct.pack("<q", h), seed=seed).intdigest()
    return words + [signed(one(b, one(a, 42))) for a, b in zip(words, words[1:])]


def test_weights_threshold_and_verdicts_by_brute_force(spark):
    rng = random.Random(11)
    own, other = [f"o{i}" for i in range(60)], [f"x{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(other if i % 4 == 0 and rng.random() < 0.8 else own) for _ in range(rng.choice([0, 5, 25, 60, 90])))) for i in range(240)] + [(500, None), (501, "o1 " * 30), (3, "o1 o2 o3")]
    labels = [(i, int(i % 4 != 0), int(i % 9 == 0)) for i in range(0, 200)] + [(0, 1, 0), (7, 1, 0), (7, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    buckets, lost, prior = 512, 0.05, quality.PRIOR
    model = quality.fit(docs, known, buckets=buckets, lost=lost)

    trusted = sorted({i for i, q, t in labels if q == 1 and t == 0})
    half = lambda i: signed(xxhash.xxh64(struct.pack("<i", 1), seed=xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()).intdigest()) % 2 == 0
    raw, mine = [0.5] * buckets, [0] * buckets
    for i, text in rows:
        for h in grams(text):
            raw[h % buckets] += 1
            mine[h % buckets] += i in trusted and half(i)
    ratio = [math.log((m + prior * r / sum(raw)) / (sum(mine) + prior) / (r / sum(raw))) for m, r in zip(mine, raw)]
    weights = [round(quality.SCALE * x) for x in ratio]
    assert model.weights == weights and any(weights)

    def score(text):
        told = grams(text)
        return sum(weights[h % buckets] for h in told) / (len(told) * quality.SCALE) if told else 0.0

    held = sorted(score(t) for i, t in rows if i in trusted and not half(i) and len((t or "").split()) >= 20)
    at = lost * (len(held) - 1)
    threshold = held[int(at)] + (at - int(at)) * (held[min(int(at) + 1, len(held) - 1)] - held[int(at)])
    assert abs(model.threshold - threshold) < 1e-12
    got = sorted((r.doc_id, round(r.score, 9), r.kept) for r in quality.judge(docs, model).collect())
    want = sorted((i, round(score(t), 9), not naive(t)[-1] and score(t) >= model.threshold) for i, t in rows)
    assert got == want and {k for *_, k in got} == {True, False}
