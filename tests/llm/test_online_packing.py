"""Whole packings without padding, placed as the plain rule says."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cinequarry.llm import online_packing as op

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_level(counts, n, size):
    """Tries every level and sums up all squares."""
    tries = []
    for level in range(size - n + 1):
        if level and not counts[level]:
            continue
        after = list(counts)
        after[level] -= bool(level)
        after[level + n] += level + n < size
        tries.append((sum(x * x for x in after), -level))
    return -min(tries)[1]


def test_level_by_all_squares():
    draw = random.Random(2)
    for size in (4, 16, 64):
        counts = np.zeros(size + 1, np.int64)
        for _ in range(400):
            n = draw.randint(1, size - 1)
            level = op.least_squares_level(counts, n)
            assert level == plain_level(counts, n, size)
            counts[level] -= bool(level)
            counts[level + n] += level + n < size


def stretches(windows):
    found = {}
    for sequence in windows.done:
        n = sum(len(p[2]) for p in sequence)
        assert 0 < n <= windows.size and (n == windows.size or op._is_power(n))
        for document, start, ids in sequence:
            assert len(ids)
            found.setdefault(document, []).append((start, ids))
    return found


@pytest.mark.parametrize("lengths", [[3] * 7, [40] * 99, list(range(1, 200)), [64, 65, 63, 129, 1], [1], [33, 33]])
def test_every_id_once_and_no_padding(lengths):
    windows = op.Windows(64)
    docs = [np.arange(n) + 1000 * i for i, n in enumerate(lengths)]
    for i, ids in enumerate(docs):
        windows.add(i, ids)
    windows.settle()
    assert not windows.open and not windows.counts.any()
    found = stretches(windows)
    for i, ids in enumerate(docs):
        parts = sorted(found[i], key=lambda p: p[0])
        assert [s for s, _ in parts] == np.cumsum([0, *[len(p) for _, p in parts[:-1]]]).tolist()
        assert np.concatenate([p for _, p in parts]).tolist() == ids.tolist()


def test_few_windows_open(monkeypatch):
    """Items that never pair are settled when as many windows are open as may be."""
    monkeypatch.setattr(op, "MOST_OPEN", 16)
    windows, most = op.Windows(64), 0
    for i in range(500):
        windows.add(i, np.arange(40))
        most = max(most, windows.open)
    windows.settle()
    assert most < 16 and sum(len(p[2]) for s in windows.done for p in s) == 20_000
    stretches(windows)


def test_documents_that_fit_are_cut_only_at_the_end():
    draw = random.Random(5)
    windows = op.Windows(64)
    for i in range(3000):
        windows.add(i, np.arange(draw.randint(1, 32)))  # sizes that leave few windows open
    whole = {d for s in windows.done for d, *_ in s}
    open_before = windows.open
    assert all(start == 0 for s in windows.done for _, start, _ in s)
    windows.settle()
    assert open_before < 64 and len(whole) > 2800


def rows_by_document(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.doc_id, []).append(r)
    return found


def checked(df):
    rows = df.collect()
    for sequence in {r.sequence_id for r in rows}:
        own = sorted((r for r in rows if r.sequence_id == sequence), key=lambda r: r.offset)
        total = 0
        for r in own:
            assert r.offset == total and r.length > 0 and len(r.ids) == 4 * r.length
            total += r.length
        assert total == op.WINDOW or op._is_power(total)
    return rows


def test_ids_of_pieces(spark):
    draw = random.Random(3)
    words = "some plain words, of a text\nthat   is longer ☃ naïve <|endoftext|>".split(" ")
    texts = [None, "", " ", "word " * 5000, *[" ".join(draw.choices(words, k=draw.randint(1, 900))) for _ in range(60)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tokenizer = Tokenizer.from_file(PATH)
    rows = checked(op.pack_online(docs, PATH))
    assert {r.doc_id for r in rows} == set(range(len(texts)))
    for doc_id, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == ids
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own[:-1]]]).tolist()
        assert {r.doc_tokens for r in own} == {len(ids)}


def test_query_checks(spark):
    from cinequarry.llm.queries import op12_online_packing

    sf = "/root/testdata/sf0.001"
    tokenizer = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = rows_by_document(op12_online_packing(spark, sf))
    assert set(got) == set(texts)
    for doc_id, rows in got.items():
        ids = np.array([*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert sum(r.length for r in rows) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in rows)


def test_repeats_nulls_empty_and_clashes(spark):
    docs = spark.createDataFrame([(7, "same words")] * 40 + [(None, None)], "doc_id long, text string")
    wide = docs.select("*", *[F.lit("clash").alias(c) for c in ("start", "length", "ids", "sequence_id", "offset", "doc_tokens")])
    rows = checked(op.pack_online(wide, PATH))
    assert sum(r.length for r in rows if r.doc_id == 7) == 40 * 3 and sum(r.length for r in rows if r.doc_id is None) == 1
    assert op.pack_online(docs.limit(0), PATH).collect() == []
    named = docs.select(F.col("doc_id").cast("string").alias("k"), F.col("text").alias("t"))
    assert sum(r.length for r in op.pack_online(named, PATH, "k", "t").collect()) == 121
    with pytest.raises(ValueError):
        op.pack_online(docs, PATH, window=1000)
