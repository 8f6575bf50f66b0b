import random
import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cinequarry.llm import tokens
from cinequarry.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a  b", "a   b", " lead", "trail ", "a\n b", "a \nb", "don't stop's 'll", "word. word, word! word!!! naïve, naïve. a_b, x's. x', ×. a×. ½. a½, 3. a3. ª, aª.", "x\x85 y", "x\x1c y", " \x1c z", "12 345 6!? ..", "é è  ü", "<|endoftext|> a", "a <|endoftext|> b", "a\x00 b", "\n\nTitle\n\n\n Body", "\tq", "日本 語 テキスト", "a  b", "#", "w " * 3000, " \n", "end.\nNew line 's"]


def whole():
    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_pieces_equal_whole_texts():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a", "B", "é", " ", "  ", "\n", "\t", ".", "'s", "7", "　", "\x1d"]) for _ in range(30)) for _ in range(3000)]
    encode, want = tokens.Encoder(PATH, 2), whole()
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in encode(texts)] == [want(x) for x in texts]


def test_query(spark, tmp_path):
    rows = [(i * 7 % 1000, t, 5, "x") for i, t in enumerate(ODD * 4)] + [(5000, None, 1, "y"), (None, "null id", 1, "z"), (5001, "twice", 1, "a"), (5001, "again twice", 1, "b")]
    spark.createDataFrame(rows, "doc_id long, text string, start long, shard string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op3_token_shards"](spark, str(tmp_path)).collect()), key=lambda r: r[1])
    encode, want, start = whole(), [], 0
    for doc_id, text, *_ in spark.read.parquet(f"{tmp_path}/documents.parquet").orderBy("doc_id", F.xxhash64("text"), "text").collect():
        ids = np.array([*encode(text), 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_special_token_is_the_librarys(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    row = tokens.write_store(docs, PATH).read(docs.select(F.col("doc_id").alias("key"))).first()
    assert row.ids == [64, 220, 50256, 275, 2]


def test_one_key_reads_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BUCKET_KEYS", 100)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    store = tokens.write_store(docs, PATH)
    one = spark.createDataFrame([(17,)], "key long")
    index = store.index_for(one.select("key", tokens.bucket_of(store.buckets).alias("bucket")))
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert store.buckets == 30 and index.count() == 1
    assert re.search(r"PartitionFilters: \[isnotnull\(piece#\d+\), \(piece#\d+ = \d+\)\]", plan) and "PushedFilters: [IsNotNull(bucket), EqualTo(bucket," in plan
    assert [r.ids for r in store.read(one).collect()] == [[*whole()("text 17"), 2]]


def test_hot_and_least_ids(spark):
    """One id's rows fill several shards; the least long and a missing id keep apart."""
    hot = [(7, f"copy {i} {'long ' * 200}") for i in range(4000)]
    docs = spark.createDataFrame([(-(1 << 63), "least"), (None, "none"), (9, "other"), *hot], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    store = tokens.write_store(docs, PATH)
    keys = docs.select(F.coalesce("doc_id", F.lit(tokens.NULL_KEY)).alias("key")).distinct()
    got = store.read(keys).collect()
    assert len({r.part for r in got if r.key == 7}) > 1
    encode = whole()
    assert sorted([(r.key, tuple(r.ids)) for r in got], key=str) == sorted([(i, (*encode(t), 2)) for i, t in [(-(1 << 63), "least"), (None, "none"), (9, "other"), *hot]], key=str)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_cache_gives_up_old_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 20_000)
    encode, want = tokens.Encoder(PATH, 2), whole()
    for k in range(30):
        texts = [f"word{i} and word{i + k}, then" for i in range(k, k + 60)]
        assert [np.frombuffer(x, "<u2").tolist() for x in encode(texts)] == [want(x) for x in texts]
        assert len(encode.known) + len(encode.older) < 400


def test_a_word_is_kept_once_whatever_follows():
    encode, want = tokens.Encoder(PATH, 2), whole()
    texts = ["so " + " ".join("word" + s for s in (",", ".", ";", "-like", "'s", "2", "_x", "...", "")), "so\nword, naïve's naïve. naïve"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in encode(texts)] == [want(x) for x in texts]
    kept = [str(x) for x in encode.known]
    assert [sum(x.startswith(w) for x in kept) for w in (" word", "\nword", " naïve")] == [1, 1, 1]


def test_store_keyed_access(spark):
    docs = spark.range(3000).select((F.col("id") * 1_000_003 - 500_000_000).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    store = tokens.write_store(docs, PATH)
    some = docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("key"))
    strangers = spark.range(100).select((F.col("id") + 7_000_000_000).alias("key"))
    got = {r.key: r.ids for r in store.read(some.union(strangers)).collect()}
    encode = whole()
    assert got == {r.doc_id: [*encode(r.text), 2] for r in docs.where("doc_id % 5 = 0").collect()}


def test_wide_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "")], "doc_id long, text string")
    wide = tokens.write_store(docs, PATH, end_id=50256)
    assert [r.ids[-1] for r in wide.read(docs.select(F.col("doc_id").alias("key"))).collect()] == [50256, 50256]
    none = tokens.write_store(docs.where("doc_id > 5"), PATH)
    assert none.read(docs.select(F.col("doc_id").alias("key"))).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 100, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        hashed = tokens.PerfectHash.build(keys)
        assert sorted(hashed.slots(keys).tolist()) == list(range(len(keys)))
