"""Outputs against a plain reading of the rule, and the way back."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from cinequarry.llm import infilling

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, rate=infilling.RATE, spm=infilling.SPM):
    text = text or ""
    told = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(told[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def check(docs, rows, **options):
    df = infilling.infill(docs, **options)
    got = sorted([tuple(r) for r in df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()], key=str)
    assert got == sorted([(i, *brute(i, t, **options)) for i, t in rows], key=str)
    back = df.select("doc_id", infilling.restore(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)


def test_against_brute_force(spark):
    draw = random.Random(4)
    words = ["word", "naïve", "☃", "\U0001f600x", "<", "P>", "<S", "a" * 30, " ", " "]
    blanks = [" ", "  ", "\n", "\t \r\n", "\x0b", "\x0c"]
    texts = ["".join(draw.choice(words) + draw.choice(blanks) for _ in range(draw.randint(1, 40))) for _ in range(300)]
    rows = list(enumerate([*texts, "", None, " ", "\n\n\n", "  lead", "trail  ", "<P> here", "x<M>", "one", "a <S"]))
    check(rows_of(spark, rows).repartition(5), rows)


def test_every_document_cut(spark):
    rows = [(i, f" one{i} two\nthree") for i in range(50)]
    check(rows_of(spark, rows), rows, rate=100)
    check(rows_of(spark, rows), rows, rate=100, spm=0)


def test_repeats_and_ids(spark):
    """A third of all rows are one; another id has many texts; ids can be null."""
    cut = [i for i in range(60) if brute(i, "x y z")[1] != "plain"]
    rows = [(cut[0], "the same words again")] * 200 + [(cut[1], f"text number {i} of one id") for i in range(200)] + [(None, "no id at all"), (None, None), (cut[2], "the same words again")]
    check(rows_of(spark, rows).repartition(7), rows)


def test_long_text_and_blanks(spark):
    cut = next(i for i in range(60) if brute(i, "x")[1] != "plain")
    rows = [(cut, "word and " * 100_000), (cut, " " * 200_000), (cut, "y" * 300_000)]
    check(rows_of(spark, rows), rows)


def test_empty_table_clashes_and_string_ids(spark):
    docs = rows_of(spark, [(i, f"words of {i}") for i in range(20)])
    assert infilling.infill(docs.limit(0)).collect() == []
    names = ["form", "n", "doc", "copies", "part", "units", "until", "first", "second", "key_a", "output", "copy", "h"]
    wide = docs.select("*", *[F.lit("clash").alias(c) for c in names])
    check(wide, [(i, f"words of {i}") for i in range(20)])
    named = docs.select(F.col("doc_id").cast("string").alias("k"), F.col("text").alias("t"))
    assert {(r.doc_id, r.output) for r in infilling.infill(named, "k", "t").collect()} == {(str(r.doc_id), r.output) for r in infilling.infill(docs).collect()}


def test_units_are_not_shuffled(spark):
    """One exchange of texts, read by both sides of the join."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = infilling.infill(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") + plan.count("Exchange hashpartitioning(") <= 4 and "Exchange hashpartitioning(units" not in plan
