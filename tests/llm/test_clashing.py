"""Extra columns whose names an operator also uses don't matter."""

from pyspark.sql import functions as F

from cinequarry.llm import licenses, linededup, mixing, neighbours, packing, quality, simhash, urls

NAMES = ["fp", "salt", "id", "component", "score", "kept", "rate", "n_tokens", "line", "lines", "leaf", "code", "bin_id", "piece", "words", "pack_group", "host", "path", "verdict", "at", "rep", "asks", "vector", "places", "x", "_w", "_h", "_g", "_p", "_n", "_b", "_c", "_r", "_t", "_id", "_gone", "_kept", "_cells", "_keep", "_kept_id"]


def wide(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in NAMES])


def test_documents(spark):
    docs = wide(spark.createDataFrame([(i, f"some words of text number {i} " * 4) for i in range(30)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    assert simhash.near_duplicates(docs).count() == 30
    assert simhash.keep_one_per_group(docs).columns == docs.columns
    assert quality.judge(docs, quality.fit(docs, labels)).count() == 30
    assert linededup.dedup_lines(docs).count() == 30
    assert packing.pack(docs).count() == 30
    assert mixing.mix(docs, labels).count() == 30 and mixing.draw(docs, labels).columns == docs.columns
    assert licenses.scan(docs).count() == 30


def test_other_tables(spark):
    pages = wide(spark.createDataFrame([(i, f"http://h{i}.com/a") for i in range(5)], "page_id long, url string"))
    assert urls.judge(pages).count() == 5
    vectors = wide(spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(25)], "vec_id long, embedding array<float>"))
    assert neighbours.search(vectors, F.col("vec_id") % 20 == 0).count() == 40
