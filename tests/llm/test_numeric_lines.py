from cinequarry.llm import linededup as L


def test_rows_of_numbers_recur_only_if_equal(spark):
    row = lambda i, n: " ".join(str(i * 1000 + k) for k in range(n))
    same = row(99, 20)
    lines = lambda i: [row(i, 5), row(i, 20), f"total of {row(i, 18)}", same]
    docs = spark.createDataFrame([(i, "\n".join(lines(i))) for i in range(12)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in L.dedup_lines(docs).collect()}
    assert got == {i: "\n".join(lines(i)[:-1]) for i in range(12)}
