import random
import time

import numpy as np
from pyspark.sql import functions as F

from cinequarry.llm import linededup as L


def templates(words):
    """(key, fixed tokens) of a line's templates."""
    masked = ["\0" if any(c.isdigit() and c.isascii() for c in w) else w for w in words]
    if sum(w != "\0" for w in masked) < L.SIMILARITY * len(words):
        return [(("as it is", *words), len(words))]
    lead, rest = masked[: L.DEPTH], masked[L.DEPTH :]
    runs = [rest[len(rest) * i // L.RUNS : len(rest) * (i + 1) // L.RUNS] for i in range(L.RUNS)]
    out = []
    for left_out in range(L.RUNS):
        told = [tuple(r) if i != left_out else None for i, r in enumerate(runs)]
        fixed = sum(w != "\0" for w in lead + [w for r in told if r for w in r])
        out.append(((len(words), tuple(lead), *told, left_out), fixed))
    return out


def naive(docs, keep_first=False):
    """Dictionaries of all templates' documents."""
    of, lines = {}, []
    for row, (doc_id, text) in enumerate(docs):
        for at, line in enumerate((text or "").split("\n") if doc_id is not None else []):
            for key, fixed in templates(line.split()) if line.split() else []:
                of.setdefault((key, fixed), set()).add((row, doc_id))
                lines.append((doc_id, text, at, (key, fixed)))
    gone = {}
    for doc_id, text, at, key in lines:
        ids = {i for _, i in of[key]}
        if len(ids) > 1 and key[1] * (len(of[key]) - 1) >= L.EVIDENCE and not (keep_first and doc_id == min(ids)):
            gone.setdefault((doc_id, text), set()).add(at)
    return gone


def corpus():
    rng = random.Random(11)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op".split()) + rng.choice("qrstuvwxyz")
    passages = [" ".join(word() for _ in range(60)) for _ in range(3)]
    docs = []
    for i in range(60):
        lines = [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(6)]
        if i % 3 == 0:
            lines.insert(2, passages[i % 9 // 3])
        if i % 2:
            lines.append(f"Posted on 20{i}-01-0{i % 9} by user {i} in the forum")
        if i % 7 == 0:
            lines += ["All rights reserved.", "", "   "]
        docs.append((i, "\n".join(lines)))
    near = docs[5][1].replace("\n", " x\n", 1)
    return docs + [(100, docs[4][1]), (101, near), (102, None), (103, ""), (104, "\n\n"), (None, docs[4][1]), (105, "long line " * 5000), (106, "long line " * 5000)]


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_lines string").repartition(5)
    for keep_first in (False, True):
        want = naive(rows, keep_first)
        got = {r.doc_id: (r.n_dropped, r.text, r.n_lines, r.kept_words, r.all_words) for r in L.dedup_lines(docs, keep_first=keep_first).collect()}
        for doc_id, text in rows:
            gone = want.get((doc_id, text), set())
            left = None if text is None else "\n".join(x for at, x in enumerate(text.split("\n")) if at not in gone)
            assert got[doc_id] == (len(gone), left, len((text or "").split("\n")), len((left or "").split()), len((text or "").split())), doc_id
        assert not any(i in got and got[i][0] for i in (None, 102, 103, 104))
        assert got[106][0] == 1 and got[105][0] == (not keep_first)
        assert all(got[i][0] for i in range(3 if keep_first else 0, 60, 3) if not (keep_first and i < 9))


def test_documents_are_counted_once(spark):
    """Seven lines of a template in one document and one in another are two documents."""
    rows = [(1, "\n".join(f"seen {i} times in the log" for i in range(7))), (2, "seen 9 times in the log")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert naive(rows) == {} and L.dedup_lines(docs).where("n_dropped > 0").count() == 0
    more = rows + [(i, f"seen {i} times in the log") for i in range(3, 9)]
    got = {r.doc_id: r.n_dropped for r in L.dedup_lines(spark.createDataFrame(more, "doc_id long, text string")).collect()}
    assert got == {i: len(x) for (i, _), x in naive(more).items()} == {1: 7, **{i: 1 for i in range(2, 9)}}


def test_variable_field_in_any_run(spark):
    words = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    change = lambda at: " ".join("other" if i == at else w for i, w in enumerate(words))
    for at, goes in ((None, True), (5, True), (15, True), (25, True), (0, False)):
        docs = spark.createDataFrame([(1, " ".join(words)), (2, change(at))], "doc_id long, text string")
        assert L.dedup_lines(docs).where("n_dropped = 1").count() == (2 if goes else 0), at


def test_hot_node_with_many_unlike_lines(spark):
    """Leading fields alike, everything else not: no line is compared with another."""
    rng = random.Random(3)
    rows = [(i, " ".join(["12:00", "0", "1", "2", *("".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(12))])) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert L.dedup_lines(docs).where("n_dropped > 0").count() == 0


def test_slices_and_long_texts(monkeypatch):
    text = "\n".join(f"line {i} of a long text, {'x' * (i % 50)} ends" for i in range(400))
    whole = [x.tolist() for x in L._tokens(np.frombuffer(text.encode(), np.uint8), L._Runs())]
    monkeypatch.setattr(L, "_CHUNK", 37)
    assert [x.tolist() for x in L._tokens(np.frombuffer(text.encode(), np.uint8), L._Runs())] == whole


def test_a_million_lines(spark):
    text = "\n".join(f"own{i}" for i in range(1_000_000)) + "\n" + (same := "a line of twenty words " * 4 + "that two texts share")
    docs = spark.createDataFrame([(1, text), (2, f"{same}\nown words")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_words) for r in L.dedup_lines(docs).drop("text").collect()}
    assert got == {1: (1_000_001, 1, 1_000_000), 2: (2, 1, 2)} and time.time() - began < 90


def test_empty_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "same text of a document that has more than sixteen words in it so that it could be dropped"), (1, "same text of a document that has more than sixteen words in it so that it could be dropped")], "doc_id long, text string")
    assert L.dedup_lines(docs).where("n_dropped > 0").count() == 0
    assert L.dedup_lines(docs.where(F.lit(False))).count() == 0


def test_rows_of_one_id_lose_their_own_lines(spark):
    """A line that recurs nowhere stays, whatever lines other rows of its id lose."""
    common = "a line of ten words that several of the documents hold"
    rows = [(50, f"{common}\nfirst row only"), (50, f"a unique line that no other document has got at all\n{common}"), (51, common), (52, f"x\n{common}"), (52, f"x\n{common}")]
    want = naive(rows)
    got = sorted((r.doc_id, r.text, r.n_dropped) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    left = lambda i, t: "\n".join(x for at, x in enumerate(t.split("\n")) if at not in want.get((i, t), set()))
    assert got == sorted((i, left(i, t), len(want.get((i, t), set()))) for i, t in rows)
    assert (50, "a unique line that no other document has got at all", 1) in got and (50, "first row only", 1) in got
