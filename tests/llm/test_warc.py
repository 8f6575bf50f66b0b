import gzip
import hashlib

from pyspark.sql import functions as F

from cinequarry.llm import warc
from cinequarry.llm.queries import QUERIES


def rows():
    same = "<p>" + "same body " * 20 + "</p>"
    pages = [(i, f"http://h{i % 3}.example.org/{i}", f"<p>{'x' * i * 7}é\r\n\r\nWARC/1.1\r\n</p>", i) for i in range(40)]
    pages += [(100 + i, f"http://copy/{i}", same, 1) for i in range(30)]
    pages += [(200, None, None, 0), (201, "no scheme\r\nX: y", "", 0), (202, "http://s", "short", 0), (203, "http://s", "short", 0), (105, "http://copy/5", same, 1), (None, "http://n", same, 2)]
    return pages


def expected(pages):
    first = {}
    for page_id, _, html, _ in pages:
        body = (html or "").encode()
        if len(body) >= 100:
            first[body] = min(first.get(body, 1 << 63), (1 << 62) if page_id is None else page_id)
    out = []
    for page_id, _, html, _ in pages:
        body = (html or "").encode()
        least = first.get(body, page_id)
        revisit = len(body) >= 100 and least != page_id
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", least if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string, payload int").repartition(3)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op1_warc_captures"](spark, str(tmp_path))
    assert sorted([tuple(r)[:5] for r in got.collect()], key=str) == expected(rows())
    assert got.where("request_id is null").count() == 0


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["op1_warc_captures"](spark, str(tmp_path)).count() == 0


def test_parse_members_and_cut_records():
    def record(kind, body, extra=b""):
        return b"WARC/1.1\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <a>\r\n" + extra + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"

    big = b"z" * 3_000_000
    plain = record(b"resource", b"one") + record(b"resource", big, b"WARC-Concurrent-To: <b>\r\nWARC-Concurrent-To: <c>\r\n")
    for raw in (plain, gzip.compress(plain), gzip.compress(plain[:80]) + gzip.compress(plain[80:]), b"".join(gzip.compress(record(b"resource", x)) for x in (b"one", big))):
        got = list(warc.parse(raw))
        assert [r["payload"] for r in got] == [b"one", big]
    assert list(warc.parse(plain))[1]["concurrent_to"] == ["<b>", "<c>"]
    assert [r["payload"] for r in warc.parse(plain[:-50])] == [b"one"]


def test_assembly_follows_links_both_ways(spark):
    def r(i, kind, to=()):
        return (i, kind, list(to), f"u{i}", "d", None, None, {"k": i}, "GET" if kind == "request" else None, b"")

    records = [
        r("r1", "response"), r("q1", "request", ["r1"]), r("m1", "metadata", ["q1"]), r("m2", "metadata", ["r1"]),
        r("q2", "request"), r("r2", "response", ["q2"]), r("m3", "metadata", ["q2"]),
        r("q3", "request"), r("m4", "metadata", ["q3"]), r("m5", "metadata", ["gone"]), r("v1", "revisit"), r("m5", "metadata", ["gone"]), r(None, "request"),
    ]
    df = spark.createDataFrame(records, warc.RECORD)
    got = {x.capture_id: (x.response and x.response.record_id, x.request and x.request.record_id, [m.record_id for m in x.metadata]) for x in warc.assemble(df).collect()}
    assert got == {"r1": ("r1", "q1", ["m1", "m2"]), "r2": ("r2", "q2", ["m3"]), "q3": (None, "q3", ["m4"]), "gone": (None, None, ["m5"]), "v1": ("v1", None, [])} or got.get("m5") == (None, None, ["m5"])
    assert warc.assemble(df.where(F.lit(False))).count() == 0
