"""WARC archives: writing captures, reading records back, and putting the records of a
capture together again over their concurrent-to identifiers.

Archives are written by Spark's own text writer, a record a row with the record's end as
line end, so they can go to any file system. Each file is one gzip stream."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALTS, group_minimum, materialize, salt_of

#: Payloads below this many bytes are never told as revisits.
LEAST_REVISIT = 100
#: Date of records of pages that have none.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, type string, concurrent_to array<string>, target_uri string, date string, refers_to string, payload_digest string, fields map<string,string>, http string, payload binary"
_READ = 1 << 20


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """Bytes of a record (as a string that is never decoded): headers that are null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), v if isinstance(v, Column) else F.lit(v), F.lit("\r\n")) for name, v in headers]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.lit("WARC/1.1\r\n"), *[F.coalesce(x, F.lit("")) for x in lines], size, block)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_pages(pages: DataFrame, path: str, salts: int = SALTS) -> None:
    """Write a response (or revisit), a request and a metadata record for every row
    (page_id, url, html). Of equal payloads of LEAST_REVISIT bytes or more, the row with
    the smallest page_id is the response, others revisit it.

    The payload is the html in UTF-8, empty for null; a null url gives an empty target,
    line ends within a url become spaces. A record's identifier is told from its page_id
    and payload, so writing again writes the same; rows that repeat both are written as
    often, as responses if they have the smallest id. A null page_id is larger than any."""
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", " ").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    df = df.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html")).withColumn("salt", salt_of(F.col("page_id"), salts))
    long_enough = df.where(F.col("bytes") >= LEAST_REVISIT).select("digest", "salt", F.coalesce("page_id", F.lit((1 << 63) - 1)).alias("order"))
    again = group_minimum(long_enough, "digest", "order").where("n > 1").select("digest", F.col("least").alias("first"), F.explode("salts").alias("salt"))
    df = df.join(again, ["digest", "salt"], "left")
    is_revisit = F.coalesce(F.col("first") < F.coalesce("page_id", F.lit((1 << 63) - 1)), F.lit(False))
    df = df.withColumn("revisit", is_revisit)
    capture = _urn(F.lit("capture"), F.col("page_id"), F.col("digest"))
    request = _urn(F.lit("request"), F.col("page_id"), F.col("digest"))
    notes = _urn(F.lit("metadata"), F.col("page_id"), F.col("digest"))
    original = F.when(F.col("revisit"), _urn(F.lit("capture"), F.col("first"), F.col("digest")))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", DATE)]
    response = _record(
        [
            ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), ("WARC-Record-ID", capture), *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("WARC-Refers-To", original), ("WARC-Profile", F.when(F.col("revisit"), PROFILE)),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        F.when(F.col("revisit"), head).otherwise(F.concat(head, F.col("html"))),
    )
    asked = F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n"))
    asking = _record([("WARC-Type", "request"), ("WARC-Record-ID", request), *common, ("WARC-Concurrent-To", capture), ("Content-Type", "application/http; msgtype=request")], asked)
    told = F.concat_ws("\r\n", F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))), F.concat(F.lit("first-page-id: "), F.when(F.col("revisit"), F.col("first")).cast("string")), F.lit(""))
    about = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", notes), *common, ("WARC-Concurrent-To", request), ("Content-Type", "application/warc-fields")], told)
    records = df.select(F.explode(F.array(response, asking, about)).alias("record"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


class _Stream:
    """Reads a gzip (or plain) archive bit by bit."""

    def __init__(self, raw: bytes) -> None:
        plain = io.BytesIO(raw)
        self.source = gzip.GzipFile(fileobj=plain) if raw[:2] == b"\x1f\x8b" else plain
        self.data, self.pos = b"", 0

    def more(self) -> bool:
        try:
            got = self.source.read(_READ)
        except EOFError:  # the file was cut short
            got = b""
        self.data, self.pos = self.data[self.pos :] + got, 0
        return bool(got)

    def until(self, end: bytes) -> bytes | None:
        start = self.pos
        while (i := self.data.find(end, start)) < 0:
            start = max(0, len(self.data) - self.pos - len(end))
            if not self.more():
                return None
        out, self.pos = self.data[self.pos : i], i + len(end)
        return out

    def take(self, n: int) -> bytes:
        while len(self.data) - self.pos < n and self.more():
            pass
        out, self.pos = self.data[self.pos : self.pos + n], self.pos + n
        return out


def parse(raw: bytes) -> Iterator[dict]:
    """Records of one archive. A record cut short by the end of the file is left out."""
    stream = _Stream(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").strip().split("\r\n")
        pairs = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
        known = dict(pairs)
        size = int(known.get("content-length", 0))
        block = stream.take(size)
        if len(block) < size:
            return
        stream.take(4)
        http, fields, payload = None, {}, block
        if known.get("content-type", "").startswith("application/http"):
            cut = block.find(b"\r\n\r\n")
            http, payload = block[:cut].decode("utf-8", "replace"), block[cut + 4 :]
        if known.get("content-type", "").startswith("application/warc-fields"):
            text = block.decode("utf-8", "replace")
            fields = {k.strip().lower(): v.strip() for k, found, v in (x.partition(":") for x in text.split("\r\n")) if found}
        yield {
            "record_id": known.get("warc-record-id"), "type": known.get("warc-type"), "concurrent_to": [v for k, v in pairs if k == "warc-concurrent-to"], "target_uri": known.get("warc-target-uri"),
            "date": known.get("warc-date"), "refers_to": known.get("warc-refers-to"), "payload_digest": known.get("warc-payload-digest"), "fields": list(fields.items()), "http": http, "payload": payload,
        }


_SCHEMA = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("http", pa.string()), ("payload", pa.binary())])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in ``path``. A task holds one file at a time, and its
    records go out in batches of a few MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                held, size = [], 0
                for record in parse(batch.column(0)[at].as_py()):
                    held.append(record)
                    size += len(record["payload"]) + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: capture_id, response (struct, null if the archive lacks
    it), request (struct or null) and metadata (array of structs, by record_id).

    A record belongs to the response or revisit that its concurrent-to identifiers name,
    or that names it, or else to that of a record it names (metadata of a request). If
    none is found, the request is the capture, and metadata without one stand alone. A
    response that is repeated under one identifier gives as many rows; of other repeated
    records one counts, as it does of several requests (the least record_id). A record
    without an identifier is left out. Only identifiers are shuffled to find captures."""
    records = records.where(F.col("record_id").isNotNull())
    is_main = F.col("type").isin("response", "revisit")
    # All but the payloads is read once and kept; payloads are read once more, where they are needed.
    light = materialize(records.select(*[F.when(~is_main, F.col(c)).alias(c) if c in ("target_uri", "date", "http", "fields") else F.col(c) for c in records.columns if c not in ("payload", "refers_to", "payload_digest")]), "records")
    ids = light.select("record_id", is_main.alias("main"), F.explode_outer("concurrent_to").alias("other"))
    named = ids.where("main and other is not null").select(F.col("other").alias("record_id"), F.col("record_id").alias("capture_id"))
    points = ids.where("not main").select("record_id", "other").distinct()
    mains = ids.where("main").select(F.col("record_id").alias("other"), F.lit(True).alias("hit")).distinct()
    direct = points.join(mains, "other", "left").groupBy("record_id").agg(F.min(F.when(F.col("hit"), F.col("other"))).alias("capture_id"), F.min("other").alias("via"))
    direct = direct.join(named.groupBy("record_id").agg(F.min("capture_id").alias("named_by")), "record_id", "left").select("record_id", F.coalesce("capture_id", "named_by").alias("capture_id"), "via")
    hop = direct.select(F.col("record_id").alias("via"), F.coalesce("capture_id", "record_id").alias("hop"))
    owner = direct.join(hop, "via", "left").select("record_id", F.coalesce("capture_id", "hop", "record_id").alias("capture_id"))

    whole = F.struct(*records.columns)
    rest = light.where(~is_main).join(owner, "record_id").groupBy("capture_id").agg(
        F.min(F.when(F.col("type") == "request", F.struct("record_id", "target_uri", "date", "http"))).alias("request"),
        F.sort_array(F.collect_set(F.when(F.col("type") == "metadata", F.struct("record_id", "date", F.array_sort(F.map_entries("fields")).alias("fields"))))).alias("metadata"),
    )
    main = records.where(is_main).select(F.col("record_id").alias("capture_id"), whole.alias("response"))
    out = main.join(rest, "capture_id", "full")
    return out.select("capture_id", "response", "request", F.coalesce("metadata", F.array()).alias("metadata"))
