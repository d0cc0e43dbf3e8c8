"""WARC archives: writing captures, reading records back, and assembling transactions.

Each row becomes a capture of three records: a request, a response or a revisit, and a metadata record that bears the
row's page_id; request and metadata name the capture by WARC-Concurrent-To.  Of equal payloads of at least
`min_bytes` bytes, that with the smallest page_id is written as a response and the others as revisits of it, without
payload.  Archives go through Spark's own writer to any file system it knows: a file holds records of ARCHIVE_BYTES or
one record more, each a gzip member of its own, so that it can be read from its offset; a zero byte pads the end.
Reading walks the records by Content-Length and computes digests anew; assembly joins request and metadata to their
capture by the concurrent-to identifiers, and revisits to the response they refer to, giving one nested row per capture.

Payloads are not shuffled: which digests are repeated is found from ids and digests alone, and is broadcast if it has
BROADCAST_ROWS rows or fewer; else the row ids of revisits are joined with the rows.

The table is read twice and must give the same rows each time (a stored table or a checkpoint does), as record ids
come from a row's place in it.  Null html is an empty payload; a null url leaves the target out, and line breaks in
an url are percent-encoded; rows without a page_id are responses only if no equal payload has one.  Rows that share
the smallest page_id of their payload are decided by place: one is the response, and the others revisit it.  Equal
rows stay separate captures.  Other columns are not looked at; an empty table gives an empty archive.  A payload has to
fit in memory, an archive file too.  The text writer is given archives as strings, whose bytes it does not change.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import fresh_path, read, written
from lumenframe.storage import has_at_most

ARCHIVE_BYTES, BROADCAST_ROWS = 32 << 20, 500_000
CRLF = "\r\n"
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, page_id long, payload_bytes long, payload_digest string, intact boolean, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1, five hexadecimal digits giving four characters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def captures(df: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """(rid, page_id, url, html, digest, first): `first` is (page_id, rid) of the response that a revisit refers to."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = df.select(
        F.monotonically_increasing_id().alias("rid"), F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("html")
    ).withColumn("digest", base32_sha1(F.encode("html", "UTF-8")))
    shared = rows.filter(F.octet_length("html") >= min_bytes)
    firsts = shared.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("no"), "page_id", "rid")).alias("first"), F.count("*").alias("n"))
    repeated = written(firsts.filter("n > 1").select("digest", F.struct("first.page_id", "first.rid").alias("first")), "warc-repeated")
    revisit = F.col("first").isNotNull() & (F.col("first.rid") != F.col("rid")) & (F.octet_length("html") >= min_bytes)
    if has_at_most(repeated, BROADCAST_ROWS):
        joined = rows.join(F.broadcast(repeated), "digest", "left")
    else:
        again = written(shared.select("rid", "digest").join(repeated, "digest").filter("first.rid <> rid").select("rid", "first"), "warc-revisits")
        joined = rows.join(again, "rid", "left")
    return joined.withColumn("first", F.when(revisit, F.col("first"))).select("rid", "page_id", "url", "html", "digest", "first")


def records(found: DataFrame) -> DataFrame:
    """The text of each record of captures(), in order."""
    own = lambda kind, rid: _urn(F.lit(kind), rid.cast("string"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    target = F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), uri, F.lit(CRLF))).otherwise("")
    capture = own("capture", F.col("rid"))

    def record(kind: Column, rid: Column, more: Column, mime: str, block: Column) -> Column:
        return F.concat(
            F.lit("WARC/1.1" + CRLF + "WARC-Type: "), kind, F.lit(CRLF + "WARC-Record-ID: "), rid, F.lit(CRLF + "WARC-Date: 1970-01-01T00:00:00Z" + CRLF),
            target, more, F.lit(f"Content-Type: {mime}{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block,
        )

    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), capture, F.lit(CRLF))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(CRLF))
    asked = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    answered = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF * 2), F.col("html"))
    again = F.concat(
        digest, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF + "WARC-Refers-To: "), own("capture", F.col("first.rid")), F.lit(CRLF)
    )
    held = F.when(F.col("page_id").isNotNull(), F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit(CRLF))).otherwise("")
    main = F.when(F.col("first").isNotNull(), record(F.lit("revisit"), capture, again, "application/http; msgtype=response", F.lit(f"HTTP/1.1 200 OK{CRLF}{CRLF}"))).otherwise(
        record(F.lit("response"), capture, digest, "application/http; msgtype=response", answered)
    )
    request = record(F.lit("request"), own("request", F.col("rid")), concurrent, "application/http; msgtype=request", asked)
    metadata = record(F.lit("metadata"), own("metadata", F.col("rid")), concurrent, "application/warc-fields", held)
    return found.select(F.explode(F.array(request, main, metadata)).alias("value"))


def _packed(most: int):
    """Archives of `most` bytes or one record more: records as gzip members, one after another."""

    def archive(held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in batch.column(0):
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                held.append(member.compress(x.as_buffer()) + member.compress(b"\r\n\r\n") + member.flush())
                size += len(held[-1])
                if size >= most:
                    yield archive(held)
                    held, size = [], 0
        if held:
            yield archive(held)

    return run


def write(df: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, **columns: str) -> None:
    """Archives of the rows of df under path; WARC records end with two line breaks."""
    archives = records(captures(df, min_bytes=min_bytes, **columns)).mapInArrow(_packed(archive_bytes), "value binary")
    archives.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a record ends early")
        yield headers, block


def _row(headers: dict[str, str], block: bytes, payload: bool) -> dict:
    kind = headers["warc-type"]
    row = {"record_id": headers["warc-record-id"], "type": kind, "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": headers.get("warc-refers-to"), "target_uri": headers.get("warc-target-uri")}
    stated = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response":
        body = block.partition(b"\r\n\r\n")[2]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        row |= {"payload_bytes": len(body), "payload_digest": digest, "intact": digest == stated, "payload": body if payload else None}
    elif kind == "revisit":
        row |= {"payload_digest": stated}
    elif kind == "metadata":
        fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
        row |= {"page_id": int(fields["page_id"]) if "page_id" in fields else None}
    return row


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row for each record of the archives under path; payloads only if asked for, their digests always."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    rows.append(_row(headers, block, payload))
                    size += len(block) if payload else 200
                    if size > 1 << 23:
                        yield table(rows)
                        rows, size = [], 0
                yield table(rows)

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One row per capture: (capture_id, target_uri, type, request, metadata, response, refers_to).

    `response` is the payload's length, digest, intactness and bytes, for revisits that of the response they refer to;
    `refers_to` is that response's page_id.  A missing request or metadata record leaves a null."""
    told = found.filter("type in ('request', 'metadata') and concurrent_to is not null").groupBy(F.col("concurrent_to").alias("capture_id")).agg(
        F.min(F.when(F.col("type") == "request", F.struct("record_id", "target_uri"))).alias("request"),
        F.min(F.when(F.col("type") == "metadata", F.struct("record_id", "page_id"))).alias("metadata"),
    )
    told = written(told, "warc-told")
    main = found.filter("type in ('response', 'revisit')").select(
        F.col("record_id").alias("capture_id"), "target_uri", "type", F.col("refers_to").alias("of"), F.struct("payload_bytes", "payload_digest", "intact", "payload").alias("response")
    )
    plain, revisits = (main.filter(x).join(told, "capture_id", "left") for x in ("of is null", "of is not null"))  # apart, as responses share no key
    wanted = main.filter("of is not null").select(F.col("of").alias("capture_id")).distinct()
    firsts = main.join(wanted, "capture_id", "left_semi").join(told, "capture_id", "left")
    firsts = written(firsts.select(F.col("capture_id").alias("of"), F.col("response").alias("first"), F.col("metadata.page_id").alias("refers_to")), "warc-firsts")
    again = revisits.join(firsts, "of", "left").select("capture_id", "target_uri", "type", "request", "metadata", F.coalesce("first", "response").alias("response"), "refers_to")
    return plain.select("capture_id", "target_uri", "type", "request", "metadata", "response", F.lit(None).cast("long").alias("refers_to")).union(again)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write(read(spark, sf_dir, "pages"), path)
    found = assemble(written(read_records(spark, path, payload=False), "warc-records"))
    return found.select(
        F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to",
    )


OP7_SQL = """
WITH p AS (
  SELECT row_number() OVER () AS u, page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT u, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> (15 - 5 * k)) & 31 AS INTEGER) + 1, 1), '' ORDER BY g, k) AS digest
  FROM (SELECT u, g, CAST('0x' || substr(h, 5 * g + 1, 5) AS BIGINT) AS v FROM p, (SELECT unnest(range(8)) AS g)), (SELECT CAST(unnest(range(4)) AS INTEGER) AS k)
  GROUP BY u
), f AS (
  SELECT html, min(page_id) AS first FROM p GROUP BY html
)
SELECT page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN d ON p.u = d.u JOIN f ON p.html = f.html
"""
