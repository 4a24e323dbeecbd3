"""WARC archives and transaction assembly (operator 1), Spark expressions only.

:func:`write_archive` writes, for each page, a request, a response (or revisit) and a metadata record; the last two
types of record point at the response through ``WARC-Concurrent-To``. :func:`read_records` reads archives back, one
row per record, and :func:`assemble` joins the records of each capture into one nested row.

The archives are text files whose line separator ends a record, compressed as a whole by gzip. The reader splits at
``CRLF WARC/1.1 CRLF``. A payload that holds that separator breaks its record in pieces, which shows in
``Content-Length``; the pieces of such a file, which come in order since it is compressed as a whole, are joined again as
they stream by, one record at a time, by ``Content-Length`` alone.

Defined cases: null html is an empty payload, null url an empty one, line breaks in a url are percent-encoded; a null
page_id is read back as null; every row is a capture, repeated rows and page_ids too. Of equal payloads of ``min_bytes``
or more the rows with the smallest page_id (nulls last) are responses, all others revisit the first of them (by the hash
of url and payload). Wholly equal rows write equal records, and each is read back. An empty table writes an empty archive.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonflow.llm.common import broadcast_if_small, materialize, scratch_path, table

VERSION, CRLF = "WARC/1.1", "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_SCHEMA = "file string, value binary"


def base32(digest: Column) -> Column:
    """A hex SHA-1 in upper-case base32: eight groups of five hex digits give four letters each."""
    bits = [F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    letter = lambda n: F.substr(F.lit(BASE32), n + 1, F.lit(1))
    return F.concat(*(letter(F.shiftright(n, 15 - 5 * k).bitwiseAND(31)) for n in bits for k in range(4)))


def _record(kind, record_id, url, content_type: str, extra, block) -> Column:
    lines = [f"{VERSION}{CRLF}WARC-Type: ", kind, f"{CRLF}WARC-Record-ID: ", record_id, f"{CRLF}WARC-Date: 1970-01-01T00:00:00Z{CRLF}WARC-Target-URI: ", url]
    lines += [f"{CRLF}Content-Type: {content_type}", extra, f"{CRLF}Content-Length: ", F.octet_length(block).cast("string"), CRLF * 2, block]
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in lines))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write page_id, url, html as WARC records, three a page."""
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", url.alias("url"), html.alias("html"), F.sha2(html, 256).alias("sha"), F.sha1(html).alias("digest"), F.concat(page, F.lit("-"), F.hex(F.xxhash64("url", "html"))).alias("capture"))
    first = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "capture")).alias("first"), F.min("capture").alias("least"), F.max("capture").alias("most")
    )
    first = first.where("least != most").select("sha", F.col("first.capture").alias("first"), F.col("first.page_id").alias("first_page"))
    rows = rows.join(broadcast_if_small(materialize(first, "warc-repeats")), "sha", "left")
    rows = rows.withColumn("again", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page")))
    urn = lambda kind, key: F.concat(F.lit(f"<urn:capture:{kind}:"), key, F.lit(">"))
    response, to = urn("response", F.col("capture")), F.lit(f"{CRLF}WARC-Concurrent-To: ")
    digest = F.concat(F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), base32(F.col("digest")))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF * 2))
    revisit = F.concat(digest, F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), urn("response", F.col("first")))
    get = F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{CRLF * 2}"))
    fields = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    records = F.array(
        _record("request", urn("request", F.col("capture")), F.col("url"), "application/http;msgtype=request", F.concat(to, response), get),
        F.when(F.col("again"), _record("revisit", response, F.col("url"), "application/http;msgtype=response", revisit, head))
        .otherwise(_record("response", response, F.col("url"), "application/http;msgtype=response", digest, F.concat(head, F.col("html")))),
        _record("metadata", urn("metadata", F.col("capture")), F.col("url"), "application/warc-fields", F.concat(to, response), fields),
    )
    rows.select(F.explode(records).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def _declared(record: bytes) -> int:
    """Bytes of a whole record, its head included; more than there can be while the head is not whole."""
    head = record.find(b"\r\n\r\n")
    lengths = [line.split(b":")[1] for line in record[:head].split(b"\r\n") if line.lower().startswith(b"content-length:")]
    return (head + 4 + int(lengths[0]) if lengths else len(record)) if head >= 0 else 1 << 62


def _rejoined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records out of the pieces of whole files, in order: each takes pieces until it has its declared length.

    A piece may hold several records as well: Hadoop's line reader can miss a separator at the end of its buffer.
    """
    first = f"{VERSION}{CRLF}".encode()
    separator, between = CRLF.encode() + first, CRLF.encode() * 2 + first
    file, record = None, b""
    for batch in batches:
        out = []
        for name, piece in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if name != file:
                out += [(file, record)] if record else []
                file, record = name, piece.removeprefix(first)
            elif len(record) < _declared(record):
                record += separator + piece
            else:
                out.append((file, record))
                record = piece
            while record.startswith(between, end := _declared(record)):
                out.append((file, record[:end]))
                record = record[end + len(between) :]
        files, values = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(values, pa.binary())], names=["file", "value"])
    if record:
        yield pa.RecordBatch.from_arrays([pa.array([file], pa.string()), pa.array([record], pa.binary())], names=["file", "value"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: record_type, record_id, concurrent_to, refers_to, target_uri, payload_digest, block."""
    mark = f"{VERSION}{CRLF}"
    # a separator that does not begin anew within itself, so that the line reader misses none before a payload's line end
    raw = spark.read.option("lineSep", f"{CRLF}{mark}").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    bare = F.when(F.startswith("value", F.lit(mark)), F.substr("value", F.lit(len(mark) + 1))).otherwise(F.col("value"))
    split = _fields(raw.select("file", bare.alias("value")).where(F.octet_length("value") > 0))
    torn = materialize(split.where(~F.coalesce("whole", F.lit(False))).select("file").distinct(), "warc-torn")
    if torn.isEmpty():
        return split.drop("file", "whole")
    if not torn.where("file NOT LIKE '%.gz'").isEmpty():
        raise ValueError("payloads that hold a record's separator are read from archives compressed by gzip only")
    # names of files, a few bytes for each file of the archive
    torn = broadcast_if_small(torn)
    pieces = raw.join(torn, "file", "left_semi").select("file", F.col("value").cast("binary").alias("value"))
    again = pieces.mapInArrow(_rejoined, RECORD_SCHEMA).select("file", F.col("value").cast("string").alias("value"))
    return split.join(torn, "file", "left_anti").unionByName(_fields(again)).drop("file", "whole")


def _fields(records: DataFrame) -> DataFrame:
    head = F.substring_index("value", CRLF * 2, 1)
    rows = records.select("file", "value", head.alias("head"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))
    length, start = field("Content-Length").cast("int"), F.octet_length("head") + 4
    left = F.octet_length("value") - start - length
    return rows.select(
        "file", left.isin(0, 2, 4).alias("whole"), field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"),
        field("WARC-Concurrent-To").alias("concurrent_to"), field("WARC-Refers-To").alias("refers_to"), field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Payload-Digest").alias("payload_digest"), F.substr(F.col("value").cast("binary"), start + 1, length).alias("block"),
    )


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit record, with its request and its metadata record, by concurrent-to.

    A capture keeps one request and one metadata record (the smallest record_id) and counts the others; records that
    point at no response are left out. Records repeated under one record_id are a row each.
    """
    text = F.col("block").cast("string")
    http = F.substring_index(text, CRLF * 2, 1)
    body = F.substr("block", F.octet_length(http) + 5, F.octet_length("block"))
    declared = F.regexp_extract(http, r"(?im)^Content-Length:[ \t]*(\d+)", 1).try_cast("long")
    main = records.where(F.col("record_type").isin("response", "revisit"))
    is_revisit = F.col("record_type") == "revisit"
    main = main.select(
        "record_id", "record_type", "refers_to", "target_uri", http.alias("http_header"), F.when(~is_revisit, body).alias("payload"),
        F.when(is_revisit, declared).otherwise(F.octet_length(body).cast("long")).alias("payload_bytes"),
        F.when(is_revisit, F.regexp_replace("payload_digest", "^sha1:", "")).alias("declared_digest"), F.sha1(body).alias("digest"),
    )
    main = main.withColumn("payload_digest", F.coalesce("declared_digest", base32(F.col("digest"))))
    side = lambda kind: F.min(F.when(F.col("record_type") == kind, F.struct("record_id", "target_uri", text.alias("text")))).alias(kind)
    others = records.where(F.col("record_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    others = others.groupBy(F.col("concurrent_to").alias("record_id")).agg(side("request"), side("metadata"), F.count(F.lit(1)).alias("n_concurrent"))
    response = F.struct("record_id", "record_type", "refers_to", "target_uri", "http_header", "payload", "payload_bytes", "payload_digest").alias("response")
    return main.join(others, "record_id", "left").select(F.col("record_id").alias("capture_id"), response, "request", "metadata", F.coalesce("n_concurrent", F.lit(0)).alias("n_concurrent"))


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    captures = assemble(read_records(spark, path))
    page = lambda c, pattern: F.regexp_extract(c, pattern, 1).try_cast("long")
    return captures.select(
        page(F.col("metadata.text"), r"pageId: (-?\d+)").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"),
        page(F.col("response.refers_to"), r"<urn:capture:response:(-?\d+)-").alias("refers_to"),
    )


SQL = {
    "op1_warc_transactions": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM d""",
}
QUERIES = {"op1_warc_transactions": op1_warc_transactions}
