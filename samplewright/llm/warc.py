"""WARC archives with revisit records: written by Spark's text sink, read back by declared lengths.

Headers (id, digest, size) are shuffled by payload digest and each digest's original is its record with the largest id;
payloads move once, to the task that writes them. A record is one row of text whose line end is the blank line that ends a
record, so any file system of Spark can hold the archives and the commit protocol covers lost tasks.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.llm.common import bounded_batches, written
from samplewright.session import scratch_path

# Payload bytes of one archive file, about.
FILE_BYTES = 16 << 20
# Archive and profile names (fixed values of the format).
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(column):
    """Bare upper-case base32 SHA-1 of a string's UTF-8 bytes: five bytes give eight letters."""
    digest = F.sha1(column.cast("binary"))
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*parts)), digits, BASE32)


def headers(pages: DataFrame) -> DataFrame:
    """``page_id, payload_digest, payload_bytes`` of every row; a null page has an empty payload."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), base32_sha1(html).alias("payload_digest"),
                        F.octet_length(html).cast("long").alias("payload_bytes"))


def resolved(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add ``record_type`` and ``refers_to`` to header rows.

    Among records with one digest and at least ``least_bytes`` of payload the largest id is the response and all others
    revisit it; rows that share the largest id are all responses. Smaller payloads and rows without an id are responses.
    The largest id is found by partial aggregation, and the join back is one that Spark can split at a hot digest.
    """
    large = records.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    originals = large.groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.min("page_id").alias("least")).where(
        "least < original").select("payload_digest", "original")
    known = (F.col("payload_bytes") >= least_bytes) & (F.col("page_id") < F.col("original"))
    return records.join(originals, "payload_digest", "left").select(
        *records.columns, F.when(known, "revisit").otherwise("response").alias("record_type"),
        F.when(known, F.col("original")).alias("refers_to"))


def _uuid(*parts):
    """A record name from what it is about, so a repeated task writes the same one."""
    h = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3),
                    F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _record(date: str):
    """A whole record as text, but for its last line end."""
    html = F.coalesce(F.col("html"), F.lit(""))
    revisit = F.col("record_type") == "revisit"
    url = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit("\r\n\r\n"))
    size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.octet_length(html))
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))

    def line(name: str, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    head = F.concat(
        F.lit(f"{VERSION}\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _uuid(number, F.col("payload_digest"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _uuid(F.col("refers_to").cast("string"), F.col("payload_digest"))),
                                 line("WARC-Profile", F.lit(PROFILE)), line("X-Refers-To-Page", F.col("refers_to").cast("string")))).otherwise(""),
        line("X-Page", number), line("X-Payload-Bytes", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", size.cast("string")), F.lit("\r\n"))
    return F.concat(head, http, F.when(revisit, F.lit("")).otherwise(html), F.lit("\r\n"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write one record per row of ``pages`` (``page_id, url, html``) to archive files below ``path``.

    Payloads of originals are stored once; revisit records hold headers only, all of them fresh. Files are about
    ``file_bytes`` large before compression, as many as the stored bytes ask for. Rows may be null in any column or repeat; a missing address
    becomes ``urn:page:<id>``, spaces and control characters in one are escaped.
    """
    kept = written(headers(pages), "headers")
    plan = written(resolved(kept, least_bytes).distinct(), "plan")
    stored = plan.agg(F.sum(F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0) + 600)).first()[0] or 0
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), base32_sha1(html).alias("digest"), html.alias("html"))
    files = max(1, ceil(stored / file_bytes))

    def key(number: str, digest: str):
        return F.concat_ws(":", F.coalesce(F.col(number).cast("string"), F.lit("none")), F.col(digest))

    # payloads move once: the join's partitions are the files
    rows = rows.withColumn("key", key("id", "digest")).repartition(files, "key").join(
        plan.withColumn("key", key("page_id", "payload_digest")).repartition(files, "key"), "key")
    rows.select(_record(date).alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of each record; the block is as long as its header says, whatever it holds."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no record begins at byte {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(fields["Content-Length"])
        block, at = data[end + 4:end + 4 + size], end + 8 + size
        if len(block) != size or data[at - 4:at] != b"\r\n\r\n":
            raise ValueError(f"record {fields['WARC-Record-ID']} is cut short")
        yield fields, block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, html`` of every record.

    Payloads of responses are checked against their digests and lengths; a revisit has no payload (null ``html``) and
    states size and digest of the one it refers to.
    """
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for fields, block in _records(gzip.decompress(content.as_py())):
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    payload = block.split(b"\r\n\r\n", 1)[1]
                    if kind == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest
                                               or len(payload) != int(fields["X-Payload-Bytes"])):
                        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
                    rows.append({
                        "page_id": int(fields["X-Page"]) if fields["X-Page"] else None, "url": fields["WARC-Target-URI"],
                        "payload_bytes": int(fields["X-Payload-Bytes"]), "payload_digest": digest, "record_type": kind,
                        "refers_to": int(fields["X-Refers-To-Page"]) if "X-Refers-To-Page" in fields else None,
                        "html": payload.decode("utf-8") if kind == "response" else None})
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    # one file a row and a few files a batch: files are bounded by the writer
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared scratch folder and return what is read back, without payloads."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
