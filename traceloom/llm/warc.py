"""Content-addressed WARC archive.

An archive is two tables below one folder: `headers` with the exact header bytes
of every record, and `payloads` with each distinct payload once, gzipped, under
its SHA-256. Records are put together again by a join on the digest, and each
payload is verified once against its address when it is read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.session import materialize, new_path

#: Capture time written to records; pages have none.
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _payload(page) -> bytes:
    return b"" if page is None else page.encode()


def _digests(pages: DataFrame) -> DataFrame:
    """`page_id, url, bytes, sha1, sha256` of each row's whole payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [_payload(p) for p in batch.column(2).to_pylist()]
            sha1 = [base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payloads]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array(sha1, pa.string()),
                    pa.array([hashlib.sha256(p).digest() for p in payloads], pa.binary()),
                ],
                ["page_id", "url", "bytes", "sha1", "sha256"],
            )

    return pages.mapInArrow(run, "page_id BIGINT, url STRING, bytes BIGINT, sha1 STRING, sha256 BINARY")


def _stored(pages: DataFrame) -> DataFrame:
    """`sha256, body`: gzipped payloads, each once. Copies are combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new: dict[bytes, bytes] = {}
            for p in map(_payload, batch.column(2).to_pylist()):
                digest = hashlib.sha256(p).digest()
                if digest not in new:
                    new[digest] = zlib.compress(p, 6, wbits=31)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(new), pa.binary()), pa.array(list(new.values()), pa.binary())], ["sha256", "body"]
            )

    return pages.mapInArrow(run, "sha256 BINARY, body BINARY").groupBy("sha256").agg(F.first("body").alias("body"))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _header(record_type: Column) -> Column:
    """WARC and HTTP header of a record, of `page_id, url, bytes, sha1, refers_to`."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "%0A")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.col("bytes").cast("string")),
        F.lit("\r\n"),
    )
    revisit = record_type == "revisit"
    body = F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    refers = F.when(revisit, line("WARC-Refers-To", _record_id(F.col("refers_to")))).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", record_type),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, line("WARC-Profile", F.lit(PROFILE))).otherwise(""),
        refers,
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + body).cast("string")),
        F.lit("\r\n"),
        http,
    )
    return F.encode(head, "UTF-8")


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archive each row of `page_id, url, html`; null html is an empty payload.

    Of rows with equal payloads of at least `least_bytes`, those with the largest
    page_id are responses and the others revisit it (rows without a page_id
    revisit any that has one). Smaller payloads are all responses.
    """
    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    digests = materialize(_digests(plain), "digests")
    latest = digests.groupBy("sha256").agg(F.max("page_id").alias("latest"))
    first = (F.col("bytes") < least_bytes) | F.col("page_id").eqNullSafe(F.col("latest"))
    records = digests.join(latest, "sha256").select(
        "page_id",
        "url",
        "bytes",
        "sha1",
        "sha256",
        F.when(first, "response").otherwise("revisit").alias("type"),
        F.when(~first, F.col("latest")).alias("refers_to"),
    )
    records.select("page_id", "sha256", _header(F.col("type")).alias("header")).write.parquet(f"{path}/headers")
    _stored(plain).write.parquet(f"{path}/payloads")


def verified_payloads(spark: SparkSession, path: str, body: bool = True) -> DataFrame:
    """`sha256, sha1, bytes` (and the unzipped `payload`) of each stored payload.

    Each payload is unzipped and hashed once, however many records share it.
    Reading fails if a payload does not have its address.
    """
    stored = spark.read.parquet(f"{path}/payloads").select("sha256", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha1, size, payloads = [], [], []
            for digest, packed in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                payload = zlib.decompress(packed, wbits=31)
                if hashlib.sha256(payload).digest() != digest:
                    raise ValueError(f"payload {digest.hex()} is missing or damaged")
                sha1.append(base64.b32encode(hashlib.sha1(payload).digest()).decode())
                size.append(len(payload))
                payloads.append(payload)
            columns = [batch.column(0), pa.array(sha1, pa.string()), pa.array(size, pa.int64())]
            names = ["sha256", "sha1", "bytes"]
            if body:
                columns.append(pa.array(payloads, pa.binary()))
                names.append("payload")
            yield pa.RecordBatch.from_arrays(columns, names)

    return stored.mapInArrow(run, "sha256 BINARY, sha1 STRING, bytes BIGINT" + ", payload BINARY" * body)


def _matched(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Headers with their payload's columns. Fails where there is none, or it is not the one the header names."""
    fault = F.when(
        F.col("sha1").isNull(), F.concat(F.lit("payload "), F.hex("sha256"), F.lit(" is missing or damaged"))
    ).when(_field("WARC-Payload-Digest") != F.concat(F.lit("sha1:"), F.col("sha1")), "a header has another payload's digest")
    checked = F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.col("header"))
    return headers.join(payloads, "sha256", "left").withColumn("header", checked)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """`page_id, header, bytes` of every record, checked against the verified payloads.

    Payloads are read and verified, but only their digests and sizes are joined.
    """
    headers = spark.read.parquet(f"{path}/headers")
    return _matched(headers, verified_payloads(spark, path, body=False)).select("page_id", "header", "bytes")


def read_archive(spark: SparkSession, path: str, revisits: bool = True) -> DataFrame:
    """`page_id, header, payload` of every record, with verified payloads.

    With `revisits`, records that revisit a payload have it too; else theirs is
    null and no bytes are joined to them. A response's record is
    `header + payload + END`, a revisit's `header + END`. Reading fails if a
    payload does not have its digests or a header none.
    """
    headers, payloads = spark.read.parquet(f"{path}/headers"), verified_payloads(spark, path)
    if revisits:
        return _matched(headers, payloads).select("page_id", "header", "payload")
    again = _field("WARC-Type") == "revisit"
    light = _matched(headers.where(again), payloads.drop("payload")).withColumn("payload", F.lit(None).cast("binary"))
    full = _matched(headers.where(~again), payloads)
    return full.select("page_id", "header", "payload").unionByName(light.select("page_id", "header", "payload"))


def records(archive: DataFrame) -> DataFrame:
    """`page_id, record`: the records' exact bytes, of what `read_archive` gives."""
    tail = F.when(_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return archive.select("page_id", F.concat("header", tail, F.lit(END)).alias("record"))


def _field(name: str) -> Column:
    return F.regexp_extract(F.decode("header", "UTF-8"), f"\r\n{name}: ([^\r]*)\r\n", 1)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write an archive into the shared folder and say what reading it gives.

    `page_id, payload_bytes, payload_digest, record_type, refers_to` of each row of `pages`.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archive(pages, path, least_bytes)
    refers = F.regexp_extract(_field("WARC-Refers-To"), r"^<urn:page:(-?\d+)>$", 1)
    return read_headers(pages.sparkSession, path).select(
        F.regexp_extract(_field("WARC-Record-ID"), r"^<urn:page:(-?\d+)>$", 1).try_cast("long").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.regexp_extract(_field("WARC-Payload-Digest"), r"^sha1:(\w+)$", 1).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        refers.try_cast("long").alias("refers_to"),
    )
