"""Content-addressed WARC archive: payloads once by digest, exact headers apart."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import arrow_map, byte_values
from quarryline.session import fresh_path

# Equal payloads of at least so many bytes are stored as one response and revisits of it.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNKNOWN_DATE = "1970-01-01T00:00:00Z"
LINE = "\r\n"
# Bytes of records handed on at a time when an archive is read.
READ_BYTES = 8 << 20


@dataclass(frozen=True)
class Archive:
    """Folders of the two tables of an archive.

    headers: page_id, record_type, payload_key, refers_to, header (exact bytes up to and with the
    blank line). payloads: payload_key (SHA-256), n_bytes, sha1, body (the payload as a Zstandard
    frame), one row per payload.
    """

    headers: str
    payloads: str


def _uuid(key: Column, digest: Column) -> Column:
    """A record id that follows from page and payload, so a repeated task writes the same."""
    h = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("-")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """One header line, nothing for a null value; line ends in a value are percent-encoded."""
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(name + ": "), clean, F.lit(LINE)), F.lit(""))


def records(pages: DataFrame, id_column: str, url_column: str, html_column: str, date: str) -> DataFrame:
    """Pages as records, header and payload apart."""
    payload = F.encode(F.coalesce(F.col(html_column), F.lit("")), "utf-8")
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        F.col(url_column).cast("string").alias("url"),
        payload.alias("payload"),
    ).select(
        "*",
        F.length("payload").cast("long").alias("n_bytes"),
        F.sha1("payload").alias("sha1"),
        F.sha2("payload", 256).alias("payload_key"),
    )
    originals = (
        rows.where(F.col("n_bytes") >= REVISIT_BYTES)
        .groupBy("payload_key")
        .agg(F.max("page_id").alias("original"))
    )
    joined = rows.join(originals, "payload_key", "left")
    revisit = F.coalesce(F.col("page_id") < F.col("original"), F.col("page_id").isNull() & F.col("original").isNotNull())
    typed = joined.withColumn("revisit", revisit).withColumn(
        "refers_to", F.when(F.col("revisit"), F.col("original"))
    )
    stored = F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n_bytes")).cast("string")
    header = F.concat(
        F.lit("WARC/1.1" + LINE),
        _field("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _field("WARC-Record-ID", _uuid(F.col("page_id"), F.col("payload_key"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _field("X-Payload-SHA256", F.col("payload_key")),
        _field("X-Page-ID", F.col("page_id").cast("string")),
        _field("WARC-Refers-To", F.when(F.col("revisit"), _uuid(F.col("original"), F.col("payload_key")))),
        _field("X-Refers-To-Page", F.col("refers_to").cast("string")),
        _field("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE))),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", stored),
        F.lit(LINE),
    )
    return typed.select(
        "page_id",
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"),
        "payload_key",
        "refers_to",
        F.encode(header, "utf-8").alias("header"),
        "n_bytes",
        "sha1",
        "payload",
    )


def write(
    pages: DataFrame,
    folder: str | None = None,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    date: str = UNKNOWN_DATE,
) -> Archive:
    """Writes a record per page; returns where.

    The payload is the html in UTF-8, null counting as empty. Of records with equal payloads of
    at least 1,000 bytes (same SHA-256) that with the largest page id is the response, the
    others revisit it; smaller ones are all responses. Repeated rows of the largest id are all
    responses. A null id never is the one referred to while another is there; if all are null,
    all are responses. Every payload is stored once, whichever records share it.
    """
    base = folder or fresh_path(pages.sparkSession, "warc")
    archive = Archive(f"{base}/headers", f"{base}/payloads")
    rows = records(pages, id_column, url_column, html_column, date)
    rows.select("page_id", "record_type", "payload_key", "refers_to", "header").write.parquet(archive.headers)
    packed = arrow_map(pages.select(F.col(html_column).cast("string")), _pack, PAYLOAD)
    packed.dropDuplicates(["payload_key"]).write.parquet(archive.payloads)
    return archive


PAYLOAD = "payload_key string, n_bytes long, sha1 string, body binary"


def _pack(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Digests of the payloads, which go on compressed: they are moved twice."""
    press = zstandard.ZstdCompressor()
    texts = byte_values(batch.column(0))
    return pa.record_batch(
        [
            pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha1(t).hexdigest() for t in texts]),
            pa.array([press.compress(t) for t in texts], pa.binary()),
        ],
        ["payload_key", "n_bytes", "sha1", "body"],
    )


def unpacked(key: str, size: int, sha1: str, body: bytes) -> bytes:
    """A stored payload, whose length and both digests must be right."""
    try:
        data = zstandard.ZstdDecompressor().decompress(body)
    except zstandard.ZstdError as error:
        raise ValueError(f"damaged payload {key}") from error
    sound = len(data) == size and hashlib.sha256(data).hexdigest() == key
    if not sound or hashlib.sha1(data).hexdigest() != sha1:
        raise ValueError(f"damaged payload {key}")
    return data


def header_field(name: str) -> Column:
    """Value of a header line of `header`, null if there is none."""
    found = F.regexp_extract(F.decode("header", "utf-8"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """Original records: every header with the payload it stands for.

    Returns page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (that of
    the response for a revisit) and record, the exact bytes of the WARC record. All fields
    come from the header's bytes; payloads meet headers by digest, where a payload with a
    third of all headers is split among tasks.
    """
    heads = spark.read.parquet(archive.headers).select(
        "header",
        header_field("X-Payload-SHA256").alias("payload_key"),
        header_field("X-Page-ID").cast("long").alias("page_id"),
        header_field("WARC-Target-URI").alias("url"),
        header_field("WARC-Type").alias("record_type"),
        header_field("X-Refers-To-Page").cast("long").alias("refers_to"),
        header_field("Content-Length").cast("long").alias("content_length"),
    )
    joined = heads.join(spark.read.parquet(archive.payloads), "payload_key", "left")
    return joined.select(*READ).mapInArrow(_records, RECORD)


READ = (
    "page_id url record_type refers_to n_bytes sha1 header payload_key content_length body"
).split()
RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary, record binary"
)


def _records(batches):
    """Headers and payloads put together, a few megabytes at a time."""
    end = (LINE + LINE).encode()
    for batch in batches:
        n, sha1, header, key, length, body = (batch.column(i).to_pylist() for i in range(4, 10))
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "record"]
        kinds = batch.column(2).to_pylist()
        first, size, payloads, records = 0, 0, [], []
        for i in range(batch.num_rows):
            if body[i] is None:
                raise ValueError(f"no payload for {header[i]!r}")
            payload = unpacked(key[i], n[i], sha1[i], body[i])
            block = payload if kinds[i] == "response" else b""
            if len(block) != length[i]:
                raise ValueError(f"no whole payload for {header[i]!r}")
            payloads.append(payload)
            records.append(header[i] + block + end)
            size += len(payload) + len(records[-1])
            if size >= READ_BYTES or i + 1 == batch.num_rows:
                columns = [c.slice(first, len(records)) for c in batch.columns[:6]]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(payloads, pa.binary()), pa.array(records, pa.binary())], names
                )
                first, size, payloads, records = i + 1, 0, [], []
