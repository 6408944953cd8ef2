"""Operator 5: WARC archives, and transactions assembled from their records.

Records are text until they are written: a payload is UTF-8, so Spark's own text writer puts archives into any store
that Spark reaches, and whole files are read back as binary and parsed by Content-Length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, shared_path, written

NL = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(c: F.Column) -> F.Column:
    """Upper-case base32 of the SHA-1 of a column, 40 bits at a time."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(c), 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*parts)), *_BASE32)


def originals(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(digest, original, original_url) of the payloads of at least `least_bytes` bytes that several rows have; no payload is dealt."""
    html = F.coalesce("html", F.lit(""))
    light = pages.where(F.octet_length(html) >= least_bytes).select(base32_sha1(html).alias("digest"), F.struct(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url")).alias("o"))
    many = light.groupBy("digest").agg(F.max("o").alias("o"), F.count("*").alias("c")).where("c > 1")
    return written(many.select("digest", F.col("o.page_id").alias("original"), F.col("o.url").alias("original_url")), "originals")


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Rows (page_id, url, html, payload_bytes, digest, revisit, original, original_url, n).

    Of the rows with equal payloads of at least `least_bytes` bytes, those with the largest page_id are originals and the
    others revisits of them. Both sides are dealt by digest, at every size; AQE splits a payload that very many rows
    have. n tells apart rows that share a page_id.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("digest", base32_sha1(F.col("html")))
    found = originals(pages, least_bytes).hint("merge")
    out = rows.join(found.withColumn("shared", F.lit(True)), "digest", "left").withColumn("n", F.monotonically_increasing_id())
    other = F.col("shared").isNotNull() & (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("original"))
    return out.withColumn("revisit", other).drop("shared")


def write_warc(pages: DataFrame, at: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 16 << 20) -> None:
    """Writes pages (page_id, url, html) to `at`, gzip files: for each row a request, a response or revisit, and a metadata record.

    The request and the metadata name the response in WARC-Concurrent-To. A revisit names its original by target URI
    and date, as the profile has it, and by page in X-Refers-To-Page; it has no payload, and its HTTP headers keep the
    length. Line breaks in a url are taken out. A null html is an empty payload; repeated rows are captures each, and
    rows that share the largest page_id of a payload are all originals; a null page_id is smaller than all others.
    Payloads are dealt once, by digest. Files hold about `file_bytes` bytes, since each is read back whole, and one with
    a very long payload holds that; an empty table gives no files; other columns, whatever their names, are not read.
    """
    rows = deduplicated(pages, least_bytes)
    name = lambda p, n, kind: F.concat(F.lit("<urn:page:"), F.coalesce(p.cast("string"), F.lit("")), F.lit(":"), n.cast("string"), F.lit(f":{kind}>"))
    own = name(F.col("page_id"), F.col("n"), "response")
    url = F.regexp_replace("url", r"[\r\n]", "")
    length = F.col("payload_bytes").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NL}Content-Type: text/html; charset=utf-8{NL}Content-Length: "), length, F.lit(NL * 2))
    ask = F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{NL}Accept: text/html{NL * 2}"))
    about = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f"{NL}payload-length: "), length, F.lit(NL))

    def record(kind: F.Column, rec: F.Column, fields: list[F.Column], content: F.Column) -> F.Column:
        head = F.concat(F.lit(f"WARC/1.1{NL}WARC-Type: "), kind, F.lit(f"{NL}WARC-Record-ID: "), rec, F.lit(f"{NL}WARC-Date: {date}{NL}WARC-Target-URI: "), url, F.lit(NL))
        return F.concat(head, *fields, F.lit("Content-Length: "), F.octet_length(content).cast("string"), F.lit(NL * 2), content, F.lit(NL))  # the writer adds the last line break

    field = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(NL))
    original = F.concat(
        field("WARC-Refers-To-Target-URI", F.regexp_replace("original_url", r"[\r\n]", "")),
        F.lit(f"WARC-Refers-To-Date: {date}{NL}"),
        field("X-Refers-To-Page", F.coalesce(F.col("original").cast("string"), F.lit(""))),
        F.lit(f"WARC-Profile: {PROFILE}{NL}"),
    )
    refers = F.when(F.col("revisit"), original).otherwise(F.lit(""))
    digest = field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    content = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    records = F.array(
        record(F.lit("request"), name(F.col("page_id"), F.col("n"), "request"), [field("WARC-Concurrent-To", own), F.lit(f"Content-Type: application/http;msgtype=request{NL}")], ask),
        record(kind, own, [digest, refers, F.lit(f"Content-Type: application/http;msgtype=response{NL}")], content),
        record(F.lit("metadata"), name(F.col("page_id"), F.col("n"), "metadata"), [field("WARC-Concurrent-To", own), F.lit(f"Content-Type: application/warc-fields{NL}")], about),
    )
    total = pages.agg(F.sum(F.octet_length("html")).alias("size"), F.count("*").alias("n")).first()
    per_file = max(3, 3 * round(file_bytes / max(1, (total["size"] or 0) / max(1, total["n"]) + 1000)))
    lines = rows.select(F.explode(records).alias("value"))
    lines.write.option("lineSep", NL).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(at)


RECORD = "kind string, record_id string, concurrent_to string, refers_to_page string, uri string, date string, digest string, headers string, payload binary, payload_bytes long, payload_sha1 string"


def parsed(data: bytes, kinds: tuple[str, ...]) -> Iterator[tuple]:
    """The records of one archive that are of these kinds, in order."""
    at, end = 0, (NL * 2).encode()
    while (stop := data.find(end, at)) >= 0:
        fields: dict[str, str] = {}
        for line in data[at:stop].decode("utf-8", "replace").split(NL)[1:]:
            key, _, value = line.partition(":")
            fields[key.strip().lower()] = value.strip()
        start = stop + len(end)
        content = data[start : start + int(fields.get("content-length", 0))]
        at = start + len(content) + len(end)
        if fields.get("warc-type") not in kinds:
            continue
        headers, payload = b"", content
        if fields.get("content-type", "").startswith("application/http"):
            headers, _, payload = content.partition(end)
        kind = fields.get("warc-type")
        length, sha1 = len(payload), None
        if kind == "response":
            sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        elif kind == "revisit":
            payload = None
            length = next((int(x.partition(b":")[2]) for x in headers.split(NL.encode()) if x.lower().startswith(b"content-length:")), None)
        yield kind, fields.get("warc-record-id"), fields.get("warc-concurrent-to"), fields.get("x-refers-to-page"), fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-payload-digest"), headers.decode("utf-8", "replace"), payload, length, sha1


def read_warc(spark: SparkSession, at: str, kinds: tuple[str, ...] = ("request", "response", "revisit", "metadata")) -> DataFrame:
    """Rows of RECORD for the records of these kinds in the archives in `at`. A file is parsed as a whole, so files must fit a worker's memory."""
    bound_batches(spark)
    types = [pa.string()] * 8 + [pa.binary(), pa.int64(), pa.string()]
    names = [f.split()[0] for f in RECORD.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                raw = data.as_py()
                for r in parsed(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw, kinds):
                    rows.append(r)
                    size += len(r[8] or b"")
                    if size > 4 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return spark.read.format("binaryFile").load(at).select("content").mapInArrow(parse, RECORD)


def transactions(records: DataFrame, requests: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """One row per capture: (record_id, uri, date, request, response, metadata), the last three nested, null where missing.

    Requests and metadata (of `records`, unless they are given apart) are joined to the response or revisit that they
    name as concurrent; those that name none that exists are left out. Payloads are dealt once, by record id, and not
    at all where they aren't asked for.
    """
    base = records.where(F.col("kind").isin("response", "revisit"))
    requests, metadata = records if requests is None else requests, records if metadata is None else metadata
    response = base.select("record_id", "uri", "date", F.struct("kind", "refers_to_page", "digest", "headers", "payload", "payload_bytes", "payload_sha1").alias("response"))
    request = requests.where("kind = 'request'").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "headers").alias("request"))
    metadata = metadata.where("kind = 'metadata'").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), F.col("payload").cast("string").alias("fields")).alias("metadata"))
    return response.join(request, "record_id", "left").join(metadata, "record_id", "left")


def captures(spark: SparkSession, at: str) -> DataFrame:
    """The transactions of the archives in `at`; each side of the joins parses only its own kind of record."""
    return transactions(*(read_warc(spark, at, kinds) for kinds in (("response", "revisit"), ("request",), ("metadata",))))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), at)
    found = captures(spark, at)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+):", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    # The digest in the record must be that of the payload, where there is one; a mismatch shows as null.
    stated = F.regexp_replace("response.digest", "^sha1:", "")
    digest = F.when(F.col("response.payload_sha1").isNull() | (F.col("response.payload_sha1") == stated), stated)
    return found.select(
        number(F.col("record_id")).alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.nullif(F.col("response.refers_to_page"), F.lit("")).cast("long").alias("refers_to"),
    )


#: The same rows in DuckDB's SQL, straight from the pages.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages), o AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS first, sha1(b) AS h FROM p)
SELECT page_id, octet_length(encode(b)) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || h[10 * (i // 8) + 1 : 10 * (i // 8) + 10])::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM o"""
