"""A WARC archive that stores every payload once, under its SHA-256 digest.

``write_archive`` makes two tables in a folder. ``payloads`` has one row for
each distinct payload: digest, length, the smallest page id that has it, and
the compressed bytes; equal digests are compared byte for byte. ``headers``
has one row for each page: the exact WARC header and HTTP header of its record
and the digest of its payload. ``read_archive`` joins the two on the digest,
verifies the digest of the bytes, and rebuilds each record; what the records
say is parsed from them. A payload that many pages have is copied to up to 16
keys of that join, and never more often than it has pages, so that its records
are rebuilt by several tasks. ``gzip_members`` gives what a compressed WARC file
consists of.

A payload of at least ``revisit_from`` bytes that several pages have is a
response for the smallest page id, and a revisit of it for the others; a
revisit's record has no payload of its own, but the join still gives it.

Nulls: a null payload is empty, a null URL leaves its header out, a null id is
written as ``null`` and never owns a payload that another page has. Rows with
the same id and payload are records of the same type each. An empty table
gives an empty archive.
"""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

_SALTS = 16
_LINE = "\r\n"


def _digested(pages: DataFrame, page_id: str, url: str, payload: str) -> DataFrame:
    raw = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    return pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), raw.alias("payload")).withColumn("digest", F.sha2("payload", 256))


def _payloads(rows: DataFrame) -> DataFrame:
    def compress(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            raw = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, raw), pa.int64()), pa.array(map(squeeze, raw), pa.binary())], names=["id", "digest", "bytes", "body"])

    packed = rows.select("id", "digest", "payload").mapInArrow(compress, "id long, digest string, bytes long, body binary")
    once = packed.groupBy("digest").agg(F.min("id").alias("owner"), F.count("*").alias("pages"), F.min("bytes").alias("bytes"), F.min("body").alias("body"), F.max("body").alias("other"))
    same = F.when(F.col("body") == F.col("other"), F.col("body")).otherwise(F.raise_error(F.lit("two payloads share a digest")).cast("binary"))
    return once.select("digest", "owner", "pages", "bytes", same.alias("body"))


def _header(revisit_from: int, date: str):
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_LINE}Content-Type: text/html; charset=utf-8{_LINE}Content-Length: "), F.col("bytes").cast("string"), F.lit(_LINE * 2))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    again = (F.col("bytes") >= revisit_from) & F.col("owner").isNotNull() & ~F.col("id").eqNullSafe(F.col("owner"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(_LINE))
    safe_url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    warc = F.concat(
        F.lit(f"WARC/1.1{_LINE}"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("id"))),
        F.coalesce(line("WARC-Target-URI", safe_url), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", name(F.col("owner"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit(_LINE),
    )
    return warc, http


def write_archive(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", revisit_from: int = 100, date: str = "2024-01-01T00:00:00Z"
) -> None:
    """Write the ``payloads`` and ``headers`` tables of an archive to the folder, which the cluster shares."""
    spark = pages.sparkSession
    rows = _digested(pages, page_id, url, payload)
    _payloads(rows).write.option("compression", "none").parquet(f"{folder}/payloads")
    shared = spark.read.parquet(f"{folder}/payloads").where("pages > 1").select("digest", "owner", "pages")
    # a payload that many pages share is dealt over the salts
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    # which of its copies a record is read with; the only record of a payload has the only copy
    copy = F.pmod("salt", F.least(F.coalesce("pages", F.lit(1)), F.lit(_SALTS))).cast("int")
    salted = rows.withColumn("bytes", F.octet_length("payload").cast("long")).drop("payload").withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(_SALTS)).cast("int"))
    known = salted.join(shared, ["digest", "salt"], "left").withColumn("owner", F.coalesce("owner", "id"))
    warc, http = _header(revisit_from, date)
    known.select("id", "digest", copy.alias("copy"), warc.alias("warc_header"), http.alias("http_header")).write.parquet(f"{folder}/headers")


def _parse(head: str) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.split(_LINE)[1:] if line)


def _page_of(name: str | None) -> int | None:
    value = name.removeprefix("<urn:page:").removesuffix(">") if name else "null"
    return None if value == "null" else int(value)


def read_archive(spark: SparkSession, folder: str, records: bool = True) -> DataFrame:
    """One row a record: page_id, payload_bytes, payload_digest, record_type, refers_to, and record and payload if asked for."""
    headers, payloads = spark.read.parquet(f"{folder}/headers"), spark.read.parquet(f"{folder}/payloads")
    copies = F.explode(F.sequence(F.lit(0), F.least("pages", F.lit(_SALTS)).cast("int") - 1))
    copied = payloads.select("digest", copies.alias("copy"), "body")
    joined = headers.join(copied, ["digest", "copy"]).select("digest", "warc_header", "http_header", "body")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["record", "payload"] if records else [])]

    def rebuild(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for digest, warc, http, body in zip(*(c.to_pylist() for c in batch.columns)):
                payload, fields = expand(body), _parse(warc)
                if hashlib.sha256(payload).hexdigest() != digest or fields["WARC-Payload-Digest"] != f"sha256:{digest}":
                    raise ValueError(f"payload {digest} is damaged")
                block = http.encode() + (b"" if fields["WARC-Type"] == "revisit" else payload)
                if len(block) != int(fields["Content-Length"]):
                    raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
                row = (_page_of(fields["WARC-Record-ID"]), len(payload), digest, fields["WARC-Type"], _page_of(fields.get("WARC-Refers-To")))
                out.append(row + ((warc.encode() + block + b"\r\n\r\n", payload) if records else ()))
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", record binary, payload binary" if records else "")
    return joined.mapInArrow(rebuild, schema)


def gzip_members(records: DataFrame) -> DataFrame:
    """page_id and member: each record as one gzip member. Members end to end, in any order, are a ``.warc.gz`` file."""

    def squeeze(batches):
        for batch in batches:
            members = [gzip.compress(r, mtime=0) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(members, pa.binary())], names=["page_id", "member"])

    return records.select("page_id", "record").mapInArrow(squeeze, "page_id long, member binary")
