"""WARC archives: pages are written as transactions of records, and read back as one nested row per capture.

Writing. Each page becomes a request, a response and a metadata record; request and metadata name the response
in WARC-Concurrent-To. Of pages with equal payloads (by length and SHA-1) the one with the largest ``page_id``
is a response with the payload, the others are revisit records that refer to it and hold only the HTTP headers.
Archives are written by Spark's own text sink, so task retries, renames and any Hadoop file system are its
business: a record is one value, and the line separator is the second of the two line ends that close a record.
A part file is one gzip stream of at most ``RECORDS`` records.

Reading. Files come through ``binaryFile``, are decompressed as a stream (one or many gzip members, or none) and
cut by Content-Length, so nothing inside a payload can end a record. A task holds the files of its split and one
record; files should be far smaller than an executor's memory. Any WARC writer's files can be read.

Assembly. ``captures`` joins records through their concurrent-to identifiers: first those that name a response
(or revisit, resource), then those that a response names, and those one step further, such as a metadata
record that names the request. A record that leads to no response makes a row of its own without one. More
than ``MEMBERS`` records of one capture are dealt to several rows (``part``), so no group is unbounded.

Defined cases: a null html is an empty payload; a null url leaves out WARC-Target-URI; line ends in a url are
percent-encoded, white space at its ends is lost; a null ``page_id`` comes back as null and is never the largest
beside others; repeated rows are captures of their own, of which one is the response; extra columns are ignored;
an empty table gives no rows. Where a file is cut short or is not WARC, the intact records before that place are
returned, then one record of the type ``damaged`` (it makes no capture).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgale.llm.common import salted_lookup, staged, table
from gridgale.session import staging_path

RECORDS, MEMBERS, LEAST_BYTES = 6_000, 1_000, 0
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
MAIN = ("response", "revisit", "resource")

_LINE, _BATCH_ROWS, _BATCH_BYTES = 1 << 20, 2_000, 16 << 20
_END = "\r\n"
_RECORD = (
    "type string, record_id string, date string, target_uri string, concurrent_to array<string>, refers_to string, "
    "declared_digest string, http_status string, http_headers map<string,string>, fields map<string,string>, "
    "payload_bytes long, payload_digest string, payload binary"
)
_NAMES = [c.split()[0] for c in _RECORD.replace("<string,string>", "").split(", ")]


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: five of them are four digits to the base of 32."""
    fours = [
        F.lpad(F.conv(F.substr(hexadecimal, F.lit(1 + 5 * g), F.lit(5)), 16, 32), 4, "0") for g in range(8)
    ]
    return F.translate(F.concat(*fours), DIGITS, BASE32)


def _identifier(archive: str, role: str, capture: str) -> Column:
    """A record's identifier, from the archive's name, the record's role and the capture's number."""
    digits = F.md5(F.concat(F.lit(f"{archive} {role} "), F.col(capture).cast("string")))
    cut = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.concat(F.lit("<urn:uuid:"), cut, F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """Headers whose value is null are left out; the sink adds the second closing line end."""
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit("")) for name, value in headers]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END + _END))
    return F.concat(F.lit("WARC/1.1" + _END), *lines, size, block, F.lit(_END))


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, records: int = RECORDS, date: str = DATE) -> None:
    """Archives of all ``pages`` (page_id, url, html) under ``path``."""
    html = F.coalesce("html", F.lit(""))
    rows = staged(pages.select(
        F.monotonically_increasing_id().alias("capture"), F.col("page_id").cast("long"), "url", html.alias("html"),
        F.octet_length(html).cast("long").alias("bytes"), F.sha1(html).alias("sha1"),
    ), "payloads")
    narrow = rows.where(F.col("bytes") >= least_bytes).select(
        "capture", "page_id", F.struct("bytes", F.unhex("sha1")).alias("payload")
    )
    firsts = narrow.groupBy("payload").agg(
        F.max(F.struct("page_id", "capture"))["capture"].alias("first"), F.count("*").alias("n")
    ).where("n > 1").drop("n")
    again = salted_lookup(narrow, firsts, "payload", "capture").where("first != capture")
    decided = rows.join(staged(again.select("capture", "first"), "revisits"), "capture", "left")

    archive = uuid.uuid4().hex
    response, first = _identifier(archive, "response", "capture"), _identifier(archive, "response", "first")
    target = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    host = F.regexp_extract(F.coalesce(target, F.lit("")), r"^[^:/?#]+://([^/?#\s]*)", 1)
    place = F.regexp_extract(F.coalesce(target, F.lit("")), r"^[^:/?#]+://[^/?#]*([^#\s]*)", 1)
    is_again = F.col("first").isNotNull()

    def common(kind: Column, own: Column) -> list[tuple[str, Column]]:
        return [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", target)]

    asked = F.concat(F.lit("GET "), F.when(place == "", "/").otherwise(place), F.lit(f" HTTP/1.1{_END}Host: "), host, F.lit(_END + _END))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
        F.col("bytes").cast("string"), F.lit(_END + _END),
    )
    about = F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit(_END)), F.lit(""))
    made = F.array(
        _record([
            *common(F.lit("request"), _identifier(archive, "request", "capture")), ("WARC-Concurrent-To", response),
            ("Content-Type", F.lit("application/http; msgtype=request")),
        ], asked),
        _record([
            *common(F.when(is_again, "revisit").otherwise("response"), response),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
            ("WARC-Profile", F.when(is_again, F.lit(PROFILE))), ("WARC-Refers-To", F.when(is_again, first)),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ], F.when(is_again, head).otherwise(F.concat(head, "html"))),
        _record([
            *common(F.lit("metadata"), _identifier(archive, "metadata", "capture")), ("WARC-Concurrent-To", response),
            ("Content-Type", F.lit("application/warc-fields")),
        ], about),
    )
    decided.select(F.explode(made).alias("value")).write.option("lineSep", _END).option(
        "maxRecordsPerFile", records
    ).option("compression", "gzip").text(path)


def _fields(lines: list[bytes]) -> list[tuple[str, str]]:
    """Named values of header lines; a line that begins with white space goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            name, _, value = text.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def parsed(stream: BinaryIO, payloads: bool = True) -> Iterator[tuple]:
    """Records of an archive in its order, as rows of ``_RECORD``."""
    damaged = ("damaged", None, None, None, [], None, None, None, {}, {}, None, None, None)
    try:
        while line := stream.readline(_LINE):
            if not line.strip():
                continue
            lines = []
            while (header := stream.readline(_LINE)).strip():
                lines.append(header)
            named = _fields(lines)
            one = dict(reversed(named))
            if not line.startswith(b"WARC/") or not one.get("content-length", "").isdecimal():
                yield damaged
                return
            size = int(one["content-length"])
            block = stream.read(size)
            if len(block) < size:
                yield damaged
                return
            status, http, fields, payload = None, {}, {}, None
            kind = one.get("content-type", "").lower()
            if kind.startswith("application/http"):
                head, _, body = block.partition(b"\r\n\r\n")
                status, *rest = head.split(b"\r\n")
                status, http = status.decode("utf-8", "replace"), dict(reversed(_fields(rest)))
                if one.get("warc-type") == "response":
                    payload = body
            elif kind.startswith("application/warc-fields"):
                fields = dict(reversed(_fields(block.split(b"\r\n"))))
            elif one.get("warc-type") != "revisit":
                payload = block
            yield (
                one.get("warc-type"), one.get("warc-record-id"), one.get("warc-date"), one.get("warc-target-uri"),
                [v for n, v in named if n == "warc-concurrent-to"], one.get("warc-refers-to"),
                one.get("warc-payload-digest"), status, http, fields,
                None if payload is None else len(payload),
                None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                payload if payloads else None,
            )
    except (EOFError, OSError, zlib.error):
        yield damaged


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; without ``payloads`` their bytes stay in the tasks."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for content in batch["content"]:
                plain = io.BytesIO(content)
                stream = gzip.GzipFile(fileobj=plain) if content[:2] == b"\x1f\x8b" else plain
                for record in parsed(stream, payloads):
                    held.append(record)
                    size += len(record[-1] or b"")
                    if len(held) >= _BATCH_ROWS or size >= _BATCH_BYTES:
                        yield pd.DataFrame(held, columns=_NAMES).astype({"payload_bytes": "Int64"})
                        held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=_NAMES).astype({"payload_bytes": "Int64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, _RECORD)


def captures(records: DataFrame, members: int = MEMBERS) -> DataFrame:
    """(capture, part, response, requests, metadata): one nested row per capture, joined through concurrent-to
    identifiers. All columns of ``records`` but those identifiers are carried into the nested structs, so select
    what is wanted beforehand; ``type``, ``record_id`` and ``concurrent_to`` must be there."""
    named = records.where(F.col("record_id").isNotNull() & F.col("type").isNotNull() & (F.col("type") != "damaged"))
    inner = [c for c in records.columns if c != "concurrent_to"]
    main, others = named.where(F.col("type").isin(*MAIN)), named.where(~F.col("type").isin(*MAIN))
    starts = main.select(F.col("record_id").alias("capture"))
    direct = others.withColumn("target", F.get("concurrent_to", F.lit(0)))
    # Most records name their response first; that one join carries them. Its keys are split by adaptive
    # execution where one is hot; doubled identifiers of responses would double rows, so they meet once.
    placed = staged(direct.join(
        starts.groupBy("capture").agg(F.lit(True).alias("known")), F.col("target") == F.col("capture"), "left"
    ).drop("target", "known"), "placed-records")
    found, loose = placed.where("capture IS NOT NULL"), placed.where("capture IS NULL")
    placed = found.unionByName(_reached(loose, main, found, starts.distinct()).withColumn("capture", F.coalesce("capture", "record_id")))

    parts = placed.groupBy("capture").agg(F.ceil(F.count("*") / members).alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("record_id"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = placed.join(staged(parts, "large-captures"), "capture", "left").withColumn("part", part)
    rows = dealt.select("capture", "part", F.struct(*inner).alias("r")).union(
        main.select("record_id", F.lit(0), F.struct(*inner))
    )

    def by_id(x: Column, y: Column) -> Column:
        return F.when(x["record_id"] < y["record_id"], -1).when(x["record_id"] > y["record_id"], 1).otherwise(0)

    def listed(which: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(which, F.col("r"))), by_id)

    kind = F.col("r.type")
    return rows.groupBy("capture", "part").agg(
        F.collect_list(F.when(kind.isin(*MAIN), F.col("r"))).alias("responses"),
        listed(kind == "request").alias("requests"), listed(~kind.isin(*MAIN, "request")).alias("metadata"),
    ).select("capture", "part", F.explode_outer("responses").alias("response"), "requests", "metadata")


def _reached(loose: DataFrame, main: DataFrame, found: DataFrame, starts: DataFrame) -> DataFrame:
    """``loose`` with the capture that other links reach: a later identifier of their own, a response that names
    them, or a record of either kind one step further. The smallest one counts."""
    def links(df: DataFrame) -> DataFrame:
        return df.select("record_id", F.explode("concurrent_to").alias("other"))

    own, theirs = links(loose), links(main.unionByName(found.drop("capture"))).select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))
    ways = own.union(own.select("other", "record_id")).union(theirs.join(loose.select("record_id").distinct(), "record_id", "left_semi"))
    ways = ways.where("record_id != other").distinct()

    def nearest(ways: DataFrame, reached: DataFrame) -> DataFrame:
        met = salted_lookup(ways, reached.select(F.col("record_id").alias("other"), F.col("capture").alias("_met")), "other", "record_id")
        return met.where("_met IS NOT NULL").groupBy("record_id").agg(F.min("_met").alias("_met"))

    near = staged(nearest(ways, starts.select(F.col("capture").alias("record_id"), "capture")), "near-records")
    known = found.groupBy("record_id").agg(F.min("capture").alias("capture")).unionByName(near.withColumnRenamed("_met", "capture"))
    far = nearest(ways.join(near.select("record_id"), "record_id", "left_anti"), known.groupBy("record_id").agg(F.min("capture").alias("capture")))
    return salted_lookup(loose, near.union(far), "record_id", "record_id").withColumn("capture", F.col("_met")).drop("_met")


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all captures of ``write``'s archives."""
    is_response = F.col("type") == "response"
    records = staged(read(spark, path, payloads=False).select(
        "type", "record_id", "concurrent_to", "refers_to", F.col("fields")["page_id"].cast("long").alias("page_id"),
        F.when(is_response, F.col("payload_bytes")).otherwise(F.col("http_headers")["content-length"].cast("long")).alias("bytes"),
        F.when(is_response, F.col("payload_digest")).otherwise(F.regexp_replace("declared_digest", "^sha1:", "")).alias("digest"),
    ), "records")
    rows = staged(captures(records).where("response IS NOT NULL AND part = 0").select(
        "capture", F.array_max("metadata.page_id").alias("page_id"), F.col("response.bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("target"),
    ), "captures")
    firsts, again = rows.where("record_type = 'response'"), rows.where("record_type != 'response'")
    targets = firsts.select(F.col("capture").alias("target"), F.col("page_id").alias("refers_to")).join(
        again.select("target").distinct(), "target", "left_semi")
    whole = firsts.withColumn("refers_to", F.lit(None).cast("long")).unionByName(salted_lookup(again, targets, "target", "capture"))
    return whole.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return page_records(spark, path)


SQL = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT hex, payload_bytes, max(page_id) AS first FROM payloads GROUP BY ALL)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM payloads JOIN firsts USING (hex, payload_bytes)
"""
