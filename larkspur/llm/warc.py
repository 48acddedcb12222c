"""WARC archives: written by Spark's text sink, read back by a reader that salvages what stands after damage."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import join_checked, scratch
from larkspur.plans.spill import scratch_path

#: Bytes of an archive in the mean, and at most where a record is not longer; pages so many times the mean are dealt apart.
ARCHIVE_BYTES, LARGEST_ARCHIVE, LONG_PAGE = 32 << 20, 512 << 20, 16
#: Bytes of a record's headers, and of what a compressed member may hold, at most.
HEADER_BYTES, MEMBER_BYTES = 1 << 16, 1 << 31
#: Bytes of payloads in a batch that the reader passes on.
BATCH_BYTES = 16 << 20

END = "\r\n\r\n"
# Digits of base 32 as Spark's conv() and as RFC 4648 have them.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(text: Column) -> Column:
    """Base-32 SHA-1 of a text's bytes: five hexadecimal digits are four digits of base 32."""
    hexadecimal = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def _uuid(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "urn:uuid:$1-$2-$3-$4-$5")


def _header(name: str, value: Column) -> Column:
    """A header line; none where the value is null. What would end the line or is no visible character is percent-coded as a blank."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\x00-\x20\x7F]", "%20"), F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame) -> DataFrame:
    """(bytes, record) of pages (page_id, url, html): a WARC record's text per row, without the line ends that close it.

    Of rows with equal payloads that of the largest page_id, then the largest url, is the response; the others are revisits that
    refer to it and carry no payload. Only digests are shuffled to find them, and the groups of more than one row join the pages. Rows
    that are equal in all are brought together where they are the response; revisits of rows equal in all share a record id.
    """
    html = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", html.alias("html"), base32_sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    rank = F.struct(F.col("page_id").isNotNull().alias("known"), F.col("page_id"), F.coalesce("url", F.lit("")).alias("address"), F.col("url").isNotNull().alias("named"))
    same = own.select("digest", "page_id", "url").groupBy("digest", "page_id", "url").agg(F.count(F.lit(1)).alias("rows"))
    groups = same.groupBy("digest").agg(F.sum("rows").alias("all"), F.max(F.struct(rank.alias("rank"), "url", "rows")).alias("first")).where(F.col("all") > 1)
    groups = scratch(groups.select("digest", F.col("first.rank.page_id").alias("first_id"), F.col("first.url").alias("first_url"), (F.col("first.rows") > 1).alias("repeated")))
    placed = join_checked(own, groups, "digest", "left").withColumn(
        "is_first", F.col("repeated").isNull() | (F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url")))
    )
    if groups.where("repeated").isEmpty():
        placed = placed.withColumn("copy", F.lit(1).cast("long"))
    else:
        again = F.coalesce("is_first", F.lit(False)) & F.coalesce("repeated", F.lit(False))
        brought = placed.where(again).groupBy("digest", "page_id", "url", "bytes", "first_id", "first_url", "repeated", "is_first").agg(F.first("html").alias("html"), F.count(F.lit(1)).alias("n"))
        brought = brought.withColumn("copy", F.explode(F.expr("sequence(1L, n)"))).withColumn("is_first", F.col("copy") == 1).drop("n")
        placed = placed.where(~again).withColumn("copy", F.lit(1).cast("long")).unionByName(brought)
    response = F.col("is_first")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(response, F.concat(http, F.col("html"))).otherwise(http)
    out = placed.select("*", block.alias("block"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(response, "response").otherwise("revisit")),
        _header("WARC-Record-ID", F.concat(F.lit("<"), _uuid(F.col("page_id"), F.col("url"), F.col("digest"), F.when(response, F.lit(0)).otherwise(F.col("copy"))), F.lit(">"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Refers-To", F.when(~response, F.concat(F.lit("<"), _uuid(F.col("first_id"), F.col("first_url"), F.col("digest"), F.lit(0)), F.lit(">")))),
        _header("WARC-Profile", F.when(~response, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _header("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("block")))),
        _header("Page-ID", F.col("page_id")),
        _header("Refers-To-Page-ID", F.when(~response, F.col("first_id"))),
        _header("Payload-Bytes", F.col("bytes")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        _header("Content-Length", F.octet_length("block")),
        F.lit("\r\n"),
        F.col("block"),
    )
    return out.select("bytes", record.alias("record"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a WARC record per row of pages (page_id, url, html) below ``path``: plain archives, whose size is bounded.

    Spark's text sink writes them, closing each record by two line ends, so archives appear whole or not at all and in any store.
    Pages are not shuffled for it: the records of a file are so many that it has ARCHIVE_BYTES in the mean, and long pages, which
    could add up to more, go to archives of their own. Null: an empty payload, no address. Other columns are not read.
    """
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("long")
    mean, most = (int(x or 0) for x in pages.select(size.alias("b")).agg(F.avg("b"), F.max("b")).first())
    usual = LONG_PAGE * (mean + 1024)
    rows = records(pages)
    parts = [(rows.where(F.col("bytes") <= usual), ARCHIVE_BYTES // (mean + 1024))]
    if most > usual:
        parts.append((rows.where(F.col("bytes") > usual), LARGEST_ARCHIVE // (most + 1024)))
    for part, n in parts:
        part.select("record").write.mode("append").option("lineSep", END).option("maxRecordsPerFile", max(1, n)).text(path)


class Found(NamedTuple):
    """A record of an archive, or a gap of bytes that no record could be read from."""

    offset: int
    length: int
    gap: str | None
    headers: dict[str, str]
    block: bytes


_VERSION = re.compile(rb"WARC/1\.[0-9]\r\n")
_MEMBER = b"\x1f\x8b\x08"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _payload(block: bytes) -> bytes:
    """What stands after the HTTP headers of a block."""
    head, mark, rest = block.partition(b"\r\n\r\n")
    return rest if head.startswith(b"HTTP/") and mark else block


def _record_at(data: bytes, start: int) -> Found | str:
    """The record that begins at a place, or which check it fails."""
    if not _VERSION.match(data, start):
        return "no version line"
    ends = data.find(b"\r\n\r\n", start, start + HEADER_BYTES)
    if ends < 0:
        return "headers do not end"
    headers: dict[str, str] = {}
    for line in data[start:ends].split(b"\r\n")[1:]:
        name, mark, value = line.partition(b":")
        if not mark or not name.strip():
            return "bad header line"
        headers[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,15}", length):
        return "no content length"
    begin, stop = ends + 4, ends + 4 + int(length)
    if stop > len(data):
        return "block is cut short"
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "record does not end where its length says"
    block = data[begin:stop]
    for name, what in (("warc-block-digest", block), ("warc-payload-digest", _payload(block))):
        kind, _, wanted = headers.get(name, "").partition(":")
        if kind.lower() == "sha1" and not (name == "warc-payload-digest" and headers.get("warc-type") == "revisit") and wanted.upper() != _digest(what):
            return f"{name} differs"
    return Found(start, stop + 4 - start, None, headers, block)


def _member_at(data: bytes, start: int) -> tuple[bytes, int] | str:
    """What the compressed member at a place holds, and where it ends."""
    inflate = zlib.decompressobj(31)
    try:
        out = inflate.decompress(data[start:], MEMBER_BYTES)
    except zlib.error as e:
        return f"bad member: {e}"
    if not inflate.eof:
        return "member is cut short" if len(out) < MEMBER_BYTES else "member is too large"
    return out, len(data) - len(inflate.unused_data)


def _plain(data: bytes) -> Iterator[Found]:
    at = 0
    while at < len(data):
        found = _record_at(data, at)
        if isinstance(found, Found):
            yield found
            at += found.length
            continue
        gap, why, after = at, found, len(data)
        for m in _VERSION.finditer(data, at + 1):
            if isinstance(_record_at(data, m.start()), Found):
                after = m.start()
                break
        yield Found(gap, after - gap, why, {}, b"")
        at = after


def _members(data: bytes) -> Iterator[Found]:
    at = 0
    while at < len(data):
        got = _member_at(data, at) if data.startswith(_MEMBER, at) else "no member"
        if not isinstance(got, str):
            inside = list(_plain(got[0]))
            # A member's records have its place; what is damaged inside is a gap of the member.
            for f in inside or [Found(0, 0, "member holds nothing", {}, b"")]:
                yield f._replace(offset=at, length=got[1] - at)
            at = got[1]
            continue
        after, nearest = len(data), data.find(_MEMBER, at + 1)
        while nearest >= 0:
            if not isinstance(_member_at(data, nearest), str):
                after = nearest
                break
            nearest = data.find(_MEMBER, nearest + 1)
        yield Found(at, after - at, got, {}, b"")
        at = after


def salvage(data: bytes) -> Iterator[Found]:
    """The records of an archive in order and the gaps between them.

    A record counts if its version line, headers, length, end and SHA-1 digests are right. After a failed check the next place where
    a record (in compressed archives a member, whose own checksum must be right) passes all of them is searched for; the
    bytes up to it are a gap, with the check that failed. Every byte is in a record, a member or a gap.
    """
    first = data.find(_MEMBER), _VERSION.search(data)
    compressed = first[0] >= 0 and (first[1] is None or first[0] < first[1].start())
    return _members(data) if compressed else _plain(data)


READ = "archive string, offset long, length long, gap string, type string, record_id string, uri string, page_id long, refers_to long, payload_digest string, payload_bytes long, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives below ``path``: (archive, offset, length, gap, type, record_id, uri, page_id, refers_to, payload_digest, payload_bytes, payload).

    A gap has its reason and no more. The digest of a record with a payload is reckoned anew, that of a revisit is its header's.
    Archives are read whole, each by one task: plain ones as written by write_archives() are bounded in size, and
    Spark's limit for binary files bounds others. Without ``payloads`` the payload column is null. Empty archives have no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([pa.field(*x) for x in zip(_NAMES, _TYPES, strict=True)])
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, held = [], 0
                for f in salvage(content.as_py()):
                    rows.append(_row(name.as_py(), f, payloads))
                    held += len(f.block) * payloads + 200
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where("length > 0").select("path", "content").mapInArrow(read, READ)


_NAMES = [x.split(" ")[0] for x in READ.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split(" ")[1]] for x in READ.split(", ")]


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch("-?[0-9]{1,18}", text) else None


def _row(archive: str, f: Found, payloads: bool) -> tuple:
    if f.gap is not None:
        return archive, f.offset, f.length, f.gap, *[None] * 8
    h, kind = f.headers, f.headers.get("warc-type")
    payload = None if kind == "revisit" else _payload(f.block)
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None if payload is None else _digest(payload)
    size = _number(h.get("payload-bytes")) if payload is None else len(payload)
    return archive, f.offset, f.length, None, kind, h.get("warc-record-id"), h.get("warc-target-uri"), _number(h.get("page-id")), _number(h.get("refers-to-page-id")), digest, size, payload if payloads else None


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages, written to archives and read back.

    A null page_id is never that of a response unless all of its payload are; its revisits refer to null. Of rows that share the
    largest page_id of a payload one is the response. An empty table gives an empty one.
    """
    spark = pages.sparkSession
    path = scratch_path(spark)
    write_archives(pages, path)
    found = read_archives(spark, path, payloads=False)
    return found.where("gap is null").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS bytes, sha1(coalesce(html, '')) AS hex FROM pages
), g AS (
  SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS place, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS first_id FROM p
), d AS (
  SELECT *, [CAST('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT) FOR i IN range(8)] AS parts FROM g
)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((parts[(i // 4) + 1] >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN first_id END AS refers_to FROM d
"""
