"""Legacy ARC archives read, turned into WARC archives with revisit records, and read back."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, scratch, stored, utf8

#: Fixed values of both formats: the fields of a record's line in ARC versions 1 and 2, and the WARC version line.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
WARC_VERSION = b"WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: The header of a response that names the page.
ID_HEADER = "X-Page-Id"
#: Payload bytes and records that a reading task gathers before it sends them, and the longest line that can be a header.
SENT_BYTES, SENT_RECORDS, LINE = 8 << 20, 1_000, 1 << 20

ARC_SCHEMA = (
    "archive string, offset long, version int, url string, ip string, archive_date string, content_type string, result_code int, "
    "checksum string, location string, declared long, head binary, payload binary, problem string"
)
WARC_SCHEMA = (
    "archive string, offset long, record_id string, warc_type string, target_uri string, warc_date string, refers_to string, "
    "declared_digest string, truncated string, head binary, payload binary, payload_digest string, payload_bytes long, problem string"
)


def _gathered(rows: Iterator[tuple], schema: pa.Schema, weighs: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        cols = list(zip(*held)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    for row in rows:
        held.append(row)
        size += weighs(row)
        if size > SENT_BYTES or len(held) >= SENT_RECORDS:
            yield batch()
            held, size = [], 0
    yield batch()


def _opened(content: bytes) -> io.BufferedReader:
    """The archive's bytes; gzip members, one or many, are read as they come."""
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content), 1 << 16)


def _block(f: io.BufferedReader, length: int) -> bytes:
    """As many bytes as are declared and there are; memory is taken for those that are there."""
    parts, left = [], length
    while left and (part := f.read(min(left, 1 << 20))):
        parts.append(part)
        left -= len(part)
    return b"".join(parts)


def _write(records: DataFrame, path: str) -> None:
    """A row's bytes and a line feed each; a partition is an archive. Spark's committer keeps what one attempt of a task wrote."""
    records.select(F.col("record").cast("string")).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


# ARC


def write_arc(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    versions: tuple[int, ...] = (1, 2),
    archive_date: str = "20000101000000",
    origin: str = "pages",
) -> None:
    """Write pages as gzipped ARC archives, an archive for each partition of pages; partitions take turns in the versions.

    A record's block is an HTTP response with the page's id in its head. White space and control characters of a url are
    percent-encoded, as a header line is split at spaces; a null url is "-". Null html is an empty payload; a null id has no header. An empty table leaves archives
    with a version block alone, or none.
    """
    rows = pages.select(F.col(f"`{page_id}`").cast("string").alias("id"), F.coalesce(F.col(f"`{url}`"), F.lit("-")).alias("url"), utf8(f"`{html}`").alias("html"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version = versions[part % len(versions)]
        name = f"pages-{part:05d}.arc"
        block = f"{version} 0 {origin}\n{' '.join(ARC_FIELDS[version])}\n".encode()

        def line(url: bytes, mime: str, result: str, offset: int, length: int) -> bytes:
            more = f" {result} - - {offset} {name}" if version == 2 else ""
            return url + f" 0.0.0.0 {archive_date} {mime}{more} {length}\n".encode()

        out = [line(f"filedesc://{name}".encode(), "text/plain", "200", 0, len(block)) + block]
        at = len(out[0]) + 1
        for batch in batches:
            for id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                url = b"".join(b"%%%02X" % c if c <= 0x20 or c == 0x7F else bytes((c,)) for c in url.encode()) or b"-"
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"{ID_HEADER}: {id}\r\n" if id is not None else "") + f"Content-Length: {len(html)}\r\n\r\n"
                out.append(line(url, "text/html", "200", at, len(head) + len(html)) + head.encode() + html)
                at += len(out[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
            out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    _write(rows.mapInArrow(lines, "record binary"), path)


def _http(block: bytes) -> tuple[bytes | None, bytes]:
    """Head (with its empty line) and payload; no head if the block is no HTTP response."""
    if not block.startswith(b"HTTP/"):
        return None, block
    ends = [i + n for mark, n in ((b"\r\n\r\n", 4), (b"\n\n", 2)) if (i := block.find(mark)) >= 0]
    return (block[: min(ends)], block[min(ends) :]) if ends else (block, b"")


def arc_header(line: bytes, version: int) -> tuple | None:
    """A record line's fields by its version, none missing, or None. A url with spaces keeps them: fields are counted from the right."""
    fields = line.rstrip(b"\r\n").decode("utf-8", "replace").rsplit(" ", len(ARC_FIELDS[version]) - 1)
    if len(fields) != len(ARC_FIELDS[version]) or not (fields[-1].isascii() and fields[-1].isdigit()):
        return None
    if version == 1:
        return (*fields[:4], None, None, None, int(fields[4]))
    code = int(fields[4]) if fields[4].isascii() and fields[4].isdigit() and len(fields[4]) < 6 else None
    return (*fields[:4], code, *(None if x == "-" else x for x in fields[5:7]), int(fields[9]))


def arc_records(archive: str, content: bytes) -> Iterator[tuple]:
    """The records of one archive. The first record's block tells the version of all lines after it; an archive without one is of version 1.

    A block is as long as its line declares, whatever it holds; line ends between records are skipped. A block that ends early is
    kept, with the problem "truncated". After a line that is no header, or bytes that are not gzip, nothing can be trusted: the rest of the archive is one
    row with the problem and no url.
    """
    f, at, version = _opened(content), 0, 1
    try:
        while line := f.readline(LINE):
            began, at = at, at + len(line)
            if not line.strip():
                continue
            first = line.startswith(b"filedesc://")
            if first and len(line.split(b" ")) == len(ARC_FIELDS[2]):
                version = 2
            found = arc_header(line, version)
            if found is None:
                yield (archive, began, version, *[None] * 10, "not a header line")
                return
            block = _block(f, found[-1])
            at += len(block)
            if first:
                told = block.split(b" ", 1)[0]
                version = int(told) if told in (b"1", b"2") else version
            head, payload = _http(block)
            yield (archive, began, version, *found, head, payload, "truncated" if len(block) < found[-1] else None)
    except (OSError, EOFError, gzip.zlib.error) as e:
        yield (archive, at, version, *[None] * 10, f"not readable: {type(e).__name__}")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the ARC archives (plain or gzipped) in a folder, see arc_records; an archive is read by one task."""
    schema = pa.schema([(c.name, pa.string() if isinstance(c.dataType, T.StringType) else pa.binary() if isinstance(c.dataType, T.BinaryType) else pa.int32() if isinstance(c.dataType, T.IntegerType) else pa.int64()) for c in T.StructType.fromDDL(ARC_SCHEMA)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns):
                yield from _gathered(arc_records(name.as_py(), content.as_py()), schema, lambda r: len(r[12] or b"") + len(r[11] or b""))

    return _files(spark, path).mapInArrow(rows, ARC_SCHEMA)


# ARC to WARC


def _warc_date(date: Column) -> Column:
    """ISO 8601 of an ARC date of 8 to 14 digits, its missing digits taken as the earliest; the epoch for what is no date."""
    digits = F.when(date.rlike("^[0-9]{8,14}$"), F.rpad(date, 14, "0"))
    moment = F.try_to_timestamp(F.concat(digits, F.lit(" +0000")), F.lit("yyyyMMddHHmmss xx"))
    seconds = F.coalesce(F.unix_timestamp(moment), F.lit(0))
    days = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(days.cast("string"), F.lit("T"), two(rest / 3600), F.lit(":"), two(F.pmod(rest, F.lit(3600)) / 60), F.lit(":"), two(F.pmod(rest, F.lit(60))), F.lit("Z"))


def _header(head: Column, name: str) -> Column:
    found = F.regexp_extract(head.cast("string"), rf"(?i)\r?\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.trim(found))


def as_warc(arc: DataFrame) -> DataFrame:
    """The WARC fields of read_arc's records: record_id, warc_type, target_uri, warc_date, block_digest, payload_digest, page_id.

    The id is a digest of the archive's name, the offset and the record's line, so a task that runs again gives the same one. filedesc:// is
    warcinfo, an HTTP response is response, all else is resource. Records without a url (see arc_records) have a null type.
    """
    name = F.sha2(F.concat_ws(" ", F.coalesce("archive", F.lit("")), "offset", "url", "archive_date", "declared"), 256)
    dashed = F.concat_ws("-", *[F.substring(name, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    kind = F.when(F.col("url").isNull(), None).when(F.col("url").startswith("filedesc://"), "warcinfo").when(F.col("head").isNotNull(), "response").otherwise("resource")
    return arc.select(
        "*",
        F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"),
        kind.alias("warc_type"),
        F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20").alias("target_uri"),
        _warc_date(F.col("archive_date")).alias("warc_date"),
        F.sha2(F.concat(F.coalesce("head", F.lit(b"")), "payload"), 256).alias("block_digest"),
        F.sha2("payload", 256).alias("payload_digest"),
        _header(F.col("head"), ID_HEADER).cast("long").alias("page_id"),
    )


def with_revisits(records: DataFrame, min_bytes: int = 100) -> DataFrame:
    """as_warc's records with first_id, first_uri and first_date of the response with an equal payload, if a record repeats one.

    Of responses whose payloads of at least min_bytes are equal, the one with the smallest page_id is the first (null ids last, then
    the smallest record_id). Digests are counted before they are shuffled, and only those found more than once are joined
    to the records; Spark broadcasts them where they are few and else splits a digest with very many records.
    """
    small = records.where((F.col("warc_type") == "response") & F.col("problem").isNull() & (F.length("payload") >= min_bytes))
    rank = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "record_id", F.col("target_uri").alias("uri"), F.col("warc_date").alias("date"))
    first = small.groupBy("payload_digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stored(first.select(F.col("payload_digest").alias("digest"), F.col("first.record_id").alias("first_id"), F.col("first.uri").alias("first_uri"), F.col("first.date").alias("first_date")), "repeats")
    own = (F.col("payload_digest") == F.col("digest")) & (F.col("warc_type") == "response") & (F.length("payload") >= min_bytes) & F.col("problem").isNull()
    same = F.col("record_id") == F.col("first_id")
    return records.join(first, own, "left").select(*[f"`{c}`" for c in records.columns], *[F.when(~same, F.col(c)).alias(c) for c in ("first_id", "first_uri", "first_date")])


def write_warc(records: DataFrame, path: str) -> None:
    """Write with_revisits' records as gzipped WARC archives, an archive for each partition. A revisit has its own HTTP head and no payload. Records
    with a null type are not written: they have no content (read_arc tells of them)."""
    again = F.col("first_id").isNotNull()
    block = F.concat(F.coalesce("head", F.lit(b"")), F.when(again, F.lit(b"")).otherwise(F.col("payload")))
    http = F.col("head").isNotNull()
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))
    lines = F.concat(
        F.lit(WARC_VERSION.decode()),
        field("WARC-Type", F.when(again, "revisit").otherwise(F.col("warc_type"))),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Date", F.col("warc_date")),
        field("WARC-Target-URI", F.when(F.col("warc_type") != "warcinfo", F.col("target_uri"))),
        field("WARC-Filename", F.when(F.col("warc_type") == "warcinfo", F.substring("target_uri", 12, 1 << 20))),
        field("WARC-IP-Address", F.when(F.col("ip").rlike(r"^[0-9A-Fa-f.:]+$") & (F.col("ip") != "0.0.0.0"), F.col("ip"))),
        field("WARC-Payload-Digest", F.when(http, F.concat(F.lit("sha256:"), "payload_digest"))),
        field("WARC-Block-Digest", F.when(~again, F.concat(F.lit("sha256:"), "block_digest"))),
        field("WARC-Profile", F.when(again, REVISIT_PROFILE)),
        field("WARC-Refers-To", F.col("first_id")),
        field("WARC-Refers-To-Target-URI", F.col("first_uri")),
        field("WARC-Refers-To-Date", F.col("first_date")),
        field("WARC-Truncated", F.when(F.col("problem") == "truncated", "length")),
        field("Content-Type", F.when(http, "application/http; msgtype=response").when(F.col("warc_type") == "warcinfo", "text/plain").otherwise(F.col("content_type"))),
        field("Content-Length", F.length(block).cast("string")),
        F.lit("\r\n\r\n"),
    )
    rows = records.where("warc_type IS NOT NULL")
    _write(rows.select(F.concat(lines.cast("binary"), block, F.lit(b"\r\n\r")).alias("record")), path)  # the row's line feed ends it


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 100) -> None:
    """Convert the ARC archives in a folder to WARC archives in another one.

    Empty payloads, very long ones (an archive, and so a record, must fit in a task), repeated records, null urls and damaged archives are
    treated as read_arc, with_revisits and write_warc say; a folder must have a file, which may be empty.
    """
    write_warc(with_revisits(as_warc(read_arc(spark, arc_path)), min_bytes), warc_path)


# WARC


def warc_records(archive: str, content: bytes, payloads: bool) -> Iterator[tuple]:
    """The records of one WARC archive, with the digest and length of the payload that is there; the payload itself only if asked for."""
    f, at = _opened(content), 0
    nothing = [None] * 11
    try:
        while line := f.readline(LINE):
            began, at = at, at + len(line)
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                yield (archive, began, *nothing, "not a version line")
                return
            found: dict[str, str] = {}
            while (line := f.readline(LINE)).strip():
                at += len(line)
                name, _, value = line.decode("utf-8", "replace").partition(":")
                found[name.strip().lower()] = value.strip()
            at += len(line)
            length = found.get("content-length", "")
            if not (length.isascii() and length.isdigit()):
                yield (archive, began, *nothing, "no length")
                return
            block = _block(f, int(length))
            at += len(block)
            head, payload = _http(block)
            yield (
                archive, began, found.get("warc-record-id"), found.get("warc-type"), found.get("warc-target-uri"), found.get("warc-date"), found.get("warc-refers-to"),
                found.get("warc-payload-digest", "").removeprefix("sha256:") or None, found.get("warc-truncated"),
                head, payload if payloads else None, hashlib.sha256(payload).hexdigest(), len(payload), "truncated" if len(block) < int(length) else None,
            )
    except (OSError, EOFError, gzip.zlib.error) as e:
        yield (archive, at, *nothing, f"not readable: {type(e).__name__}")


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the WARC archives in a folder, in WARC_SCHEMA, and page_id from the response's head. What can't be read has a problem."""
    schema = pa.schema([(c.name, pa.string() if isinstance(c.dataType, T.StringType) else pa.binary() if isinstance(c.dataType, T.BinaryType) else pa.int64()) for c in T.StructType.fromDDL(WARC_SCHEMA)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns):
                yield from _gathered(warc_records(name.as_py(), content.as_py(), payloads), schema, lambda r: len(r[10] or b"") + len(r[9] or b""))

    return _files(spark, path).mapInArrow(rows, WARC_SCHEMA).withColumn("page_id", _header(F.col("head"), ID_HEADER).cast("long"))


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of read_warc's responses and revisits; a revisit has the length and
    digest of the payload it refers to. A revisit whose response is not among the records has null ones."""
    records = records.where(F.col("warc_type").isin("response", "revisit"))
    records = stored(records.select("record_id", "warc_type", "refers_to", "page_id", "payload_bytes", "payload_digest"), "records")
    whole = records.where("warc_type = 'response'").select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = records.where("warc_type = 'revisit'").select(F.col("refers_to").alias("record_id"), F.col("page_id").alias("own_id"))
    first = again.join(records.where("warc_type = 'response'").drop("refers_to"), "record_id", "left")
    return whole.unionByName(first.select(F.col("own_id").alias("page_id"), "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("page_id").alias("refers_to")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: all pages into ARC archives, those into WARC archives, and those read back."""
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(read(spark, sf_dir, "pages").select("page_id", "url", "html"), arc)
    arc_to_warc(spark, arc, warc)
    return pages_of(read_warc(spark, warc, payloads=False))


SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY page_id) AS i, min(page_id) OVER (PARTITION BY digest) AS first_id FROM p)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest, CASE WHEN bytes >= 100 AND i > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 100 AND i > 1 THEN first_id END AS refers_to
FROM f
"""
