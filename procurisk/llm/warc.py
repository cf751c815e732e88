"""WARC archives: a writer with revisit records, and a reader that goes on behind damaged bytes.

The writer packs gzip members (one per record) into archives of bounded size and hands them to Spark's file writer, one
archive per file; so it reaches every file system that Spark reaches, and a lost task leaves no half file. The line
separator of that writer is an empty gzip member, hence each file is a plain sequence of members.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procurisk.llm import shared

#: An archive is closed when it holds so many bytes; the reader takes one archive at a time.
ARCHIVE_BYTES = 8 << 20
#: Equal payloads of at least so many bytes are written once; the others revisit it.
REVISIT_BYTES = 0
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
FIELDS = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string"
RECORD = f"archive string, first_byte long, n_bytes long, quarantined string, {FIELDS}, payload_bytes long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Date: {DATE}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    lines.append(f"WARC-Block-Digest: sha1:{base32_sha1(block)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(data: bytes, start: int) -> tuple[dict, int] | str:
    """The record at ``start`` of plain bytes and where it ends, or what is wrong with it."""
    version = VERSION.match(data, start)
    if not version:
        return "no version line"
    end = data.find(b"\r\n\r\n", start)
    if end < 0:
        return "headers not ended"
    headers = {}
    for line in data[version.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header"
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit() or "warc-type" not in headers:
        return "bad header"
    begin, length = end + 4, int(headers["content-length"])
    block = data[begin : begin + length]
    if data[begin + length : begin + length + 4] != b"\r\n\r\n":
        return "length does not fit"
    head, split, payload = block.partition(b"\r\n\r\n")
    known = re.search(rb"\r\ncontent-length:\s*(\d+)", head, re.IGNORECASE)
    if headers.get("warc-block-digest", "sha1:" + base32_sha1(block)) != "sha1:" + base32_sha1(block):
        return "block digest does not fit"
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if headers["warc-type"] == "response" and split and digest not in (None, base32_sha1(payload)):
        return "payload digest does not fit"
    found = {
        "record_type": headers["warc-type"],
        "record_id": headers.get("warc-record-id"),
        "target_uri": headers.get("warc-target-uri"),
        "payload_digest": digest,
        "refers_to": headers.get("warc-refers-to"),
        "payload_bytes": int(known[1]) if known else len(payload),
        "payload": payload,
    }
    return found, begin + length + 4


def inflate(data: bytes, start: int) -> tuple[bytes, int, str | None]:
    """What the gzip member at ``start`` holds up to its end or its fault, where that is, and what is wrong with it."""
    rest = memoryview(data)[start:]
    opener = zlib.decompressobj(31)
    try:
        plain = opener.decompress(rest)
    except zlib.error as error:
        return *inflated_until_fault(rest, start), str(error)
    return plain, len(data) - len(opener.unused_data), None if opener.eof else "member not ended"


def inflated_until_fault(rest: memoryview, start: int) -> tuple[bytes, int]:
    """The bytes of a faulty member that come out before its fault, and where that is: by pieces, the last one byte by byte."""
    opener, found, at, step = zlib.decompressobj(31), [], 0, 1 << 14
    while at < len(rest):
        before = opener.copy()
        try:
            found.append(opener.decompress(rest[at : at + step]))
        except zlib.error:
            if step == 1:
                break
            opener, step = before, 1
            continue
        at += step
    return b"".join(found), start + at


def records_of(plain: bytes) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """The valid records of inflated bytes, and the gaps between them: first byte, end and fault."""
    good: list[dict] = []
    gaps: list[tuple[int, int, str]] = []
    inner, bad_from, fault = 0, None, ""
    while inner < len(plain):
        got = parse(plain, inner)
        if not isinstance(got, str):
            if bad_from is not None:
                gaps.append((bad_from, inner, fault))
                bad_from = None
            good.append(got[0])
            inner = got[1]
            continue
        if bad_from is None:
            bad_from, fault = inner, got
        version = VERSION.search(plain, inner + 1)
        inner = version.start() if version else len(plain)
    if bad_from is not None:
        gaps.append((bad_from, len(plain), fault))
    return good, gaps


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict]]:
    """First byte, length, fault and record of all parts of an archive, in order.

    After a failed check the search goes on for the next gzip member or version line that holds a whole valid record; the
    bytes up to there are one quarantined part. So the parts cover the archive without gaps or overlaps, but for the parts of one
    gzip member, which all have its place: its valid records, and its gaps, whose faults name the inflated bytes. A damaged member
    gives the valid records before its fault; its place ends there.
    """
    at, bad_from, fault = 0, None, ""
    while at < len(data):
        good: list[dict] = []
        gaps: list[tuple[int, int, str]] = []
        wrong = None
        if data.startswith(GZIP, at):
            plain, end, wrong = inflate(data, at)
            good, gaps = records_of(plain)
            if not good and gaps:
                wrong = wrong or gaps[0][2]
        else:
            got = parse(data, at)
            if isinstance(got, str):
                wrong = got
            else:
                good, end = [got[0]], got[1]
        if wrong is None or good:
            if bad_from is not None:
                yield bad_from, at - bad_from, fault, {}
                bad_from = None
            for found in good:
                yield at, end - at, None, found
            for first, last, reason in gaps:
                yield at, end - at, f"{reason} (inflated bytes {first} to {last})", {}
            at = end
            if wrong is None:
                continue
            bad_from, fault, start = at, wrong, at
        else:
            start = at + 1
        if bad_from is None:
            bad_from, fault = at, wrong
        version = VERSION.search(data, start)
        places = [x for x in (data.find(GZIP, start), version.start() if version else -1) if x >= 0]
        at = min(places, default=len(data))
    if bad_from is not None and bad_from < len(data):
        yield bad_from, len(data) - bad_from, fault, {}


def write_archives(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """Write a record per row (page_id, url, html) to gzipped archives under ``path``.

    Of equal payloads of at least ``least`` bytes, the row with the largest page_id is the response, the others revisit it.
    Null html is an empty payload, a null url gives no target. A row without page_id has no record id and is never revisited;
    rows that repeat the largest page_id are responses all. Equality is that of length and SHA-1, as usual in archives. The
    repeated digests are counted with partial sums and joined back on the digest, which adaptive execution can split.
    """
    rows = pages.select(
        F.col("page_id").cast("string").alias("id"),
        F.col("page_id").alias("number"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.concat(F.sha1(F.encode("html", "utf-8")), F.lit("-"), F.octet_length("html")))
    repeated = (
        rows.where(F.octet_length("html") >= least)
        .groupBy("digest")
        .agg(F.max("number").alias("response"), F.count("*").alias("n"))
        .where("n > 1 AND response IS NOT NULL")
        .select("digest", "response")
    )
    marked = rows.join(repeated, "digest", "left").select(
        "id",
        "url",
        "html",
        F.when(~F.col("number").eqNullSafe(F.col("response")), F.col("response").cast("string")).alias("refers_to"),
    )

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        size = 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], type=pa.binary())], names=["archive"])

        for batch in stream:
            for row in zip(*(batch.column(name) for name in ("id", "url", "html", "refers_to"))):
                page_id, url, html, refers_to = (x.as_py() for x in row)
                members.append(member(record(page_id, url, html.encode(), refers_to)))
                size += len(members[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    members.clear()
                    size = 0
        if members:
            yield archive()

    (
        marked.mapInArrow(run, "archive binary")
        .select(F.col("archive").cast("string"))
        .write.option("maxRecordsPerFile", 1)
        .option("encoding", "ISO-8859-1")
        .option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .text(path)
    )


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All parts of the archives under ``path``: records, and quarantined byte gaps with the reason (``RECORD``).

    Reads gzipped members and plain records alike. An archive without bytes has no parts; a folder without archives gives no
    rows. A task holds one archive at a time. Without ``payloads`` that column is null and is not sent.
    """
    fields = [part.split()[0] for part in f"{FIELDS}, payload_bytes long, payload binary".split(", ")]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for name, content in zip(batch.column("path"), batch.column("content")):
                parts = [
                    {"archive": name.as_py(), "first_byte": a, "n_bytes": n, "quarantined": fault}
                    | {field: found.get(field) for field in fields}
                    | ({} if payloads else {"payload": None})
                    for a, n, fault, found in salvage(content.as_py())
                ]
                if parts:
                    yield pa.RecordBatch.from_pylist(parts, schema=kinds)

    longs, binaries = ("first_byte", "n_bytes", "payload_bytes"), ("payload",)
    kinds = pa.schema(
        (name, pa.int64() if name in longs else pa.binary() if name in binaries else pa.string())
        for name in ("archive", "first_byte", "n_bytes", "quarantined", *fields)
    )
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, RECORD)


def through_archives(pages: DataFrame) -> DataFrame:
    """The records of all pages as an archive in the shared folder gives them back; an error if a part of it is damaged."""
    path = shared.new_folder(pages.sparkSession, "warc")
    write_archives(pages, path)
    intact = F.expr("IF(quarantined IS NULL, true, raise_error(concat('damaged: ', archive, ' at ', first_byte, ': ', quarantined)))")
    return read_archives(pages.sparkSession, path, payloads=False).where(intact)
