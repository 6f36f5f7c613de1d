"""Operator 2: WARC archives, written once per payload and read with salvage.

Writing: every record is one gzip member, made beside the row.  Members are put together
to pieces of some ``PIECE_BYTES``, and Spark's text writer lays the pieces one after the
other into files of ``PIECES_PER_FILE``, on any store it can reach: what bounds a file is its
bytes, not its records.  Of records with equal payloads the one with the largest page_id is
the response; the others are revisits that name it.

Reading: each file is parsed member by member, or record by record where it is plain.  A
member or record that fails a check (magic, CRC, length, version line, block digest) is
not trusted: the reader searches the next place where a valid one of either kind starts,
goes on there, and logs the bytes between as a quarantined gap.  Files are mapped where all
machines mount them, so their size is no bound.  One member is held at a time, and its block is dropped when its row is made.

Defined results: a null html is the empty payload.  Records are told apart by page_id:
rows that repeat the largest page_id of a payload are all responses.  A null page_id
ranks below every other; it reads back as null.  A null url leaves the target header out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import mmap
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import join_splittable
from . import common

VERSION = b"WARC/1.1"
GZIP = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: WARC-Date of records whose rows carry no time of their own.
DATE = "2000-01-01T00:00:00Z"
#: Compressed bytes of a piece (more if one member is longer), and pieces of a file.  From a store
#: that isn't mounted a file is read as one value; with pages of up to 100 MB it stays below 2 GB.
PIECE_BYTES, PIECES_PER_FILE = 1 << 20, 16
END = b"\r\n\r\n"
START = re.compile(rb"WARC/\d\.\d\r?\n")
#: Where a gzip member or a plain record may start.
PLACE = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r?\n")
#: A gzip member of no bytes; its last byte is zero.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: response, or revisit if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    name = "null" if page_id is None else page_id
    head = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{name}>",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + END + block + END


def member_bytes(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte.

    The last four bytes are the length, little-endian, so records below 16 MiB end so by
    themselves; a longer one gets an empty member behind it.
    """
    member = gzip.compress(record, compresslevel=6, mtime=0)
    return member if member[-1] == 0 else member + EMPTY_MEMBER


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Parsed:
    records: list[Record] = field(default_factory=list)
    #: (first byte, byte behind the last, reason) of what was not trusted
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


#: A header line; what isn't one ends the search, so that a place that fails costs no more than its lines.
HEADER = re.compile(rb"([^\r\n:]+):([^\r\n]*)\r\n")


def parse_plain(data: bytes, at: int) -> tuple[Record, int] | str:
    """The record that starts at ``at`` and the place behind it, or what is wrong."""
    version = START.match(data, at)
    if not version:
        return "no version line"
    headers: dict[str, str] = {}
    body = version.end()
    while data[body : body + 2] != b"\r\n":
        line = HEADER.match(data, body)
        if not line:
            return "bad header line"
        headers[line[1].strip().decode("latin-1").lower()] = line[2].strip().decode("utf-8", "replace")
        body = line.end()
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return "no content length"
    begin, end = body + 2, body + 2 + int(length)
    if data[end : end + 4] != END:
        return "block of another length"
    block = data[begin:end]
    claimed = headers.get("warc-block-digest", "")
    if claimed.startswith("sha1:") and claimed[5:] != base32_sha1(block):
        return "block digest differs"
    return Record(at, headers, block), end + 4


def salvage_plain(data: bytes, offset: int = 0) -> Parsed:
    """Records of uncompressed WARC bytes; ``offset`` is added to all places."""
    out, at = Parsed(), 0
    while at < len(data):
        found = parse_plain(data, at)
        if isinstance(found, str):
            begin, reason = at, found
            while isinstance(found, str):
                following = START.search(data, at + 1)
                at = following.start() if following else len(data)
                if not following:
                    break
                found = parse_plain(data, at)
            out.gaps.append((offset + begin, offset + at, reason))
            if isinstance(found, str):
                break
        record, at = found
        record.offset += offset
        out.records.append(record)
    return out


def inflate(data: bytes, at: int) -> tuple[bytes, int] | str:
    """The member that starts at ``at`` and the place behind it, or what is wrong."""
    if data[at : at + 3] != GZIP:
        return "no member"
    work = zlib.decompressobj(31)
    parts, view, i = [], memoryview(data), at
    try:
        while not work.eof:
            if i >= len(data):
                return "truncated member"
            parts.append(work.decompress(view[i : i + 65536]))
            i += 65536
    except zlib.error:
        return "corrupt member"
    return b"".join(parts), min(i, len(data)) - len(work.unused_data)


def unit(data: bytes, at: int, searched: bool) -> tuple[list[Record], list[tuple[int, int, str]], int] | str:
    """Records and gaps of the member or plain record at ``at`` and the place behind it, or what is wrong.

    A place that a search found may be a gzip payload, so its member must hold a version line or nothing.
    """
    if data[at : at + 3] != GZIP:
        found = parse_plain(data, at)
        return found if isinstance(found, str) else ([found[0]], [], found[1])
    found = inflate(data, at)
    if isinstance(found, str):
        return found
    plain, end = found
    if searched and plain and not START.search(plain):
        return "member without version line"
    inner = salvage_plain(plain)
    for record in inner.records:
        record.offset = at  # of the member
    return inner.records, [(at, end, f"in a member: {reason}") for _, _, reason in inner.gaps], end


def units(data: bytes) -> Iterator[Record | tuple[int, int, str]]:
    """Records and gaps of an archive of gzip members, plain records or both, as they are found."""
    at = 0
    while at < len(data):
        found = unit(data, at, False)
        if isinstance(found, str):
            begin, reason = at, found
            for place in PLACE.finditer(data, at + 1):
                at = place.start()
                found = unit(data, at, True)
                if not isinstance(found, str):
                    break
            else:
                at = len(data)
            yield begin, at, reason
            if isinstance(found, str):
                return
        records, gaps, at = found
        yield from gaps
        yield from records


def salvage(data: bytes) -> Parsed:
    """All records and gaps of an archive."""
    out = Parsed()
    for found in units(data):
        (out.records if isinstance(found, Record) else out.gaps).append(found)
    return out


def page_of(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn)
    return int(found[1]) if found else None


def member_batches(batches: Iterator[pa.RecordBatch], piece_bytes: int) -> Iterator[pa.RecordBatch]:
    """Pieces of whole members, each without its last byte, a zero."""
    held: list[bytes] = []
    size = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["piece"])

    for batch in common.slices(batches, "html", 4 << 20):
        for page_id, url, html, ref in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "ref")), strict=True):
            payload = html.as_buffer().to_pybytes() if html.is_valid else b""
            member = member_bytes(record_bytes(page_id.as_py(), url.as_py(), payload, base32_sha1(payload), ref.as_py()))
            if held and size + len(member) > piece_bytes:
                yield flush()
                held, size = [], 0
            held.append(member)
            size += len(member)
    if held:
        yield flush()


def with_reference(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and ``ref``: the page to revisit, null for responses.

    The largest id per payload digest is aggregated on the map side; hot digests are split
    when it is joined back.
    """
    pages = pages.select("page_id", "url", "html").withColumn("digest", F.sha1(F.coalesce("html", F.lit(""))))
    last = pages.groupBy("digest").agg(F.max("page_id").alias("last_id"), F.count("*").alias("copies")).where("copies > 1").select("digest", "last_id")
    shared = (F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    return join_splittable(pages, last, ["digest"], "left").select("page_id", "url", "html", F.when(shared, F.col("last_id")).alias("ref"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, piece_bytes: int = PIECE_BYTES, pieces_per_file: int = PIECES_PER_FILE) -> None:
    """The archives of ``pages`` (page_id, url, html) as files below ``path``.

    The text writer puts raw bytes and then the separator; pieces lack their last byte,
    which is zero, and the separator is that byte.
    """
    common.bound_batches(pages.sparkSession)
    pieces = with_reference(pages, least_bytes).mapInArrow(common.tidy(lambda b: member_batches(b, piece_bytes)), "piece binary")
    pieces.select(F.col("piece").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", pieces_per_file).text(path)


RECORD_TYPES = "file string, offset long, gap_end long, gap string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def parse_batches(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD_TYPES.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in RECORD_TYPES.split(", ")]

    def flush(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)

    for batch in batches:
        contents = batch.column("content") if "content" in batch.schema.names else None
        for k, path in enumerate(batch.column("path").to_pylist()):
            made: list[tuple] = []
            size = 0
            for found in units(mapped(path) if contents is None else contents[k].as_buffer().to_pybytes()):
                made.append(row_of(path, found, payloads))
                size += len(made[-1][-1] or b"")
                if len(made) >= 500 or size > 4 << 20:
                    yield flush(made)
                    made, size = [], 0
            if made:
                yield flush(made)


def mapped(path: str) -> bytes | mmap.mmap:
    """The bytes of a file that this machine's file system has, of any size, without reading them in."""
    with open(unquote(urlparse(path).path), "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.fstat(f.fileno()).st_size else b""


def row_of(path: str, found: Record | tuple[int, int, str], payloads: bool) -> tuple:
    """A record or gap as a row of RECORD_TYPES."""
    if not isinstance(found, Record):
        return path, *found, *[None] * 7
    headers, (http, _, payload) = found.headers, found.block.partition(END)
    kind = headers.get("warc-type")
    full = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    response = kind == "response"
    digest = base32_sha1(payload) if response else headers.get("warc-payload-digest", "").removeprefix("sha1:")
    size = len(payload) if response else int(full[1]) if full else None
    return path, found.offset, None, None, page_of(headers.get("warc-record-id", "")), headers.get("warc-target-uri"), size, digest, kind, page_of(headers.get("warc-refers-to", "")), payload if payloads and response else None


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records and gaps (rows with ``gap`` set) of all archives below ``path``.

    Archives in a folder that all machines mount are mapped, whatever their size; of other
    stores Spark hands a task the file as one value, which ends at 2 GB.
    """
    common.bound_batches(spark)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    mounted = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file"
    files = spark.read.format("binaryFile").load(path).select("path", *([] if mounted else ["content"]))
    return files.mapInArrow(common.tidy(lambda b: parse_batches(b, payloads)), RECORD_TYPES)


def records(found: DataFrame) -> DataFrame:
    return found.where("gap is null").drop("gap", "gap_end")


def quarantine(found: DataFrame) -> DataFrame:
    """The log of byte ranges that were not trusted."""
    return found.where("gap is not null").select("file", F.col("offset").alias("first_byte"), F.col("gap_end").alias("end_byte"), F.col("gap").alias("reason"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_dir(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), path)
    return records(read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 of a SHA-1: 40 hexadecimal digits are 8 groups of 20 bits, each 4 characters.
OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS last_id FROM p
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER) >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last_id THEN last_id END AS refers_to
FROM g
"""
