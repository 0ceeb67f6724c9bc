"""WARC archives: one gzip member for each record, written by tasks and read back record by record.

Archives lie in a folder that all executors share, given as a URI; Arrow's file systems open it (local, HDFS, S3 ...).
A page whose payload another page has already is a ``revisit`` record: headers only.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.session import shared_dir

#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 100
#: An archive is closed when it has so many bytes.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 20
#: All records bear this date: pages have none.
DATE = "2000-01-01T00:00:00Z"

#: Names that the format fixes.
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        """Headers and body of the HTTP message in the block."""
        head, _, body = self.block.partition(b"\r\n\r\n")
        return parse_headers(head.split(b"\r\n")[1:]), body


def parse_headers(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.decode().partition(":") for x in lines if x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def member(headers: dict[str, str], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers.items()), f"Content-Length: {len(block)}".encode()]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + b"\r\n\r\n") + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _page_uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(uri: str) -> int | None:
    name = uri.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None) -> bytes:
    """The response record of a page, or the revisit record if another page is its ``original``."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url or "") or _page_uri(page_id)[1:-1]
    revisit = original is not None
    headers = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _page_uri(page_id), "WARC-Date": DATE, "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha256:{digest}"}
    if revisit:
        headers |= {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": _page_uri(original)}
    message = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return member(headers | {"Content-Type": "application/http; msgtype=response"}, message if revisit else message + payload)


def members(stream, size: int = READ_BYTES) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one after another; a member that is cut off is an error."""
    left, unpacker, parts = b"", None, []
    while True:
        data = left or stream.read(size)
        left = b""
        if not data:
            if unpacker is not None:
                raise ValueError("the archive ends within a record")
            return
        unpacker = unpacker or zlib.decompressobj(31)
        parts.append(unpacker.decompress(data))
        if unpacker.eof:
            yield b"".join(parts)
            left, unpacker, parts = unpacker.unused_data, None, []


def records(stream) -> Iterator[Record]:
    """The records of an archive, framed by Content-Length, payloads checked against their digests."""
    for raw in members(stream):
        head, found, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.split(b"\r\n")
        headers = parse_headers(lines)
        length = int(headers.get("content-length", -1))
        if not found or not first.startswith(b"WARC/") or length < 0 or rest[length:] != b"\r\n\r\n":
            raise ValueError("not a WARC record, or not of the length it says")
        out = Record(headers, rest[:length])
        if headers["warc-type"] == "response":
            digest = f"sha256:{hashlib.sha256(out.http[1]).hexdigest()}"
            if digest != headers["warc-payload-digest"]:
                raise ValueError(f"the payload of {headers['warc-record-id']} doesn't have the digest it says")
        yield out


def _opened(folder: str):
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace("file:/", "file:///", 1))


def _written(folder: str, most: int):
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every attempt of a task writes files of its own; only those of the attempt that counts are named in the result."""
        files, base = _opened(folder)
        name, out, n = None, None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, digest, original = (batch.column(c)[i].as_py() for c in ("page_id", "url", "html", "digest", "original"))
                if out is None:
                    name, n = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(name, compression=None)
                out.write(record(page_id, url, (html or "").encode(), digest, original))
                n += 1
                if out.tell() >= most:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["archive", "records"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["archive", "records"])

    return written


def write_archives(spark: SparkSession, pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every page and returns the list of archives (archive, records), itself written beside them.

    pages: page_id, url, html; other columns are ignored. A null html is an empty payload, a null url is replaced by the
    page's own URI. Of equal payloads of at least ``least_bytes``, the page with the smallest page_id is the original;
    repeated rows of that page are all written whole. Without any page_id, all are written whole.
    """
    folder = folder or shared_dir(spark, "warc")
    files, base = _opened(folder)
    files.create_dir(base, recursive=True)
    html = F.coalesce(F.col("html"), F.lit(""))
    df = pages.select("page_id", "url", "html", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes"))
    large = pages.select("page_id", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes")).where(F.col("bytes") >= least_bytes)
    # pre-aggregated before the shuffle; only payloads that occur twice are looked up
    again = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    df = df.join(again, "digest", "left").withColumn("original", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    listed = f"{folder.rstrip('/')}/archives"
    df.select("page_id", "url", "html", "digest", "original").mapInArrow(_written(folder, archive_bytes), "archive string, records long").write.parquet(listed)
    return spark.read.parquet(listed)


def _read(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _opened(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows, held = [], 0
                with files.open_input_stream(archive, compression=None) as stream:
                    for r in records(stream):
                        http, body = r.http
                        to = r.headers.get("warc-refers-to")
                        kind, whole = r.headers["warc-type"], r.headers["warc-type"] == "response"
                        rows.append((_page_of(r.headers["warc-record-id"]), r.headers["warc-target-uri"], int(http["content-length"]), r.headers["warc-payload-digest"].partition(":")[2], kind, to and _page_of(to), body if whole else None))
                        held += len(r.block) + 200
                        if held >= READ_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return read


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A row for each record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    payload is null in revisits; their payload_bytes and digest are those of the original. Each archive is read by one
    task, from front to back, and has a task of its own.
    """
    dealt = archives.select("archive").repartitionByRange(max(1, archives.count()), "archive")
    return dealt.mapInArrow(_read(folder), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Pages written to archives in the shared folder and read back."""
    folder = shared_dir(spark, "warc")
    return read_archives(write_archives(spark, pages, folder, least_bytes), folder)
