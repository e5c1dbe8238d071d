"""WARC records in ZIP packages, and a reader that fetches records by range.

A package holds one stored member of gzip-compressed WARC records and one stored index of
their offsets. The reader parses the end record (ZIP64 where needed) and the central directory,
finds both members' data, reads the index, and then only the byte ranges of the records asked
for; members are never extracted.

Payloads of at least ``SMALLEST_SHARED`` bytes are kept once: the record with the smallest
page_id is the response, equal ones are revisits that name it.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut_lineage, scratch_path
from .common import file_system, spread_files, whole

SMALLEST_SHARED = 100
# A package is closed and a new one begun at this size.
PACKAGE_BYTES = 256 << 20
# Neighbouring records are fetched together up to this size.
FETCH_BYTES = 4 << 20
DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.jsonl"
# Fixed values of the WARC and ZIP formats.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END, _END64, _LOCATOR64 = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_CENTRAL, _LOCAL = b"PK\x01\x02", b"PK\x03\x04"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF

_MANIFEST = "path string, n_records bigint, n_bytes bigint"
_RECORDS = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"


def with_roles(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and the page that a revisit refers to.

    Null html is an empty payload; a null page_id never is the smallest. Only digests and ids are
    aggregated; a payload that a third of all pages share is split by the skew join.
    """
    digest = F.sha2(whole("html").cast("binary"), 256)
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url"), whole("html").cast("binary").alias("payload"), digest.alias("digest")
    )
    large = F.octet_length("payload") >= SMALLEST_SHARED
    first = (
        pages.select(F.col("page_id").cast("long"), digest.alias("digest"))
        .where(F.octet_length(whole("html")) >= SMALLEST_SHARED)
        .groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1).select(F.col("digest").alias("shared"), "first")
    )
    # Small payloads have keys of their own, so that they are dealt out evenly.
    key: Column = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, key == F.col("shared"), "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to")
    )


def _record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    safe = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Package:
    def __init__(self, folder: str):
        files, at = file_system(folder)
        files.create_dir(at, recursive=True)
        name = uuid.uuid4().hex + ".wacz"
        self.path = f"{folder}/{name}"
        self.out = files.open_output_stream(f"{at}/{name}")
        self.zip = zipfile.ZipFile(_Counted(self.out), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA_MEMBER), "w", force_zip64=True)
        self.index, self.size = [], 0

    def add(self, page_id, url, payload: bytes, digest: str, refers_to) -> None:
        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
        coded = gz.compress(_record(page_id, url, payload, digest, refers_to)) + gz.flush()
        self.data.write(coded)
        self.index.append(json.dumps({"page_id": page_id, "url": url, "offset": self.size, "length": len(coded)}))
        self.size += len(coded)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX_MEMBER), "w", force_zip64=True) as f:
            for line in self.index:
                f.write(line.encode("utf-8", "surrogatepass") + b"\n")
        self.zip.close()
        self.out.close()
        return self.path, len(self.index), self.size


class _Counted(io.RawIOBase):
    """An output stream without seek."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)


def write(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write one or more packages per partition; returns their manifest (path, n_records, n_bytes).

    Each task streams its rows into its own packages. A lost attempt's files are in no manifest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                package = package or _Package(folder)
                package.add(*row)
                if package.size >= package_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "n_records", "n_bytes"])

    columns = records.select("page_id", "url", "payload", "digest", "refers_to")
    return cut_lineage(columns.mapInArrow(run, _MANIFEST))


class ZipDirectory:
    """Where the stored members of a ZIP file begin, read from its end and its central directory."""

    def __init__(self, source, size: int):
        self.source = source
        tail_size = min(size, 22 + 0xFFFF + 20 + 56)
        tail = self.range(size - tail_size, tail_size)
        end = tail.rfind(_END)
        if end < 0:
            raise ValueError("no end of central directory")
        n, length, offset = struct.unpack_from("<10xHII", tail, end)
        if n == _FULL16 or length == _FULL32 or offset == _FULL32:
            at = tail.rfind(_LOCATOR64, 0, end)
            if at >= 0:
                (end64,) = struct.unpack_from("<8xQ", tail, at)
                head = self.range(end64, 56)
                if head[:4] != _END64:
                    raise ValueError("no ZIP64 end of central directory")
                n, length, offset = struct.unpack_from("<32xQQQ", head)
        self.members = dict(self._entries(self.range(offset, length), n))

    def range(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        data = self.source.read(length)
        if len(data) != length:
            raise ValueError("the file is shorter than its directory says")
        return data

    def _entries(self, directory: bytes, n: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        """Name, and method, size and local header of each member."""
        at = 0
        for _ in range(n):
            if directory[at : at + 4] != _CENTRAL:
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<8xHH", directory, at)
            packed, size, n_name, n_extra, n_comment, local = struct.unpack_from("<20xIIHHH8xI", directory, at)
            name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, length = struct.unpack_from("<HH", extra)
                if kind == 1:  # ZIP64: only the fields that are full above, in this order
                    values = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                    size = next(values) if size == _FULL32 else size
                    packed = next(values) if packed == _FULL32 else packed
                    local = next(values) if local == _FULL32 else local
                extra = extra[4 + length :]
            yield name, (method, packed, local)
            at += 46 + n_name + n_extra + n_comment

    def stored(self, name: str) -> tuple[int, int]:
        """First byte and length of a stored member's data."""
        method, size, local = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed")
        head = self.range(local, 30)
        if head[:4] != _LOCAL:
            raise ValueError(f"{name} has no local header")
        n_name, n_extra = struct.unpack_from("<26xHH", head)
        return local + 30 + n_name + n_extra, size


def _parsed(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def _page(urn: str | None) -> int | None:
    found = urn[len("<urn:page:") : -1] if urn else "None"
    return None if found == "None" else int(found)


def package_records(path: str) -> Iterator[list]:
    """All records of a package, each as the values of ``read``, fetched by byte range."""
    files, at = file_system(path)
    with files.open_input_file(at) as source:
        package = ZipDirectory(source, source.size())
        first, length = package.stored(INDEX_MEMBER)
        entries = [json.loads(x) for x in package.range(first, length).splitlines()]
        data, _ = package.stored(DATA_MEMBER)
        k = 0
        while k < len(entries):
            low, high, m = entries[k]["offset"], 0, k
            while m < len(entries) and (m == k or entries[m]["offset"] + entries[m]["length"] - low <= FETCH_BYTES):
                high = entries[m]["offset"] + entries[m]["length"]
                m += 1
            fetched = memoryview(package.range(data + low, high - low))
            for entry in entries[k:m]:
                at = entry["offset"] - low
                fields, http, payload = _parsed(zlib.decompress(fetched[at : at + entry["length"]], 31))
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{path}: the payload of page {entry['page_id']} has another digest")
                yield [
                    _page(fields["WARC-Record-ID"]), entry["url"], kind, digest, int(http["Content-Length"]),
                    _page(fields.get("WARC-Refers-To")), payload if kind == "response" else None,
                ]
            k = m


def read(manifest: DataFrame, batch_bytes: int = FETCH_BYTES) -> DataFrame:
    """Every record of the packages: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload.

    A revisit has no payload of its own; its digest and length are those of the full payload.
    """
    names = [f.split()[0] for f in _RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def flushed(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in package_records(path):
                    rows.append(row)
                    held += len(row[-1] or b"") + 200
                    if held >= batch_bytes:
                        yield flushed(rows)
                        rows, held = [], 0
                if rows:
                    yield flushed(rows)

    return spread_files(manifest.select("path")).mapInArrow(run, _RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write a record per page, read the packages back; one row per page."""
    folder = scratch_path(pages.sparkSession, "warc")
    found = read(write(with_roles(pages), folder))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Revisits by SQL, on the table itself.
ROUND_TRIP_SQL = f"""
WITH rows AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first FROM rows WHERE payload_bytes >= {SMALLEST_SHARED} GROUP BY payload_digest
)
SELECT r.page_id, CAST(r.payload_bytes AS BIGINT) AS payload_bytes, r.payload_digest,
  CASE WHEN f.first IS NULL OR r.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first IS NULL OR r.page_id = f.first THEN NULL ELSE f.first END AS refers_to
FROM rows r LEFT JOIN firsts f ON r.payload_digest = f.payload_digest AND r.payload_bytes >= {SMALLEST_SHARED}
"""
