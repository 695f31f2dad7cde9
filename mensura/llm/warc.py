"""WARC records in ZIP packages: writer, directory parser and range reader.

An archive is a ZIP file of stored members: ``archive/data.warc.gz`` holds one
gzip member per record, ``indexes/index.cdxj`` a line per record with its
offset and length.  Tasks write archives side by side in one shared folder.  A
file belongs to the result only if its row is in the manifest table, which
Spark commits with the task, so what a lost or repeated attempt left is never
read.

The reader never extracts a package.  It reads the end of the file, the ZIP64
records where present and the central directory, finds the stored members,
streams the index and turns it into byte ranges; the ranges are dealt out
evenly and each task reads its own ranges and unpacks single records.

Of rows with equal payloads (null counts as empty) of at least
``least_bytes``, the one with the smallest page id is a ``response``, the
others are ``revisit`` records that name it and carry its digest and length but
no payload.  Rows repeating the smallest id are responses too; rows without id
are revisits if their payload has an id, else responses.  Only the id, url and
html columns are read.  An empty table gives no archive and an empty result.

Archives are reached through Arrow's file systems; the folder must be one that
driver and executors share (a mounted path, HDFS or an object store).
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote_to_bytes

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from mensura.llm.common import raw_texts, shared_folder, written

ARCHIVE_BYTES = 256 << 20
RANGE_BYTES, RANGE_RECORDS = 1 << 20, 512
TASK_BYTES = 8 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: fixed values of the WARC 1.1 format
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:x-page:"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of 40 hex digits: five hex digits are four base-32 digits."""
    digits = [F.lpad(F.conv(F.substring(hex_digest, i, 5), 16, 32), 4, "0") for i in range(1, 40, 5)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; with ``refers_to`` a revisit without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_PAGE}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=SAFE_URL)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_PAGE}{refers_to}>"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: left as they are in a header: all printable ASCII but the percent sign
SAFE_URL = "".join(map(chr, range(33, 127))).replace("%", "")


def parse(data: bytes) -> dict:
    """Fields and payload of one record; a response's digest is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a WARC 1.1 record: {lines[0][:40]!r}")
    fields = {k.decode().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    http_fields = {k.lower(): v.strip() for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")[1:])}
    kind, digest = fields["warc-type"].decode(), fields["warc-payload-digest"].decode().removeprefix("sha1:")
    page = lambda name: fields[name][1:-1].decode().removeprefix(_PAGE) if name in fields else ""
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest or len(payload) != int(http_fields[b"content-length"]):
            raise ValueError(f"payload of page {page('warc-record-id')} is damaged")
    url = fields.get("warc-target-uri")
    return {
        "page_id": page("warc-record-id") or None, "url": None if url is None else unquote_to_bytes(url).decode("utf-8", "replace"),
        "record_type": kind, "payload_bytes": int(http_fields[b"content-length"]), "payload_digest": digest,
        "refers_to": page("warc-refers-to") or None, "payload": payload if kind == "response" else None,
    }


class ArchiveWriter:
    """One ZIP package, written in a single forward pass."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, path = filesystem(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.lines: list[bytes] = []
        self.size = 0

    def add(self, data: bytes, url: str | None, digest: str) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        self.data.write(packed)
        entry = {"url": url, "digest": f"sha1:{digest}", "offset": self.size, "length": len(packed), "filename": DATA}
        self.lines.append(f"{quote(url or '-', safe=SAFE_URL)} 19700101000000 {json.dumps(entry)}\n".encode())
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(INDEX, b"".join(self.lines))
        self.zip.close()
        self.stream.close()
        return self.path, len(self.lines), self.size


MANIFEST = "archive string, records bigint, bytes bigint"


def typed(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Page id, url, html with ``digest`` and ``refers_to``."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), base32(F.sha1(html.cast("binary"))).alias("digest"), F.octet_length(html).alias("n"))
    first = rows.groupBy("digest", "n").agg(F.min("page_id").alias("first"))
    points = (F.col("n") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, ["digest", "n"]).select("page_id", "url", "html", "digest", F.when(points, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write all pages as archives below ``folder``; returns the manifest: archive, records, bytes."""

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            data, offsets = raw_texts(batch.column("html"))
            ids, urls, digests, refers = (batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to"))
            for i, (page, url, digest, refer) in enumerate(zip(ids, urls, digests, refers)):
                writer = writer or ArchiveWriter(folder)
                writer.add(record(page, url, data[offsets[i] : offsets[i + 1]], digest, refer), url, digest)
                if writer.size > ARCHIVE_BYTES:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        names, counts, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["archive", "records", "bytes"]
        )

    return written(typed(pages, least_bytes).mapInArrow(archives, MANIFEST), "manifest")


# ---- reading -------------------------------------------------------------


def directory(file, size: int) -> dict[str, tuple[int, int, int, int]]:
    """Members of a ZIP file: name to (method, packed size, size, offset of the local header)."""
    tail_at = max(0, size - 65557)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    at = tail_at + end
    if at >= 20 and (locator := file.read_at(20, at - 20))[:4] == b"PK\x06\x07":
        record64 = file.read_at(56, struct.unpack("<Q", locator[8:16])[0])
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("ZIP64 end record is not where its locator says")
        count, length, start = struct.unpack("<QQQ", record64[32:56])
    data, at, members = file.read_at(length, start), 0, {}
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", data[at + 10 : at + 12])
        packed, plain, n_name, n_extra, n_comment = struct.unpack("<IIHHH", data[at + 20 : at + 34])
        offset, = struct.unpack("<I", data[at + 42 : at + 46])
        name = data[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack("<HH", extra[:4])
            if tag == 1:  # 64-bit values stand for the fields that are all ones, in this order
                wide = [v for v, in struct.iter_unpack("<Q", extra[4 : 4 + n // 8 * 8])]
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + n :]
        members[name] = (method, packed, plain, offset)
        at += 46 + n_name + n_extra + n_comment
    return members


def stored(file, member: tuple[int, int, int, int]) -> tuple[int, int]:
    """Byte range of a stored member."""
    method, packed, _, offset = member
    if method != 0:
        raise ValueError("member is compressed; only stored members can be read by ranges")
    head = file.read_at(30, offset)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header where the directory says")
    n_name, n_extra = struct.unpack("<HH", head[26:30])
    start = offset + 30 + n_name + n_extra
    return start, start + packed


def index_entries(file, size: int, block: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(absolute offset, length) of every record, from the stored index."""
    members = directory(file, size)
    data = {name: stored(file, m) for name, m in members.items() if name.startswith("archive/")}
    start, end = stored(file, members[INDEX])
    rest = b""
    while start < end or rest:
        chunk = file.read_at(min(block, end - start), start) if start < end else b""
        start += len(chunk)
        *lines, rest = (rest + chunk).split(b"\n")
        if start >= end and rest:
            lines, rest = [*lines, rest], b""
        for line in lines:
            if line:
                entry = json.loads(line.split(b" ", 2)[2])
                first, last = data[entry["filename"]]
                if first + entry["offset"] + entry["length"] > last:
                    raise ValueError("index points beyond its member")
                yield first + entry["offset"], entry["length"]


def ranges(manifest: DataFrame) -> DataFrame:
    """Byte ranges of whole records: archive, ``start``, ``lengths``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                system, path = filesystem(archive)
                rows: list[tuple[int, list[int]]] = []
                with system.open_input_file(path) as file:
                    total = 0
                    for at, length in index_entries(file, file.size()):
                        if not rows or total + length > RANGE_BYTES or len(rows[-1][1]) >= RANGE_RECORDS or rows[-1][0] + total != at:
                            rows.append((at, []))
                            total = 0
                        rows[-1][1].append(length)
                        total += length
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([archive] * len(rows)), pa.array([a for a, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.list_(pa.int64()))],
                        names=["archive", "start", "lengths"],
                    )

    return manifest.mapInArrow(scan, "archive string, start bigint, lengths array<bigint>")


_FIELDS = {
    "page_id": pa.string(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
    "refers_to": pa.string(), "payload": pa.binary(),
}


def read(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """Every record of the archives in ``manifest`` by range reads; revisits have no payload."""
    found = written(ranges(manifest), "ranges")
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, -(-total // TASK_BYTES), manifest.sparkSession.sparkContext.defaultParallelism)
    names = [n for n in _FIELDS if payload or n != "payload"]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = filesystem(row["archive"])
                with system.open_input_file(path) as file:
                    data = file.read_at(sum(row["lengths"]), row["start"])
                at, out = 0, []
                for length in row["lengths"]:
                    out.append(parse(zlib.decompress(data[at : at + length], 31)))
                    at += length
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], _FIELDS[n]) for n in names], names=names)

    kinds = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary"}
    schema = ", ".join(f"{n} {kinds[_FIELDS[n]]}" for n in names)
    return found.repartition(parts, "archive", "start").mapInArrow(records, schema)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read all records back, without payloads."""
    folder = shared_folder(pages.sparkSession, "archives")
    kind = pages.schema["page_id"].dataType
    found = read(write(pages, folder, least_bytes), payload=False)
    return found.select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
