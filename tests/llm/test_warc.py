import base64
import hashlib
import io
import struct
import zipfile

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from mensura.llm import warc
from mensura.llm.queries import QUERIES


def by_hand(pages, least=0):
    first, out = {}, []
    for page, _, html in pages:
        body = (html or "").encode()
        if page is not None and len(body) >= least:
            first[body] = min(page, first.get(body, page))
    for page, _, html in pages:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        refers = first.get(body)
        revisit = refers is not None and refers != page
        out.append((page, len(body), digest, "revisit" if revisit else "response", refers if revisit else None))
    return sorted(out, key=str)


PAGES = [
    (5, "http://a/x?q=1%20\r\nEvil: 1", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "http://ü/", None), (8, "u", ""), (1, "u", "x" * 300_000),
    (2, "u", "HTTP/1.1 \r\n\r\nWARC/1.1\r\n\r\n"), (3, None, "<p>é</p>"), (None, "u", "<p>é</p>"), (None, "u", "alone"), (7, "u", "\x00\r\n"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("n", F.lit(1))
    got = [tuple(r) for r in warc.archived(pages, least).collect()]
    assert sorted(got, key=str) == by_hand(PAGES, least)


def test_payloads_and_urls_come_back(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = warc.read(warc.write(pages.coalesce(1), str(tmp_path / "new" / "folder"))).collect()
    want = {str(p): (u, (h or "").encode()) for p, u, h in PAGES if p is not None}
    for r in rows:
        if r.page_id:
            assert r.url == want[r.page_id][0]
            assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == want[r.page_id][1]


def test_ranges_follow_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_RECORDS", 2)
    writer = warc.ArchiveWriter(str(tmp_path))
    for i in range(7):
        writer.add(warc.record(i, "u", b"p" * i, "D", None), "u", "D")
    path, n, size = writer.close()
    with fs.LocalFileSystem().open_input_file(path) as file:
        entries = list(warc.index_entries(file, file.size(), block=50))
    assert n == 7 and sum(length for _, length in entries) == size
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.namelist() == [warc.DATA, warc.INDEX]


def opened(data):
    import pyarrow as pa

    return pa.BufferReader(data), len(data)


def test_zip64_directory():
    """A hand-made package whose sizes, offsets and counts stand in ZIP64 fields only."""
    name, body = b"archive/a", b"hello"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name
    local += struct.pack("<HHQQ", 1, 16, 5, 5)
    extra = struct.pack("<HHH", 0x9999, 2, 7) + struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    central = struct.pack(
        "<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF
    ) + name + extra
    at = len(local) + len(body)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 7) + b"comment"
    file, size = opened(local + body + central + end64 + locator + end)
    members = warc.directory(file, size)
    assert members == {"archive/a": (0, 5, 5, 0)}
    a, b = warc.stored(file, members["archive/a"])
    assert file.read_at(b - a, a) == b"hello"


def test_damage_is_reported():
    with pytest.raises(ValueError, match="no end"):
        warc.directory(*opened(b"not a zip"))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a", "x" * 100)
    file, size = opened(packed.getvalue())
    with pytest.raises(ValueError, match="stored"):
        warc.stored(file, warc.directory(file, size)["archive/a"])
    digest = base64.b32encode(hashlib.sha1(b"abc").digest()).decode()
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(warc.record(1, "u", b"abd", digest, None))


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(none).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    assert sorted([tuple(r) for r in QUERIES["op3_warc"](spark, folder).collect()], key=str) == by_hand(pages)
