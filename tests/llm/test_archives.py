"""Packages written and read back: round trips, ZIP64 and damaged directories, ranges, and equal payloads."""

import gzip
import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from verdata.llm import archives as A

LONG = "<p>" + "x" * 200
PAGES = [(5, "http://a/1", LONG), (3, "http://a/2 b\r\nc", LONG), (9, None, LONG), (3, "http://a/3", LONG), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (None, "u", LONG), (None, "u", "é" * 60),
         (7, "u", "é" * 60), (8, "http://big/", "y" * 300_000), (10, "u", "WARC/1.1\r\n\r\nPK\x05\x06 \x00 text"), (11, "u", "z" * 100), (12, "u", "z" * 100), (13, "u", "z" * 99), (14, "u", "z" * 99)]


def plain(raw):
    out, first = [], {}
    data = [(who, (html or "").encode()) for who, _, html in raw]
    for who, b in data:
        if who is not None:
            first[b] = min(first.get(b, who), who)
    for who, b in data:
        again = len(b) >= 100 and first.get(b) is not None and first[b] != who
        out.append((who, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def memory(data: bytes):
    return lambda at, n: data[at:at + n]


@pytest.mark.parametrize("package_bytes", [256 << 20, 700])
def test_round_trip(spark, package_bytes):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").select("*", F.lit("c").alias("payload"), F.lit("d").alias("digest"), F.lit(1).alias("id"), F.lit(2).alias("a.b")).repartition(2)
    got = A.round_trip(df, package_bytes=package_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == plain(PAGES)
    assert A.round_trip(df.limit(0)).count() == 0


def test_records_come_by_their_ranges(spark):
    """Lookup by URL reads the record asked for; packages without an index give the same records."""
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    packages = A.write_archives(df, package_bytes=2000)
    assert packages.count() > 1 and packages.agg(F.sum("n_records")).first()[0] == len(PAGES)
    located = A.locate_records(packages)
    big = A.read_records(located.where("url = 'http://big/'")).collect()
    assert [(r["record_id"], r["payload_bytes"], bytes(r["payload"])[:3]) for r in big] == [("8", 300_000, b"yyy")]
    assert {r["url"] for r in located.where("url like 'http://a%'").collect()} == {"http://a/1", "http://a/2%20b%0D%0Ac", "http://a/3"}


def records(n):
    for i in range(n):
        body = f"page {i} ".encode() * (i % 50)
        yield f"http://h/{i}", "response", hashlib.sha256(body).hexdigest(), A.make_record(str(i), f"http://h/{i}", body, hashlib.sha256(body).hexdigest(), None, "2020-01-01T00:00:00Z")


@pytest.mark.parametrize("index", [True, False])
@pytest.mark.parametrize("front", [b"", b"#!/bin/sh\n" * 30])
@pytest.mark.parametrize("large", [False, True])
def test_directories(monkeypatch, index, front, large):
    """Plain and ZIP64 directories, comments, bytes in front of the package, other members, and no index."""
    import zlib

    if large:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    A.write_package(out, records(300), index=index)
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("notes.txt", "packed " * 100, zipfile.ZIP_DEFLATED)
        z.writestr("pages/ü.txt", b"x" * 300)
        z.comment = b"a comment"
    data = front + out.getvalue()
    assert (b"PK\x06\x06" in data) == large
    found = list(A.members(memory(data), len(data), step=64))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert [(m.name, m.size) for m in found] == [(i.filename, i.compress_size) for i in z.infolist()]
        for m in found:
            if m.method == 0:
                at = A.start_of(memory(data), m)
                assert data[at:at + m.size] == z.read(m.name)
    got = list(A.locate(memory(data), len(data)))
    assert len(got) == 300
    for i, (start, length, *_) in enumerate(got):
        r = A.parse_record(zlib.decompress(data[start:start + length], 31))
        assert r["record_id"] == str(i) and r["payload"] == f"page {i} ".encode() * (i % 50) and r["payload_digest"] == hashlib.sha256(r["payload"]).hexdigest()
    with pytest.raises(ValueError):
        A.start_of(memory(data), next(m for m in found if m.name == "notes.txt"))


def test_damaged():
    out = io.BytesIO()
    A.write_package(out, records(5))
    data = out.getvalue()
    for bad in (b"", b"no package", data[:-30], data[:200]):
        with pytest.raises(ValueError):
            list(A.locate(memory(bad), len(bad)))
    with pytest.raises(ValueError):
        list(A._gzip_members(memory(gzip.compress(b"x" * 1000)[:-9]), 0, len(gzip.compress(b"x" * 1000)) - 9))


def test_zip64_fields():
    """A made-up directory entry whose sizes and offset stand in the extra field."""
    import struct

    extra = struct.pack("<HHH", 7, 2, 9) + struct.pack("<HHQQ", 1, 16, 5 << 32, 6 << 32)
    assert A._large(extra, [0xFFFFFFFF, 17, 0xFFFFFFFF]) == [5 << 32, 17, 6 << 32]
    assert A._large(b"", [1, 2, 3]) == [1, 2, 3]
