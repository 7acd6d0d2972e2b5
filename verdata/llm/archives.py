"""Web archives in ZIP packages: written by tasks, read back by ranges.

A package holds stored (not compressed) members: ``archive/data.warc.gz``, whose records are gzip members of their own, and ``indexes/index.cdxj``, a line
for each record with its offset and length. The reader takes the end of central directory record, or its ZIP64 form, from the file's end, goes through the central
directory (with ZIP64 extra fields), finds where each member's bytes lie in the package, and reads index lines and records there by their ranges; nothing is
unpacked to disk. Members without an index are gone through once, record by record. Compressed or encrypted archive members are an error, and so are damaged directories.

Packages lie in a shared folder (``pyarrow.fs`` opens it on the executors by its URI). Each task writes files of new names and reports the finished ones, and
the report is written as a table: a task that runs again leaves a file that nobody reads. Nothing but sizes of one package's index is held in memory, and a package is closed at
``package_bytes``. Reading is split by stretches of ``STRETCH`` bytes, so that a large package is read by many tasks.

Of records with equal payloads of at least ``least`` bytes, that with the smallest id is a response and the others revisit it; rows of that same id are all responses, rows without id
revisit. A null payload is an empty one; a null URL gives no target; white space and control characters of a URL are percent-encoded. Repeated rows give repeated records. An empty table gives
no package and no records. Columns other than the named ones aren't written.
"""

from __future__ import annotations

import gzip
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdata.llm.text import slices
from verdata.plans.storage import broadcast_if_small, materialize, shared_dir

STRETCH = 4 << 20
#: Names of the members, and the profile of a revisit of an equal payload.
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

Read = Callable[[int, int], bytes]


class Member(NamedTuple):
    name: str
    method: int
    flags: int
    header: int
    size: int


def _end(read: Read, size: int) -> tuple[int, int, int]:
    """Where the central directory begins, its bytes, and how far the package lies behind the file's start."""
    tail = read(max(0, size - 65_557), min(size, 65_557))
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    end = size - len(tail) + at
    length, start = struct.unpack_from("<II", tail, at + 12)
    locator = read(end - 20, 20) if end >= 76 else b""
    if locator[:4] == b"PK\x06\x07":
        # Bytes in front of the package move everything; its own record then ends where the locator begins.
        large = next((p for p in (end - 76, struct.unpack_from("<Q", locator, 8)[0]) if read(p, 4) == b"PK\x06\x06"), None)
        if large is None:
            raise ValueError("no ZIP64 end of central directory")
        length, start = struct.unpack_from("<QQ", read(large, 56), 40)
        end = large
    elif 0xFFFFFFFF in (length, start):
        raise ValueError("no ZIP64 end of central directory")
    return end - length, length, end - length - start


def _large(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and offset, those of 0xFFFFFFFF taken from the ZIP64 extra field in this order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            rest = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return [next(rest) if v == 0xFFFFFFFF else v for v in values]
        at += 4 + n
    return values


def members(read: Read, size: int, step: int = 1 << 20) -> Iterator[Member]:
    """The central directory's entries, read by stretches of ``step`` bytes."""
    at, left, shift = _end(read, size)
    held = b""
    while left or held:
        if len(held) < 46 or len(held) < 46 + sum(struct.unpack_from("<HHH", held, 28)):
            if not left:
                raise ValueError("central directory ends early")
            n = min(step, left)
            held, at, left = held + read(at, n), at + n, left - n
            continue
        if held[:4] != b"PK\x01\x02":
            raise ValueError("no entry of a central directory")
        flags, method = struct.unpack_from("<HH", held, 8)
        packed, _, n, m, c = struct.unpack_from("<IIHHH", held, 20)
        unpacked, header = struct.unpack_from("<I", held, 24)[0], struct.unpack_from("<I", held, 42)[0]
        unpacked, packed, header = _large(held[46 + n:46 + n + m], [unpacked, packed, header])
        yield Member(held[46:46 + n].decode("utf-8" if flags & 0x800 else "cp437"), method, flags, header + shift, packed)
        held = held[46 + n + m + c:]


def start_of(read: Read, member: Member) -> int:
    """Where a stored member's bytes begin, behind its local header."""
    if member.method or member.flags & 1:
        raise ValueError(f"{member.name} isn't stored as it is")
    head = read(member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def _lines(read: Read, start: int, size: int, step: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    for a in range(0, size, step):
        *whole, rest = (rest + read(start + a, min(step, size - a))).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _gzip_members(read: Read, start: int, size: int, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Offset and length of each gzip member, for archives without an index."""
    at, begun, unpack, data = 0, 0, zlib.decompressobj(31), b""
    while at < size or data:
        if not data:
            data = read(start + at, min(step, size - at))
            at += len(data)
        unpack.decompress(data)
        data = unpack.unused_data
        if unpack.eof:
            yield begun, at - len(data) - begun
            begun, unpack = at - len(data), zlib.decompressobj(31)
    if begun < size:
        raise ValueError("the last record ends early")


def locate(read: Read, size: int) -> Iterator[tuple[int, int, str | None, str | None]]:
    """Start in the package, length, URL and type of each record, from the index members; archive members that no index names are gone through."""
    found = list(members(read, size))
    archives = {m.name: start_of(read, m) for m in found if re.search(r"\.warc\.gz\Z", m.name)}
    indexed = set()
    for m in found:
        if re.search(r"\.cdxj\Z", m.name):
            for line in _lines(read, start_of(read, m), m.size):
                if line.strip():
                    fields = json.loads(line[line.index(b"{"):])
                    name = fields["filename"] if "/" in fields["filename"] else "archive/" + fields["filename"]
                    indexed.add(name)
                    yield archives[name] + int(fields["offset"]), int(fields["length"]), fields.get("url"), fields.get("type")
    for m in found:
        if m.name in archives and m.name not in indexed:
            for a, n in _gzip_members(read, archives[m.name], m.size):
                yield archives[m.name] + a, n, None, None


def _headers(text: bytes) -> dict[str, str]:
    """Header lines behind the first, by lower-case name."""
    pairs = (line.partition(b":") for line in text.split(b"\r\n")[1:])
    return {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in pairs if v}


def parse_record(data: bytes) -> dict:
    """Of an uncompressed WARC record: its id, type, URL, what it refers to, and the payload's digest, length and bytes (a revisit has none)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    h = _headers(head)
    block = rest[:int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    stated = _headers(http).get("content-length")
    revisit = h["warc-type"] == "revisit"
    bare = lambda key: h[key].strip("<>").removeprefix("urn:record:") if key in h else None
    return {"record_id": bare("warc-record-id"), "record_type": h["warc-type"], "url": h.get("warc-target-uri"), "refers_to": bare("warc-refers-to"), "payload_digest": h.get("warc-payload-digest", "").rpartition(":")[2] or None,
            "payload_bytes": int(stated) if revisit and stated else len(payload), "payload": None if revisit else payload}


def make_record(record_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """The WARC record of a response, or of a revisit if it refers to another record."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:record:{'' if record_id is None else record_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {target(url)}")
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Refers-To: <urn:record:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def target(url: str) -> str:
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: quote(m.group()), url)


def write_package(out, records: Iterator[tuple[str | None, str | None, str, bytes]], name: str = DATA, index: bool = True) -> int:
    """A package of records (URL, type, digest, WARC bytes) into a binary stream; the bytes of its archive member."""
    at, lines = 0, []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
            for url, kind, digest, data in records:
                packed = gzip.compress(data, 6, mtime=0)
                member.write(packed)
                fields = {"url": url, "type": kind, "digest": f"sha256:{digest}", "filename": name, "offset": at, "length": len(packed)}
                lines.append(f"{quote(url or '-', safe=':/?&=')} 0 {json.dumps(fields)}\n".encode())
                at += len(packed)
        if index:
            with z.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
                member.write(b"".join(lines))
    return at


def _write(folder: str, package_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)

        def records() -> Iterator[tuple]:
            for part in slices(batches, "payload"):
                for who, url, payload, digest, of in zip(*(part.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "refers_to"))):
                    yield None if url is None else target(url), "response" if of is None else "revisit", digest, make_record(who, url, payload, digest, of, date)
        todo = records()
        ahead = next(todo, None)
        while ahead is not None:
            count = [0, 0]

            def some() -> Iterator[tuple]:
                nonlocal ahead
                while ahead is not None and count[1] < package_bytes:
                    count[0] += 1
                    count[1] += len(ahead[3])
                    yield ahead
                    ahead = next(todo, None)
            path = f"{uuid.uuid4().hex}.zip"
            with where.open_output_stream(f"{base}/{path}") as out:
                write_package(out, some())
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "n_records": [count[0]], "bytes": [where.get_file_info(f"{base}/{path}").size]})
    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None, least: int = 100, package_bytes: int = 256 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write packages; ``path, n_records, bytes`` of each. ``folder`` (default: a new one in the shared folder) is a URI that all executors can open."""
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    folder = folder or f"{shared_dir(pages.sparkSession)}/archives/{uuid.uuid4().hex}"
    where, base = fs.FileSystem.from_uri(folder)
    where.create_dir(base, recursive=True)
    rows = pages.select(name(id_col).alias("id"), name(url_col).cast("string").alias("url"), F.coalesce(name(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # One row for each payload that occurs again; texts stay where they are.
    same = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    same = broadcast_if_small(materialize(same.select(F.col("digest").alias("_digest"), "first")))
    marked = rows.join(same, F.col("digest") == F.col("_digest"), "left").select(F.col("id").cast("string").alias("id"), "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).cast("string").alias("refers_to"))
    return materialize(marked.mapInArrow(_write(folder, package_bytes, date), "path string, n_records long, bytes long"))


def _tasks(df: DataFrame) -> int:
    """Names and ranges are few bytes and stand for many, so their number of tasks is fixed instead of merged by size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _opened(path: str) -> tuple[Read, int, Callable[[], None]]:
    where, base = fs.FileSystem.from_uri(path)
    f = where.open_input_file(base)
    return lambda at, n: f.read_at(n, at), f.size(), f.close


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "start", "length", "url", "type"]
    for batch in batches:
        for path in batch.column("path").to_pylist():
            read, size, close = _opened(path)
            rows: list[tuple] = []
            for row in locate(read, size):
                rows.append((path, *row))
                if len(rows) == 20_000:
                    yield _batch(rows, names)
                    rows = []
            close()
            if rows:
                yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def locate_records(packages: DataFrame) -> DataFrame:
    """``path, start, length, url, type`` of each record of the packages named in ``path``; ``url`` and ``type`` are null without an index."""
    return packages.select("path").repartition(_tasks(packages), "path").mapInArrow(_locate, "path string, start long, length long, url string, type string")


_RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            read, _, close = _opened(row["path"])
            found, held, at = [], b"", 0
            ends = [r["start"] + r["length"] for r in row["ranges"]]
            dense = ends[-1] - row["ranges"][0]["start"] <= 2 * sum(r["length"] for r in row["ranges"])
            if dense:
                at = row["ranges"][0]["start"]
                held = read(at, max(ends) - at)
            size = 0
            for r in row["ranges"]:
                data = held[r["start"] - at:r["start"] - at + r["length"]] if dense else read(r["start"], r["length"])
                found.append(parse_record(zlib.decompress(data, 31)))
                size += found[-1]["payload_bytes"]
                if size > STRETCH:
                    yield pa.RecordBatch.from_pylist(found, _RECORD)
                    found, size = [], 0
            close()
            if found:
                yield pa.RecordBatch.from_pylist(found, _RECORD)


def read_records(located: DataFrame) -> DataFrame:
    """The records at ``path, start, length``: ``record_id, record_type, url, refers_to, payload_digest, payload_bytes, payload``. Neighbours are read at once."""
    stretch = located.withColumn("stretch", F.floor(F.col("start") / STRETCH))
    ranges = stretch.repartition(_tasks(located), "path", "stretch").groupBy("path", "stretch").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("ranges"))
    return ranges.select("path", "ranges").mapInArrow(_fetch, "record_id string, record_type string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """``pages`` written to packages and read back: id, ``payload_bytes``, ``payload_digest`` (of the bytes read; a revisit's as stated), ``record_type`` and ``refers_to``. The packages go afterwards."""
    folder = f"{shared_dir(pages.sparkSession)}/archives/{uuid.uuid4().hex}"
    kind = pages.schema[id_col].dataType
    id_of = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    back = read_records(locate_records(write_archives(pages, id_col, folder=folder, **options)))
    digest: Column = F.coalesce(F.sha2("payload", 256), F.col("payload_digest"))
    out = materialize(back.select(id_of("record_id").alias(id_col), "payload_bytes", digest.alias("payload_digest"), "record_type", id_of("refers_to").alias("refers_to")))
    where, base = fs.FileSystem.from_uri(folder)
    where.delete_dir(base)
    return out
