"""WARC records in ZIP archives: written by tasks, then read back by ranges without extraction.

An archive is a ZIP file with stored members: ``archive/data.warc.gz`` (records, gzipped one by one)
and ``indexes/index.cdxj`` (a line of JSON per record, with its offset and length). The reader finds the
central directory, ZIP64 or not, and from it the members' places; records are read by range.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripcohort.llm.common import BROADCAST_ROWS, durable, few, fresh, sized
from stripcohort.sources.shared import hadoop_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads shorter than this are always written in full.
LEAST_BYTES = 100
#: A payload of more pages than this meets them as a broadcast row of its own, where payloads are too many to be broadcast.
HOT_ROWS = 10_000
#: A task begins another archive after so many bytes of records.
ARCHIVE_BYTES = 256 << 20


def plan_records(pages: DataFrame, least_bytes: int = LEAST_BYTES, max_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """page_id, url, html, digest, refers_to: of equal payloads of least_bytes or more the smallest page_id stands, the others refer to it.

    Where few payloads repeat (max_rows) they are broadcast and no page moves. Beyond, revisits are found on ids and digests
    alone, and pages meet them by id: a payload that any number of pages share is no task's.
    """
    html = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumn("digest", F.sha2("html", 256))
    long = F.octet_length("html") >= least_bytes
    counted = base.filter(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = durable(counted.filter("n > 1 and first is not null"))
    columns = ["page_id", "url", "html", "digest", "refers_to"]
    if few(groups, max_rows):
        stands = F.broadcast(groups.select("digest", "first"))
        refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
        return base.join(stands, "digest", "left").withColumn("refers_to", refers).select(*columns)
    # at most rows / hot_rows payloads are hot; the others' groups have no more than hot_rows ids each
    hot = sized(groups.filter(F.col("n") > hot_rows).select("digest", F.col("first").alias("hot")), max_rows)
    cold = groups.filter(F.col("n") <= hot_rows).select("digest", "first")
    ids = durable(base.filter(long & F.col("page_id").isNotNull()).select("page_id", "digest"))
    of_hot = ids.join(hot, "digest").select("page_id", "digest", F.col("hot").alias("first"))
    of_cold = ids.join(hot, "digest", "left_anti").join(cold, "digest").select("page_id", "digest", "first")
    revisits = of_hot.unionByName(of_cold).filter("page_id <> first").distinct()
    revisits = sized(revisits.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to")), max_rows)
    # pages without an id revisit none: dealt by what they hold, they don't meet in one task
    key = F.coalesce("page_id", F.xxhash64("url", "digest"))
    joined = base.join(revisits, long & F.col("page_id").isNotNull() & (key == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select(*columns)


def record(page_id: int | None, url: str | None, html: str, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record without the payload, as bytes."""
    payload = html.encode("utf-8", "replace")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"] if url else []
    head += [f"WARC-Payload-Digest: sha256:{digest}"]
    head += [] if refers_to is None else [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class Archive:
    """An archive that is being written."""

    def __init__(self, uri: str) -> None:
        self.uri, self.n, self.at, self.index = uri, 0, 0, io.BytesIO()
        system, path = fs.FileSystem.from_uri(uri)
        self.out = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, page_id: int | None, content: bytes) -> None:
        packed = gzip.compress(content, 3, mtime=0)
        self.data.write(packed)
        self.index.write(json.dumps({"page": page_id, "offset": self.at, "length": len(packed)}).encode() + b"\n")
        self.at += len(packed)
        self.n += 1

    def close(self) -> tuple[str, int]:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.write(self.index.getbuffer())
        self.zip.close()
        self.out.close()
        return self.uri, self.n


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the planned records, an archive or more per task, and returns uri and n of each archive.

    Names are fresh for each attempt, and only archives of tasks that ended come back: a task that is run
    again never meets the files of a lost one.
    """

    def done(archive: Archive) -> pa.RecordBatch:
        uri, n = archive.close()
        return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], ["uri", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page_id, url, html, digest, first = (x.as_py() for x in row)
                archive = archive or Archive(f"{folder}/{uuid.uuid4().hex}.wacz")
                archive.add(page_id, record(page_id, url, html, digest, first))
                if archive.at >= archive_bytes:
                    yield done(archive)
                    archive = None
        if archive:
            yield done(archive)

    # ids stay in Arrow: as pandas numbers, those beside a null would lose their low digits
    return durable(records.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "uri string, n long"))


def members(f: BinaryIO, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (where its local header begins, stored size, compression method), from the central directory, ZIP64 where there is one."""
    tail = min(size, 22 + 0xFFFF)
    f.seek(size - tail)
    end = f.read(tail)
    at = end.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack("<HII", end[at + 10 : at + 20])
    place = size - tail + at
    if 0xFFFF == n or 0xFFFFFFFF in (length, start):
        f.seek(place - 20)
        sign, _, where, _ = struct.unpack("<4sIQI", f.read(20))
        if sign != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        f.seek(where)
        head = f.read(56)
        if head[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = struct.unpack("<QQQ", head[32:56])
    f.seek(start)
    directory = f.read(length)
    out, p = {}, 0
    for _ in range(n):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", directory[p + 8 : p + 12])
        packed, plain = struct.unpack("<II", directory[p + 20 : p + 28])
        names, extras, comments = struct.unpack("<HHH", directory[p + 28 : p + 34])
        (local,) = struct.unpack("<I", directory[p + 42 : p + 46])
        name = directory[p + 46 : p + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        q, stop = p + 46 + names, p + 46 + names + extras
        while q + 4 <= stop:
            kind, long = struct.unpack("<HH", directory[q : q + 4])
            if kind == 1:  # the fields that overflowed, in this order
                wide = iter(struct.unpack(f"<{long // 8}Q", directory[q + 4 : q + 4 + long // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            q += 4 + long
        out[name] = (local, packed, method)
        p = stop + comments
    return out


def stored(f: BinaryIO, entry: tuple[int, int, int]) -> tuple[int, int]:
    """Where a stored member's bytes begin, and how many they are."""
    local, size, method = entry
    if method:
        raise ValueError("a member that isn't stored can't be read by range")
    f.seek(local)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    names, extras = struct.unpack("<HH", head[26:30])
    return local + 30 + names + extras, size


def parse_record(content: bytes) -> dict:
    """page_id, record_type, refers_to, payload_bytes, payload_digest, payload (None for a revisit), checked against the digest."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda key: int(x) if (x := fields.get(key, "<urn:page:>")[10:-1]) else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't have its digest")
    return {"page_id": number("WARC-Record-ID"), "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload_bytes": length, "payload_digest": digest, "payload": payload if kind == "response" else None}


def read_archive(uri: str) -> Iterator[dict]:
    """The records of an archive in the order of its index, each by a range read."""
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        found = members(f, f.size())
        data, _ = stored(f, found[DATA])
        at, left = stored(f, found[INDEX])
        rest = b""
        while left or rest:
            f.seek(at)
            part = f.read(min(left, 1 << 20))
            at, left = at + len(part), left - len(part)
            lines = (rest + part).split(b"\n")
            rest = lines.pop() if left else b""
            for line in filter(None, lines):
                entry = json.loads(line)
                f.seek(data + entry["offset"])
                yield parse_record(gzip.decompress(f.read(entry["length"])))


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record of the archives (uri)."""
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    columns = [x.split()[0] for x in kind.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0):
                rows: list[dict] = []
                size = 0
                for r in read_archive(uri.as_py()):
                    rows.append(r)
                    size += len(r["payload"] or b"") if payloads else 0
                    if len(rows) == 512 or size >= 16 << 20:
                        yield _batch(rows, columns, types)
                        rows, size = [], 0
                yield _batch(rows, columns, types)

    return archives.select("uri").mapInArrow(run, kind)


def _batch(rows: list[dict], columns: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(columns, types, strict=True)], columns)


def archive_and_read(pages: DataFrame, least_bytes: int = LEAST_BYTES, payloads: bool = False) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) to archives in the shared folder, and reads them back.

    A null html is an empty payload; payloads below least_bytes, and rows without a page_id, are always responses; a
    repeated page_id is a record each time (all responses if it is the smallest of its payload). Other columns of pages
    are left out. The archives are removed as common.scratch() says: write_archives() makes those that stay.
    """
    folder = _uri(fresh(pages.sparkSession))
    _make(pages, folder)
    archives = write_archives(plan_records(pages, least_bytes), folder)
    spread = archives.repartition(max(1, min(archives.count(), 10_000)), "uri")
    return read_archives(spread, payloads)


def _uri(folder: str) -> str:
    return folder.rstrip("/") if "://" in folder or folder.startswith("file:") else f"file://{folder.rstrip('/')}"


def _make(pages: DataFrame, folder: str) -> None:
    at, system = hadoop_path(pages.sparkSession, folder)
    system.mkdirs(at)
