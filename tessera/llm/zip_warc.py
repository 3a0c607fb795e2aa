"""WARC records in ZIP packages: written by tasks straight into the shared folder, read back by range reads.

A package holds `archive/<n>.warc.gz` members (stored, each record a gzip member of its own), `indexes/index.cdxj`
(stored: one line for each record with its offset and length in its member) and `datapackage.json`. The reader parses
the end record, the ZIP64 locator and record, the central directory with ZIP64 fields, and the members' local headers,
reads the index, and then fetches only the bytes of records; nothing is extracted and no member is read as a whole.

Files are reached through pyarrow's file systems by the folder's URI, so the folder can lie in any store that it knows.
A task writes under a fresh name and reports it; only packages that finished tasks reported are read, so lost or repeated
tasks leave strays but no wrong records.

Null html is an empty payload; a null or odd URL is percent-encoded. Of equal payloads (of at least `least` bytes) the
row with the smallest page_id is the response (all rows with that page_id, if it repeats). A page without an id revisits one
that has one, and is a response where there is none. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrow import partitions
from tessera.sources.stage import shared_dir, staged

MEMBER_BYTES = 64 << 20
READ_AHEAD = 4 << 20
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
DIGESTS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

# ZIP signatures.
LOCAL, CENTRAL, END, END64, LOCATOR64, DESCRIPTOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x07\x08"
BIG, BIG16 = 0xFFFFFFFF, 0xFFFF


class Package:
    """A ZIP file written front to back: stored members with data descriptors, ZIP64 fields throughout."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        # version 4.5, bit 3: sizes follow the data; the ZIP64 field makes the descriptor's sizes 8 bytes
        self._write(struct.pack("<4sHHHHHIIIHH", LOCAL, 45, 0x808, 0, 0, 0x21, 0, BIG, BIG, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, data: bytes) -> int:
        """Returns where in the member the data begins."""
        m = self.members[-1]
        place = m[3]
        m[2] = zlib.crc32(data, m[2])
        m[3] += len(data)
        self._write(data)
        return place

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self._write(struct.pack("<4sIQQ", DESCRIPTOR, crc, size, size))

    def close(self) -> None:
        start = self.at
        for raw, at, crc, size in self.members:
            self._write(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x808, 0, 0, 0x21, crc, BIG, BIG, len(raw), 28, 0, 0, 0, 0, BIG) + raw + struct.pack("<HHQQQ", 1, 24, size, size, at))
        size, n, here = self.at - start, len(self.members), self.at
        self._write(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
        self._write(struct.pack("<4sIQI", LOCATOR64, 0, here, 1))
        self._write(struct.pack("<4sHHHHIIH", END, 0, 0, min(n, BIG16), min(n, BIG16), BIG, BIG, 0))
        self.out.close()


def directory(f, size: int) -> dict[str, tuple[int, int, int, int]]:
    """name -> (local header place, stored size, size, method) from the central directory; f has seek and read."""

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    k = tail.rfind(END)
    if k < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, k + 10)
    if n == BIG16 or length == BIG or start == BIG:
        place = tail_at + k - 20
        sig, _, at64, _ = struct.unpack("<4sIQI", read(place, 20))
        if sig != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        record = read(at64, 56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end record")
        n, length, start = struct.unpack_from("<QQQ", record, 32)
    raw, at, out = read(start, length), 0, {}
    for _ in range(n):
        if raw[at : at + 4] != CENTRAL:
            raise ValueError("central directory is damaged")
        method, = struct.unpack_from("<H", raw, at + 10)
        packed, plain = struct.unpack_from("<II", raw, at + 20)
        name_n, extra_n, note_n = struct.unpack_from("<HHH", raw, at + 28)
        local, = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46 : at + 46 + name_n].decode("utf-8", "replace")
        extra, x = raw[at + 46 + name_n : at + 46 + name_n + extra_n], 0
        while x + 4 <= len(extra):
            tag, m = struct.unpack_from("<HH", extra, x)
            if tag == 1:
                y = x + 4
                # only the fields that are all ones in the fixed part follow, in this order
                if plain == BIG:
                    plain, y = struct.unpack_from("<Q", extra, y)[0], y + 8
                if packed == BIG:
                    packed, y = struct.unpack_from("<Q", extra, y)[0], y + 8
                if local == BIG:
                    local, y = struct.unpack_from("<Q", extra, y)[0], y + 8
            x += 4 + m
        out[name] = (local, packed, plain, method)
        at += 46 + name_n + extra_n + note_n
    return out


def data_place(f, local: int) -> int:
    """Where a member's data begin: its local header has lengths of its own."""
    f.seek(local)
    head = f.read(30)
    if head[:4] != LOCAL:
        raise ValueError("local header is damaged")
    name_n, extra_n = struct.unpack_from("<HH", head, 26)
    return local + 30 + name_n + extra_n


def record(page_id: int, url: str, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """A gzip member with one WARC record, and its payload digest."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {url}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    raw = ("\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush(), digest


def parse(data: bytes) -> dict:
    """One record from its gzip member."""
    raw = zlib.decompress(data, 47)
    head, rest = raw.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(h["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    said = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    ours = lambda x: int(n) if (n := x[len("<urn:page:") : -1]) else None
    out = {"page_id": ours(h["WARC-Record-ID"]), "url": h["WARC-Target-URI"], "record_type": h["WARC-Type"], "refers_to": ours(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None, "payload_bytes": int(said["Content-Length"]), "payload": payload}
    if out["record_type"] == "response":
        out["payload_bytes"] = len(payload)
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest:
            raise ValueError(f"payload of page {out['page_id']} doesn't match its digest")
    return out | {"payload_digest": digest}


def plan(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: null for responses. Equal payloads are found by digest, counted before any join."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html).alias("d"), F.octet_length(html).alias("n"))
    firsts = rows.where(F.col("n") >= least).groupBy("d", "n").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    again = rows.join(firsts, ["d", "n"]).where("not page_id <=> refers_to and refers_to is not null").select(F.col("page_id").alias("p"), F.col("d").alias("e"), F.col("n").alias("m"), "refers_to").distinct()
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("d"), F.octet_length(html).alias("n"))
    return full.join(again, full["page_id"].eqNullSafe(again["p"]) & (full["d"] == again["e"]) & (full["n"] == again["m"]), "left").drop("d", "n", "p", "e", "m")


def write_packages(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes the packages; (path, records, bytes) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        package, lines, path, member, used = None, [], "", "", 0
        for b in batches:
            for page, url, html, first in zip(*(b.column(k).to_pylist() for k in range(4))):
                if package is None:
                    path = f"{base}/{uuid.uuid4().hex}.zip"
                    fs.create_dir(base, recursive=True)
                    package = Package(fs.open_output_stream(path))
                if not member or used > MEMBER_BYTES:
                    if member:
                        package.end()
                    member, used = f"archive/{len(package.members):05d}.warc.gz", 0
                    package.begin(member)
                url = quote(url or "", safe=":/?#[]@!$&'()*+,;=%~-._")
                data, digest = record(page, url, html, first)
                at = package.write(data)
                used += len(data)
                lines.append(f"{url or '-'} 20240101000000 " + json.dumps({"page": page, "digest": digest, "filename": member, "offset": at, "length": len(data)}))
        if package is not None:
            package.end()
            package.begin("indexes/index.cdxj")
            package.write("".join(x + "\n" for x in sorted(lines)).encode())
            package.end()
            package.begin("datapackage.json")
            package.write(json.dumps({"profile": "data-package", "resources": [{"path": m[0].decode()} for m in package.members[:-1]]}).encode())
            package.end()
            package.close()
            size = package.at
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(lines)], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    return staged(plan(pages, least).select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long, bytes long"), "packages")


def read_index(packages: DataFrame, folder: str) -> DataFrame:
    """(path, at, length) of every record: absolute places, from each package's directory and index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_file(path) as f:
                    members = directory(f, f.size())
                    if any(m[3] for m in members.values()):
                        raise ValueError(f"{path} has compressed members")
                    begin = {name: data_place(f, m[0]) for name, m in members.items()}
                    f.seek(begin["indexes/index.cdxj"])
                    text = f.read(members["indexes/index.cdxj"][1]).decode()
                found = [json.loads(re.sub(r"^\S* \d+ ", "", line)) for line in text.splitlines()]
                found = sorted((begin[x["filename"]] + int(x["offset"]), int(x["length"])) for x in found)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["path", "at", "length"])

    return packages.select("path").repartition(partitions(packages), "path").mapInArrow(run, "path string, at long, length long")


def read_records(packages: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Every record of the packages, its bytes fetched by range reads (neighbouring records in one read)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        open_path, f = "", None
        for b in batches:
            rows = list(zip(*(b.column(k).to_pylist() for k in range(3))))
            a = 0
            while a < len(rows):
                path, at, length = rows[a]
                z, end = a + 1, at + length
                while z < len(rows) and rows[z][0] == path and rows[z][1] == end and end - at < READ_AHEAD:
                    end += rows[z][2]
                    z += 1
                if path != open_path:
                    if f is not None:
                        f.close()
                    open_path, f = path, fs.open_input_file(path)
                f.seek(at)
                raw = f.read(end - at)
                out = []
                for _, p, n in rows[a:z]:
                    r = parse(raw[p - at : p - at + n])
                    if not payload:
                        r["payload"] = None
                    out.append(r)
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds)], names=names)
                a = z
        if f is not None:
            f.close()

    return read_index(packages, folder).mapInArrow(run, RECORDS)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    packages = write_packages(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_records(packages, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
