"""WARC archives packaged in ZIP files: a writer, and a reader that fetches byte ranges.

A package is a ZIP file of stored (not compressed) members: ``archive/data.warc.gz``, WARC records
that are compressed one by one, and ``indexes/index.cdxj``, a line for each record with its offset
and length. The reader opens nothing as a whole: it fetches the end of the package, follows the
(ZIP64) end record to the central directory, finds the members, fetches the index and from then on
single records by their offsets.

Packages are files below a folder that all executors reach (``file``, ``hdfs``, ``s3`` or ``gs``,
through ``pyarrow.fs``). A task writes under names of its own, and only the packages listed in
the manifest, a table that Spark commits, count; what a lost executor leaves behind is not listed.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import saved, scratch

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT_BYTES = 100
PACKAGE_BYTES = 64 << 20
DATE = "2001-06-01T00:00:00Z"

# Signatures of the ZIP format, and what stands for "see the ZIP64 field".
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


# ---------------------------------------------------------------- records


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC record, compressed. A revisit holds the headers only, not the payload."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{digest}|{kind}")
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body += payload if kind == "response" else b""
    clean = "".join((url or "").split())
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Target-URI: {clean}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"X-Refers-To-Page: {refers_to}",
        ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one compressed record; the payload follows the HTTP headers."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


# ---------------------------------------------------------------- packages


class PackageWriter:
    """Writes one package to an open stream, member by member."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64
        self.index: list[str] = []
        self._begin(ARCHIVE)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _begin(self, name: str) -> None:
        """Sizes are not known yet: they follow the data (flag 8), as 64-bit numbers."""
        self.members.append([name, self.at, 0, 0])
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(LOCAL + struct.pack("<5H3I2H", 45, 8, 0, 0, 33, 0, FULL32, FULL32, len(name), len(extra)))
        self._put(name.encode() + extra)

    def _end(self) -> None:
        _, _, crc, size = self.members[-1]
        self._put(b"PK\x07\x08" + struct.pack("<IQQ", crc, size, size))

    def _data(self, data: bytes) -> None:
        member = self.members[-1]
        member[2] = zlib.crc32(data, member[2])
        member[3] += len(data)
        self._put(data)

    def add(self, data: bytes, **entry) -> None:
        offset = self.members[-1][3]
        self._data(data)
        self.index.append(json.dumps(entry | {"offset": offset, "length": len(data)}, sort_keys=True))

    def close(self) -> None:
        self._end()
        self._begin(INDEX)
        self._data("\n".join(self.index).encode())
        self._end()
        start = self.at
        for name, offset, crc, size in self.members:
            wide = self.zip64 or size >= FULL32 or offset >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if wide else b""
            small = (FULL32, FULL32) if wide else (size, size)
            self._put(CENTRAL + struct.pack("<6H3I5H2I", 45, 45, 8, 0, 0, 33, crc, *small, len(name), len(extra), 0, 0, 0, 0, FULL32 if wide else offset))
            self._put(name.encode() + extra)
        length, count = self.at - start, len(self.members)
        wide = self.zip64 or start >= FULL32
        if wide:
            end = self.at
            self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, length, start))
            self._put(LOCATOR64 + struct.pack("<IQI", 0, end, 1))
        count = FULL16 if wide else count
        self._put(END + struct.pack("<4H2IH", 0, 0, count, count, FULL32 if wide else length, FULL32 if wide else start, 0))


Fetch = Callable[[int, int], bytes]


def directory(fetch: Fetch, size: int) -> dict[str, tuple[int, int]]:
    """Stored members of a package: name -> (offset of its data, length). ``fetch(offset, length)``."""
    tail_at = max(0, size - 22 - FULL16)
    tail = fetch(tail_at, size - tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    locator = fetch(tail_at + at - 20, 20) if tail_at + at >= 20 else b""
    if locator[:4] == LOCATOR64 and (count == FULL16 or FULL32 in (length, start)):
        end64 = fetch(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    entries, found, at = fetch(start, length), {}, 0
    for _ in range(count):
        if entries[at : at + 4] != CENTRAL:
            raise ValueError("damaged central directory")
        method = struct.unpack_from("<H", entries, at + 10)[0]
        packed, plain, n, e, c = struct.unpack_from("<IIHHH", entries, at + 20)
        offset = struct.unpack_from("<I", entries, at + 42)[0]
        name = entries[at + 46 : at + 46 + n].decode()
        extra, x = entries[at + 46 + n : at + 46 + n + e], 0
        while x + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, x)
            if kind == 1:  # only what did not fit is there, in this order
                wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, x + 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                offset = next(wide) if offset == FULL32 else offset
            x += 4 + width
        if method == 0:
            n_local, e_local = struct.unpack("<HH", fetch(offset + 26, 4))
            found[name] = (offset + 30 + n_local + e_local, packed)
        at += 46 + n + e + c
    return found


def package_records(fetch: Fetch, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Each record of a package, fetched by the offsets of its index."""
    members = directory(fetch, size)
    start, _ = members[ARCHIVE]
    for line in fetch(*members[INDEX]).decode().splitlines():
        entry = json.loads(line)
        yield parse_record(fetch(start + entry["offset"], entry["length"]))


# ---------------------------------------------------------------- Spark


def _write(folder: str, zip64: bool, package_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        out = writer = None
        path = ""

        def close() -> pd.DataFrame:
            writer.close()
            out.close()
            return pd.DataFrame({"path": [path], "records": [len(writer.index)], "bytes": [writer.at]})

        for batch in batches:
            for row in batch.itertuples():
                if writer is None:
                    path = f"{top}/{uuid.uuid4().hex}.wacz"
                    out = store.open_output_stream(path)
                    writer = PackageWriter(out, zip64)
                page_id = None if pd.isna(row.page_id) else row.page_id
                revisit = not pd.isna(row.refers_to)
                kind = "revisit" if revisit else "response"
                data = record(kind, page_id, row.url, row.html.encode(), row.digest, row.refers_to if revisit else None)
                writer.add(data, digest=f"sha256:{row.digest}", page_id=page_id, type=kind, url=row.url)
                if writer.at >= package_bytes:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    return run


def write_packages(pages: DataFrame, folder: str, zip64: bool = False, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as packages below ``folder``; the manifest (path, records, bytes).

    Of records with equal payloads of at least 100 bytes the one with the smallest page_id is a
    response and the others revisit it; smaller ones are all responses. A null html is an empty
    payload, a null id is never the smallest (where all ids are null, all are responses), and rows
    that repeat the smallest id with the same payload are responses too. Groups are counted with
    partial sums before their shuffle; a payload is shuffled once at most.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("digest", F.sha2("html", 256))
    copies = (
        rows.filter(F.octet_length("html") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1 and _first is not null")
        .drop("_n")
    )
    copies = saved(copies, "payload-copies")
    decided = rows.join(copies, "digest", "left").select(
        F.col("page_id").cast("string").alias("page_id"),
        "url",
        "html",
        "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first").cast("string")).alias("refers_to"),
    )
    return saved(decided.mapInPandas(_write(folder, zip64, package_bytes), "path string, records long, bytes long"), "manifest")


def _read(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, size in zip(batch["path"], batch["bytes"], strict=True):
                with store.open_input_file(path) as file:
                    rows = []
                    for headers, payload in package_records(lambda at, n: file.read_at(n, at), size):  # noqa: B023
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: a payload differs from its digest")
                        rows.append(
                            (headers["X-Page-ID"] or None, headers["WARC-Target-URI"], kind, digest)
                            + (int(headers["X-Payload-Length"]), headers.get("X-Refers-To-Page"), payload if kind == "response" else None)
                        )
                        if len(rows) >= 1000:
                            yield pd.DataFrame(rows, columns=READ)
                            rows = []
                    yield pd.DataFrame(rows, columns=READ)

    return run


READ = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]


def read_packages(manifest: DataFrame, folder: str) -> DataFrame:
    """Records of the packages in ``manifest``, one package a task at least.

    (page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload); the payload of
    a revisit is null. A response whose payload does not have its digest ends the read.
    """
    kinds = "page_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary"
    many = manifest.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return many.mapInPandas(_read(folder), kinds).withColumns(
        {"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")}
    )


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to packages in the shared folder and read them back."""
    folder = scratch(pages.sparkSession, "warc")
    if "://" not in folder:
        folder = folder if folder.startswith("file:") else f"file://{folder}"
    return read_packages(write_packages(pages, folder), folder)
