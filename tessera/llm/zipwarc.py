"""WARC records in ZIP-packaged archives, written by tasks and read by ranges.

An archive holds two stored members: ``archive/data.warc.gz``, one gzip member per record, and
``indexes/index.jsonl``, one line per record with its place. Sizes and offsets stand in ZIP64 fields, and the
archive ends with a ZIP64 directory record, so the same reader serves any size. The reader takes the end of the
file, the central directory, then the index, and reads records by byte ranges; nothing is extracted.

Archives go to the shared folder under names of their own for each task attempt; only those that the manifest
of finished tasks lists are read, so a lost executor leaves no trace in the result. A task holds one archive of
``ARCHIVE_BYTES`` at most, and one record, in memory.

Null html is an empty payload; a null page id stays null. Of repeated rows with one page id none revisits the other.
An empty table gives no archive and no row. Only the page id, url and html are read, so other columns can't clash.
"""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterable, Iterator
from hashlib import sha256
from typing import Any
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import new_folder, saved

#: Payload bytes from which equal payloads are revisits, and bytes after which a task begins another archive.
LEAST_BYTES, ARCHIVE_BYTES = 100, 16 << 20
#: Bytes that one range read asks for where records lie together.
READ_BYTES = 1 << 20

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit without it."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    uri = " ".join((url or "").split())
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}", "WARC-Date: 2020-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict[str, Any]:
    """page_id, url, kind, payload (None for a revisit), declared bytes and digest, refers_to."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    ident = fields["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
    other = fields.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
    kind = fields["warc-type"]
    return {"page_id": int(ident) if ident else None, "url": fields.get("warc-target-uri") or None, "record_type": kind, "payload": payload if kind == "response" else None, "declared_bytes": declared, "declared_digest": fields["warc-payload-digest"].removeprefix("sha256:"), "refers_to": int(other) if other else None}


def pack(members: list[tuple[str, bytes]]) -> Iterator[bytes]:
    """A ZIP archive of stored members, with ZIP64 fields throughout."""
    at, directory = 0, []
    for name, data in members:
        raw, size, check = name.encode(), len(data), crc32(data)
        local = LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 33, check, FULL32, FULL32, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, size, size)
        directory.append(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 33, check, FULL32, FULL32, len(raw), 28, 0, 0, 0, 0, FULL32) + raw + struct.pack("<HHQQQ", 1, 24, size, size, at))
        yield local
        yield data
        at += len(local) + size
    central = b"".join(directory)
    yield central
    n, end = len(members), at + len(central)
    yield END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(central), at)
    yield LOCATOR + struct.pack("<IQI", 0, end, 1)
    yield END + struct.pack("<HHHHIIH", 0, 0, FULL16, FULL16, FULL32, FULL32, 0)


class Archive:
    """Members of a ZIP archive, read from a file object with size() and read_at(n, offset)."""

    def __init__(self, file: Any):
        self.file = file
        size = file.size()
        tail_at = max(0, size - (1 << 16) - 22 - 76)
        tail = file.read_at(size - tail_at, tail_at)
        end = tail.rfind(END)
        if end < 0:
            raise ValueError("no end of central directory")
        _, _, _, n, length, offset, _ = struct.unpack_from("<HHHHIIH", tail, end + 4)
        if end >= 20 and tail[end - 20 : end - 16] == LOCATOR:
            (at,) = struct.unpack_from("<Q", tail, end - 12)
            wide = file.read_at(56, at)
            if wide[:4] != END64:
                raise ValueError("no ZIP64 directory record")
            n, length, offset = struct.unpack_from("<QQQ", wide, 32)
        directory, at = file.read_at(length, offset), 0
        self.members: dict[str, tuple[int, int, int]] = {}
        for _ in range(n):
            if directory[at : at + 4] != CENTRAL:
                raise ValueError("broken central directory")
            method, _, _, check, packed, whole, n_name, n_extra, n_note, _, _, _, local = struct.unpack_from("<HHHIIIHHHHHII", directory, at + 10)
            name = directory[at + 46 : at + 46 + n_name].decode()
            extra, end_extra = at + 46 + n_name, at + 46 + n_name + n_extra
            while extra + 4 <= end_extra:
                tag, length = struct.unpack_from("<HH", directory, extra)
                if tag == 1:  # only the fields that are full in the fixed part follow, in this order
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", directory, extra + 4))
                    whole = next(wide) if whole == FULL32 else whole
                    packed = next(wide) if packed == FULL32 else packed
                    local = next(wide) if local == FULL32 else local
                extra += 4 + length
            if method == 0 and packed == whole:
                self.members[name] = (local, whole, check)
            at += 46 + n_name + n_extra + n_note

    def place(self, name: str) -> tuple[int, int]:
        """Offset and size of a stored member's bytes."""
        local, size, _ = self.members[name]
        head = self.file.read_at(30, local)
        if head[:4] != LOCAL:
            raise ValueError("broken local header")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return local + 30 + n_name + n_extra, size

    def read(self, name: str) -> bytes:
        at, size = self.place(name)
        data = self.file.read_at(size, at)
        if crc32(data) != self.members[name][2]:
            raise ValueError(f"{name} is damaged")
        return data

    def records(self, index: str = INDEX, data: str = DATA) -> Iterator[dict[str, Any]]:
        """The records that the index lists, read by ranges."""
        begin, size = self.place(data)
        held, held_at = b"", 0
        for line in self.read(index).splitlines():
            place = json.loads(line)
            at, n = place["offset"], place["length"]
            if at + n > size:
                raise ValueError("the index points past its member")
            if not held_at <= at <= at + n <= held_at + len(held):
                held, held_at = self.file.read_at(min(max(n, READ_BYTES), size - at), begin + at), at
            yield parse_record(gzip.decompress(held[at - held_at : at - held_at + n]))


def opened(uri: str) -> tuple[Any, str]:
    """File system and path of a URI; Spark also writes file:/x."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


MANIFEST = "path string, n_records long, n_bytes long"


def write_archives(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Manifest (path, n_records, n_bytes) of the archives that hold a record for each page."""
    rows = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # Revisits are found among ids and digests, so that payloads are dealt by both: a payload of a third of all pages is
    # in no one task. The small table of repeated digests is written, so that Spark can split a hot digest's ids.
    known = rows.filter((F.length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    again = saved(known.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").drop("last"), "repeated")
    revisits = saved(known.join(again, "digest").filter("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct(), "revisits")
    rows = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        task = TaskContext.get()
        data, index, at, done = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal data, index, at, done
            name = f"{path}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{done:05d}.zip"
            size = 0
            with system.open_output_stream(name) as out:
                for piece in pack([(DATA, b"".join(data)), (INDEX, "\n".join(index).encode())]):
                    out.write(piece)
                    size += len(piece)
            row = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "n_records": [len(index)], "n_bytes": [size]}, schema=pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))
            data, index, at, done = [], [], 0, done + 1
            return row

        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                page_id, uri, payload, digest, other = (c[i].as_py() for c in columns)
                packed = gzip.compress(record(page_id, uri, payload, digest, other), 6, mtime=0)
                index.append(json.dumps({"offset": at, "length": len(packed), "digest": f"sha256:{digest}", "url": uri, "page": page_id}))
                data.append(packed)
                at += len(packed)
                if at >= ARCHIVE_BYTES:
                    yield flush()
        if index:
            yield flush()

    return rows.mapInArrow(write, MANIFEST)


RECORDS = "page_id long, url string, record_type string, payload binary, declared_bytes long, declared_digest string, refers_to long"
_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("declared_bytes", pa.int64()), ("declared_digest", pa.string()), ("refers_to", pa.int64())])


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row per record of the archives that the manifest lists; a damaged payload raises."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = opened(path)
                with system.open_input_file(name) as f:
                    rows, held = [], 0
                    for row in Archive(f).records():
                        if row["payload"] is not None and (len(row["payload"]) != row["declared_bytes"] or sha256(row["payload"]).hexdigest() != row["declared_digest"]):
                            raise ValueError(f"a payload of {path} is damaged")
                        rows.append(row)
                        held += len(row["payload"] or b"")
                        if held > 8 << 20 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return manifest.select("path").mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The records of all pages, written to archives in the shared folder and read back."""
    manifest = saved(write_archives(pages, new_folder(pages.sparkSession, "archives"), page, url, html), "manifest")
    n = manifest.agg(F.count("*")).first()[0]
    return read_archives(manifest.repartition(max(1, min(n, 10_000)), F.col("path")))


ORACLE = """
WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM hashed)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM firsts
"""
