"""WARC records in ZIP-packaged archives: written once, then read in place by byte ranges.

An archive is a ZIP file with two stored (not deflated) members: ``archive/data.warc.gz``, a gzip member
for each record, and ``indexes/index.cdxj``, a line with offset and length for each. Each task writes an
archive under a name of its own and reports it; only reported archives are read, so a task that is lost
and run again leaves nothing that counts. The reader seeks: it parses the end record, ZIP64 locator
and central directory, checks the local headers, reads the index, and fetches ranges of records without
unpacking the archive. Files are reached through ``pyarrow.fs``, by the folder's
qualified address, so it may be on any store that both Spark and pyarrow know.

Of records whose payloads are equal and have at least ``MIN_REVISIT`` bytes, that with the smallest id
is a response and the others are revisits that refer to it.

Defined results: a null html is an empty payload. Rows that repeat an id are records each; of rows with
the smallest id and equal payloads, all are responses. Rows without an id are written without one and
always are responses.
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

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, stash

MIN_REVISIT = 100
#: Bytes of compressed records after which a task begins another archive, and of a range that is read at once.
ARCHIVE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20
#: Ranges that a task reads, about.
TASK_RANGES = 16
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
_MAX32 = 0xFFFFFFFF


# --- records ---------------------------------------------------------------------------------------


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response, or a revisit without its payload if ``refers_to`` is an id."""
    status = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = status + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {_header(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        *(() if refers_to is None else ("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>")),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _header(value: str | None) -> str:
    return "".join(c for c in value or "" if c not in "\r\n")


def parse_record(raw: bytes) -> dict:
    """Headers of a record, its payload (None of a revisit), the payload's full size and its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != headers["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length:"))
    number = lambda name: int(v) if (v := headers.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload {headers['WARC-Record-ID']}")
    return {"page_id": number("WARC-Record-ID"), "url": headers["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload": payload if kind == "response" else None}


# --- archives --------------------------------------------------------------------------------------


class ArchiveWriter:
    """A ZIP file that grows record by record; the index is kept until the end (one short line for each record)."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file = store.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at, self.lines, self.path = 0, [], path

    def add(self, page_id, url: str | None, raw: bytes) -> None:
        press = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = press.compress(raw) + press.flush()
        self.member.write(packed)
        self.lines.append(json.dumps({"id": page_id, "url": url, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> int:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        self.zip.close()
        self.file.close()
        return len(self.lines)


class ArchiveReader:
    """Seeks in a ZIP file: ``members`` is its directory, ``read`` a range of a stored member."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        tail_at = max(0, self.size - 22 - 0xFFFF)
        tail = self._at(tail_at, self.size - tail_at)
        end = tail.rfind(_END)
        if end < 0:
            raise ValueError("no end of central directory")
        entries, length, start = struct.unpack("<10xHII", tail[end : end + 20])
        if entries == 0xFFFF or _MAX32 in (length, start) or tail[max(0, end - 20) : end].startswith(_LOCATOR64):
            where = struct.unpack("<8xQ", tail[end - 20 : end - 4])[0] if tail[end - 20 : end - 16] == _LOCATOR64 else None
            if where is not None:
                large = self._at(where, 56)
                if large[:4] != _END64:
                    raise ValueError("damaged ZIP64 end record")
                entries, length, start = struct.unpack("<32xQQQ", large)
        self.members = self._directory(self._at(start, length), entries)

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        got = self.file.read(length)
        if len(got) != length:
            raise ValueError("archive is cut short")
        return got

    @staticmethod
    def _directory(raw: bytes, entries: int) -> dict[str, tuple[int, int, int]]:
        """Name: method, size as stored, place of the local header."""
        out, at = {}, 0
        for _ in range(entries):
            if raw[at : at + 4] != _ENTRY:
                raise ValueError("damaged central directory")
            method, stored, size, n_name, n_extra, n_note, local = struct.unpack("<10xH8xIIHHH8xI", raw[at : at + 46])
            name = raw[at + 46 : at + 46 + n_name].decode()
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack("<HH", extra[:4])
                if kind == 1:  # ZIP64: what doesn't fit above, in this order
                    wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                    size = next(wide) if size == _MAX32 else size
                    stored = next(wide) if stored == _MAX32 else stored
                    local = next(wide) if local == _MAX32 else local
                extra = extra[4 + n :]
            out[name] = (method, stored, local)
            at += 46 + n_name + n_extra + n_note
        return out

    def start(self, name: str) -> tuple[int, int]:
        """Place and size of a stored member's bytes."""
        method, stored, local = self.members[name]
        if method != 0:
            raise ValueError(f"{name} isn't stored")
        head = self._at(local, 30)
        if head[:4] != _LOCAL:
            raise ValueError("damaged local header")
        n_name, n_extra = struct.unpack("<26xHH", head)
        return local + 30 + n_name + n_extra, stored

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        begin, stored = self.start(name)
        length = stored - offset if length is None else length
        if offset < 0 or offset + length > stored:
            raise ValueError("range is outside the member")
        return self._at(begin + offset, length)


# --- Spark jobs ------------------------------------------------------------------------------------


def classified(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, refers_to``; a row for each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    repeated = rows.filter(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("d"), "first_id")
    # as a table, so that Spark may split the largest groups of copies when it joins
    first = stash(repeated, "repeated")
    return rows.join(first, F.col("digest") == F.col("d"), "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame) -> DataFrame:
    """Writes all records; ``path, n_records`` of each archive that counts."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        writer = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": pa.array([writer.path.rpartition("/")[2]]), "n_records": pa.array([writer.close()], pa.int64())})

        for batch in batches:
            for page_id, url, html, digest, refers in zip(*batch.columns, strict=True):
                writer = writer or ArchiveWriter(store, f"{root}/{uuid.uuid4().hex}.zip")
                writer.add(page_id.as_py(), url.as_py(), record(page_id.as_py(), url.as_py(), html.as_py().encode("utf-8", "replace"), digest.as_py(), refers.as_py()))
                if writer.at >= ARCHIVE_BYTES:
                    yield done()
                    writer = None
        if writer:
            yield done()

    written = stash(classified(pages).mapInArrow(run, "path string, n_records long"), "archives")
    return written.withColumn("folder", F.lit(folder))


def _open(folder: str, name: str):
    store, root = fs.FileSystem.from_uri(folder)
    return ArchiveReader(store.open_input_file(f"{root}/{name}"))


def index(archives: DataFrame) -> DataFrame:
    """``folder, path, offset, lengths``: runs of neighbouring records to read at once, from the archives' indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lines = [json.loads(x) for x in _open(row["folder"], row["path"]).read(INDEX).decode().split("\n") if x]
                if len(lines) != row["n_records"]:
                    raise ValueError(f"{row['path']} has {len(lines)} records, not {row['n_records']}")
                offsets, lengths = [], []
                for line in lines:
                    if not lengths or sum(lengths[-1]) >= RANGE_BYTES or len(lengths[-1]) >= 2000:
                        offsets.append(line["offset"])
                        lengths.append([])
                    lengths[-1].append(line["length"])
                n = len(offsets)
                yield pa.RecordBatch.from_pydict({"folder": pa.array([row["folder"]] * n, pa.string()), "path": pa.array([row["path"]] * n, pa.string()), "offset": pa.array(offsets, pa.int64()), "lengths": pa.array(lengths, pa.list_(pa.int64()))})

    return archives.select("folder", "path", "n_records").mapInArrow(run, "folder string, path string, offset long, lengths array<bigint>")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]`` of every record."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    if not with_payload:
        del kinds["payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = _open(row["folder"], row["path"]).read(DATA, row["offset"], sum(row["lengths"]))
                rows, at = [], 0
                for n in row["lengths"]:
                    rows.append(parse_record(zlib.decompress(raw[at : at + n], 31)))
                    at += n
                yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()})

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")
    # a range is a small row that stands for megabytes: their number decides the tasks, not their size as rows
    ranges = stash(index(archives), "ranges")
    count = ranges.count()
    tasks = max(-(-count // TASK_RANGES), min(count, 2 * archives.sparkSession.sparkContext.defaultParallelism), 1)
    return ranges.repartition(tasks, "path", "offset").mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame, with_payload: bool = False) -> DataFrame:
    return read_archives(write_archives(pages), with_payload)
