"""WARC records in ZIP-packaged archives: writer, and a reader that range-reads records in place.

An archive is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz`` (one gzip
member for each record) and ``indexes/index.cdxj`` (a line for each record: key, offset, length). The
reader finds members through the end-of-central-directory record, the ZIP64 locator and record, and
the central directory; it then reads the index and each record's byte range. Nothing is extracted.

Edge cases: null html is an empty payload; a null page_id is written as an empty id and read back as
null; rows with the same page_id are separate records; an empty table gives no archive and no rows;
other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, parts, shared_dir, table, tidy

MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads shorter than this are always whole responses.
LEAST_DEDUP_BYTES = 100
#: An archive is closed, and another begun, after so many bytes of records.
ARCHIVE_BYTES = 1 << 30
#: The index is kept in memory until its archive is closed: so many records at most.
ARCHIVE_RECORDS = 500_000
#: Digests with more than a so-manieth of all rows are joined by broadcast: there are fewer than so many.
HOT_SHARE = 1000
DATE = "2020-01-01T00:00:00Z"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


# ---- records


def record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


# ---- ZIP


def _extra64(size: int, offset: int | None) -> bytes:
    values = [size, size] + ([] if offset is None else [offset])
    return struct.pack(f"<HH{len(values)}Q", 1, 8 * len(values), *values)


class ZipWriter:
    """Writes stored members one after the other; ZIP64 fields where sizes need them, or always with zip64=True."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """The size is not known yet, so it follows the member in a ZIP64 data descriptor."""
        raw = name.encode()
        self.current = [raw, self.at, 0, 0]
        self._put(struct.pack("<4s5H3L2H", b"PK\3\4", 45, 0x0808, 0, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 20) + raw + _extra64(0, None))

    def write(self, data: bytes) -> int:
        at = self.current[2]
        self.current[2] += len(data)
        self.current[3] = zlib.crc32(data, self.current[3])
        self._put(data)
        return at

    def end(self) -> None:
        _, _, size, crc = self.current
        self._put(struct.pack("<4sLQQ", b"PK\7\10", crc, size, size))
        self.members.append(self.current)

    def close(self) -> None:
        start = self.at
        for raw, at, size, crc in self.members:
            big = self.zip64 or size >= 0xFFFFFFFF or at >= 0xFFFFFFFF
            extra = _extra64(size, at) if big else b""
            low = (0xFFFFFFFF,) * 3 if big else (size, size, at)
            self._put(struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45, 0x0808, 0, 0, 0x21, crc, low[0], low[1], len(raw), len(extra), 0, 0, 0, 0, low[2]) + raw + extra)
        size, n = self.at - start, len(self.members)
        if big := self.zip64 or self.at >= 0xFFFFFFFF or n >= 0xFFFF:
            end64 = self.at
            self._put(struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<4sLQL", b"PK\6\7", 0, end64, 1))
        self._put(struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, 0xFFFF if big else n, 0xFFFF if big else n, 0xFFFFFFFF if big else size, 0xFFFFFFFF if big else start, 0))


class ZipReader:
    """Stored members of a ZIP file, by byte ranges of an open random-access file."""

    def __init__(self, file):
        self.file, self.members, self.ranges = file, {}, {}
        size = file.size()
        tail_at = max(0, size - 65_557)  # the end record and its longest comment
        tail = self._read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\5\6")
        if at < 0:
            raise ValueError("no end-of-central-directory record")
        n, length, start = struct.unpack_from("<H2L", tail, at + 10)
        if n == 0xFFFF or 0xFFFFFFFF in (length, start):
            locator = self._read(tail_at + at - 20, 20)
            if locator[:4] != b"PK\6\7":
                raise ValueError("no ZIP64 locator")
            end64 = self._read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end-of-central-directory record")
            n, length, start = struct.unpack_from("<3Q", end64, 32)
        directory, i = self._read(start, length), 0
        for _ in range(n):
            if directory[i : i + 4] != b"PK\1\2":
                raise ValueError("damaged central directory")
            method, = struct.unpack_from("<H", directory, i + 10)
            packed, whole = struct.unpack_from("<2L", directory, i + 20)
            names, extras, comments = struct.unpack_from("<3H", directory, i + 28)
            at, = struct.unpack_from("<L", directory, i + 42)
            name = directory[i + 46 : i + 46 + names].decode()
            extra = directory[i + 46 + names : i + 46 + names + extras]
            while len(extra) >= 4:
                tag, step = struct.unpack_from("<HH", extra)
                if tag == 1:  # has a value for each field that is all ones, in this order
                    values = iter(struct.unpack_from(f"<{step // 8}Q", extra, 4))
                    whole = next(values) if whole == 0xFFFFFFFF else whole
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    at = next(values) if at == 0xFFFFFFFF else at
                extra = extra[4 + step :]
            if method:
                raise ValueError(f"member {name} is compressed, not stored")
            self.members[name] = (at, packed)
            i += 46 + names + extras + comments

    def _read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def range(self, name: str) -> tuple[int, int]:
        """First byte and length of a member's data."""
        if name not in self.ranges:
            at, size = self.members[name]
            head = self._read(at, 30)
            if head[:4] != b"PK\3\4":
                raise ValueError("damaged member header")
            names, extras = struct.unpack_from("<2H", head, 26)
            self.ranges[name] = at + 30 + names + extras, size
        return self.ranges[name]

    def read(self, name: str, at: int = 0, length: int | None = None) -> bytes:
        first, size = self.range(name)
        length = size - at if length is None else length
        if at + length > size:
            raise ValueError("range beyond the member")
        return self._read(first + at, length)


# ---- Spark


def _writer(folder: str, archive_bytes: int, zip64: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        partition, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        store, root = open_fs(folder)
        store.create_dir(root, recursive=True)
        made, zipped = 0, None

        def close():
            nonlocal zipped
            zipped.end()
            zipped.begin(INDEX)
            lines = b""
            for key, at, length in index:
                lines += f"{key} {DATE} {json.dumps({'offset': at, 'length': length, 'filename': MEMBER})}\n".encode()
                if len(lines) > 1 << 16:
                    zipped.write(lines)
                    lines = b""
            zipped.write(lines)
            zipped.end()
            zipped.close()
            zipped.out.close()
            store.move(part, name)  # a later attempt writes the same rows: either file is right
            zipped = None
            return pa.RecordBatch.from_pydict({"archive": [name], "n_records": [len(index)]}, schema=schema)

        schema = pa.schema([("archive", pa.string()), ("n_records", pa.int64())])
        for batch in batches:
            for page_id, url, html, digest, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first")), strict=True):
                if zipped is None:
                    name = f"{root}/part-{partition:06d}-{made:04d}-{attempt}.wacz"
                    part, index, made = f"{name}.{os.getpid()}.tmp", [], made + 1
                    zipped = ZipWriter(store.open_output_stream(part), zip64)
                    zipped.begin(MEMBER)
                payload = (html or "").encode()
                key = "" if page_id is None else str(page_id)
                uri = "".join(c if c > " " else "%20" for c in url or "")
                raw = record("revisit" if first is not None else "response", key, uri, payload, digest, None if first is None else str(first))
                squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = squeeze.compress(raw) + squeeze.flush()
                index.append((key or "-", zipped.write(packed), len(packed)))
                if zipped.current[2] >= archive_bytes or len(index) >= ARCHIVE_RECORDS:
                    yield close()
        if zipped is not None:
            yield close()

    return write


RECORDS = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, archive string, offset long, length long"


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row for each WARC record of the archives named in column `archive`. A revisit has no payload; its
    digest and length are those of the full payload that its headers state. A response's are computed from the bytes read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                store, path = open_fs(name)
                with store.open_input_file(path) as file:
                    zipped = ZipReader(file)
                    rows, held = [], 0
                    for line in zipped.read(INDEX).splitlines():
                        spot = json.loads(line.split(b" ", 2)[2])
                        headers, payload = parse(zlib.decompress(zipped.read(spot["filename"], spot["offset"], spot["length"]), 31))
                        kind, own = headers["warc-type"], headers["warc-record-id"][10:-1]
                        if kind == "response":
                            digest, n = hashlib.sha256(payload).hexdigest(), len(payload)
                        else:
                            digest, n = headers["warc-payload-digest"].partition(":")[2], int(headers["x-payload-length"])
                        refers = headers.get("warc-refers-to", "")[10:-1]
                        rows.append((int(own) if own else None, kind, int(refers) if refers else None, digest, n, payload if with_payload and kind == "response" else None, name, spot["offset"], spot["length"]))
                        held += len(payload)
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield _rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows)

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES, strict=True)], names=NAMES)

    names, kinds = [x.split()[0] for x in RECORDS.split(", ")], [x.split()[1] for x in RECORDS.split(", ")]
    NAMES, TYPES = names, [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k] for k in kinds]
    return archives.select("archive").mapInArrow(tidy(read), RECORDS)


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_DEDUP_BYTES, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> DataFrame:
    """Writes a record for each row of pages(page_id, url, html) and returns the archives' names, lazily: they are
    written when the result is used, a name for each attempt, so that a task that runs again harms none.

    Of records with equal payloads of at least `least` bytes, that with the smallest page_id is a response,
    the others are revisits of it; rows that repeat both page_id and payload are responses all. Equal payloads are found by
    SHA-256 with a grouped minimum, so a payload that a third of all rows share is reduced before it is shuffled. Digests of
    more than a HOT_SHARE-th of all rows, of which there are fewer than HOT_SHARE, are broadcast with their first ids, so
    that their pages stay where they are; the others meet theirs by digest.
    """
    pages = pages.select("page_id", "url", "html")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    firsts = keyed.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    firsts = cut(firsts)
    hot_rows = pages.count() // HOT_SHARE
    hot = F.broadcast(firsts.where(F.col("copies") > hot_rows).select("digest", "first"))
    whole = pages.withColumn("digest", F.sha2(payload, 256))
    there = whole.join(hot, "digest")
    others = whole.join(hot, "digest", "left_anti").join(firsts.where(F.col("copies") <= hot_rows).select("digest", "first"), "digest", "left")
    joined = others.unionByName(there).withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    return joined.select("page_id", "url", "html", "digest", "first").mapInArrow(tidy(_writer(folder, archive_bytes, zip64)), "archive string, n_records long")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/wacz-{uuid.uuid4().hex}"
    # The names are dealt anew, so that a task has one Python worker, to write or to read, and reading is even.
    archives = write_archives(table(spark, sf_dir, "pages"), folder).repartition(parts(spark))
    return read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest AS d, min(page_id) AS first_id FROM q WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM q LEFT JOIN f ON payload_digest = d
"""
