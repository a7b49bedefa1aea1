"""WARC records in ZIP packages, written and read back without extraction.

An archive is a ZIP file with two stored members: ``archive/data.warc.gz`` (one gzip
member a record) and ``indexes/index.cdx`` (a line a record: URI, offset, length). The
reader parses the end-of-directory record, its ZIP64 forms and the central directory,
finds the stored members' bytes, reads the index, and range-reads records from the
archive itself. One task locates, then the records are dealt evenly over all tasks.

Archives lie in the shared folder and are opened through Arrow's file systems.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.llm.common import read_table, stage_table
from shopflow.session import scratch_path, ship_package

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
ARCHIVE_BYTES = 256 << 20  # an archive is closed and the next begun beyond this
ARCHIVE_RECORDS = 200_000  # or this, which bounds the index a task holds
READ_BYTES = 4 << 20  # neighbouring records are read together up to this
MIN_REVISIT_BYTES = 0


# ---- records

def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 response, or a revisit that names the response with the same payload."""
    head = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    block = head if revisit else head + payload
    uri = "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
             f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names) and payload of one WARC record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[:int(headers["content-length"])]
    return {"headers": headers, "payload": block.partition(b"\r\n\r\n")[2]}


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


# ---- writing

def roles(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, first_id, revisit): of pages with equal payloads of at least
    ``min_bytes``, the smallest page_id is the response and the others revisit it.

    The first of each payload is a grouped minimum, combined per task, so a payload of a
    third of all pages is one row a task; the join back is an ordinary one that Spark
    splits where a payload is hot."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("sha", F.sha1("payload"))
    firsts = own.groupBy("sha").agg(F.min("page_id").alias("first_id"))
    revisit = (F.octet_length("payload") >= min_bytes) & F.coalesce(F.col("page_id") != F.col("first_id"),
                                                                   F.col("first_id").isNotNull())
    return own.join(firsts, "sha").select("page_id", "url", "payload", "first_id", revisit.alias("revisit"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the records of ``roles()`` and return (path, records, bytes), one row an
    archive. File names are new for each attempt of a task; only those of attempts that
    Spark accepted are in the returned (staged) manifest."""
    ship_package(rows.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        zipped = member = None
        index: list[str] = []
        at = 0

        def close() -> pa.RecordBatch:
            member.close()
            zipped.writestr(zipfile.ZipInfo(INDEX), "".join(index))
            zipped.close()
            out.close()
            done = [[f"{folder}/{name}"], [len(index)], [at]]
            return pa.RecordBatch.from_arrays([pa.array(done[0]), pa.array(done[1], pa.int64()),
                                               pa.array(done[2], pa.int64())], ["path", "records", "bytes"])

        for b in batches:
            for i in range(b.num_rows):
                page_id, url, payload, first, revisit = (b.column(c)[i].as_py() for c in range(5))
                if zipped is None:
                    name, index, at = f"{uuid.uuid4().hex}.wacz", [], 0
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", buffer_size=1 << 20)
                    zipped = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                    member = zipped.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = packer.compress(warc_record(page_id, url, payload, first, revisit)) + packer.flush()
                member.write(packed)
                index.append(f"{'' if page_id is None else page_id} {at} {len(packed)}\n")
                at += len(packed)
                if at >= ARCHIVE_BYTES or len(index) >= ARCHIVE_RECORDS:
                    yield close()
                    zipped = None
        if zipped is not None:
            yield close()

    return stage_table(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


# ---- reading

def read_directory(f, size: int) -> dict[str, dict]:
    """The members of a ZIP file: name -> method, packed size, size, offset of the data.
    ``f`` has read_at(length, offset); only the directories and local headers are read."""
    tail = f.read_at(min(size, 22 + 65535), max(0, size - 22 - 65535))
    base = size - len(tail)
    end = next((i for i in range(len(tail) - 22, -1, -1) if tail[i:i + 4] == b"PK\x05\x06"
                and i + 22 + struct.unpack_from("<H", tail, i + 20)[0] == len(tail)), -1)
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:  # the ZIP64 record holds them
        locator = f.read_at(20, base + end - 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        at = struct.unpack_from("<Q", locator, 8)[0]
        record = f.read_at(56, at)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of the central directory")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, members, at = f.read_at(length, start), {}, 0
    for _ in range(count):
        if directory[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, plain, n, m, k = struct.unpack_from("<IIHHH", directory, at + 20)
        offset, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46:at + 46 + n].decode("utf-8", "replace")
        extra, e = directory[at + 46 + n:at + 46 + n + m], 0
        while e + 4 <= len(extra):
            tag, width = struct.unpack_from("<HH", extra, e)
            if tag == 1:  # only the values that don't fit, in this order
                wide, w = extra[e + 4:e + 4 + width], 0
                if plain == 0xFFFFFFFF:
                    plain, w = struct.unpack_from("<Q", wide, w)[0], w + 8
                if packed == 0xFFFFFFFF:
                    packed, w = struct.unpack_from("<Q", wide, w)[0], w + 8
                if offset == 0xFFFFFFFF:
                    offset = struct.unpack_from("<Q", wide, w)[0]
            e += 4 + width
        local = f.read_at(30, offset)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        data = offset + 30 + sum(struct.unpack_from("<HH", local, 26))
        members[name] = {"method": method, "packed": packed, "size": plain, "data": data}
        at += 46 + n + m + k
    return members


def locate(archives: DataFrame) -> DataFrame:
    """(path, offset, length) of every record of the archives in column ``path``, from
    their directories and indexes. The offset is in the archive file itself."""
    ship_package(archives.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, p = pa.fs.FileSystem.from_uri(path)
                with fs.open_input_file(p) as f:
                    members = read_directory(f, f.size())
                    data, index = members[DATA], members[INDEX]
                    if data["method"] or index["method"]:
                        raise ValueError(f"{path}: members must be stored")
                    lines = f.read_at(index["size"], index["data"]).splitlines()
                spots = [line.rsplit(b" ", 2) for line in lines]
                for lo in range(0, len(spots), 50_000):
                    part = spots[lo:lo + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(part)), pa.array([data["data"] + int(s[1]) for s in part], pa.int64()),
                         pa.array([int(s[2]) for s in part], pa.int64())], ["path", "offset", "length"])

    return archives.select("path").mapInArrow(find, "path string, offset long, length long")


def read_records(spots: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record at (path, offset, length): page_id, url, payload_bytes,
    payload_digest, record_type, refers_to (and payload). Neighbouring records are read
    together; a response whose payload doesn't have its digest is an error."""
    ship_package(spots.sparkSession)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    schema = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
              "refers_to long" + ", payload binary" * with_payload)

    def parsed(raw: bytes) -> tuple:
        r = parse_record(zlib.decompress(raw, 31))
        h, payload = r["headers"], r["payload"]
        digest = h["warc-payload-digest"].removeprefix("sha1:")
        if h["warc-type"] == "response" and payload_digest(payload) != digest:
            raise ValueError(f"{h['warc-record-id']}: the payload has another digest")
        return (_page(h["warc-record-id"]), h["warc-target-uri"], int(h["x-payload-length"]), digest,
                h["warc-type"], _page(h.get("warc-refers-to")), payload)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = f = None
        for b in batches:
            spots, i = list(zip(*(c.to_pylist() for c in b.columns))), 0
            while i < len(spots):
                path, start, n = spots[i]
                k, end = i + 1, start + n
                while k < len(spots) and spots[k][:2] == (path, end) and end + spots[k][2] - start <= READ_BYTES:
                    end += spots[k][2]
                    k += 1
                if path != opened:
                    fs, p = pa.fs.FileSystem.from_uri(path)
                    opened, f = path, fs.open_input_file(p)
                block = memoryview(f.read_at(end - start, start))
                rows = list(zip(*(parsed(block[o - start:o - start + m]) for _, o, m in spots[i:k])))
                cols = [pa.array(c, t) for c, t in zip(rows, kinds)]
                yield pa.RecordBatch.from_arrays(
                    cols + [pa.array(rows[6], pa.binary())] * with_payload, names + ["payload"] * with_payload)
                i = k

    n = int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spots.repartitionByRange(n, "path", "offset").sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(read, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` to archives in ``folder`` (default: a new one in
    the shared folder) and read all of them back.

    Null html is an empty payload; empty payloads are equal like any others. Repeated rows
    are written repeatedly; those with the smallest page_id of a payload are all responses.
    A null page_id is never the one referred to, and is a response only where its payload
    has no other page. Other columns are ignored; an empty table gives no archives."""
    folder = folder or scratch_path(pages.sparkSession, f"warc-{uuid.uuid4().hex}")
    return read_records(locate(write_archives(roles(pages, min_bytes), folder)))


def op8_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records in ZIP packages and read back."""
    return archive_pages(read_table(spark, sf_dir, "pages")).drop("url")
