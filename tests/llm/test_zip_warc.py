import base64
import hashlib
import io
import zipfile

import pyarrow as pa
import pytest
from conftest_llm import SF, clash

from shopflow.llm import zip_warc as Z


def plain(rows, least=0):
    first = {}
    for i, h in rows:
        b = (h or "").encode()
        if i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, h in rows:
        b = (h or "").encode()
        again = len(b) >= least and b in first and first[b] != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response",
                    first[b] if again else None))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                   for r in Z.archive_pages(df, **kw).collect()), key=str)


@pytest.fixture
def pages(spark):
    given = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    edge = [(9000, None, None), (9001, "http://x/ \r\nEvil: 1", ""), (9002, "u", "WARC/1.1\r\n\r\n"), (8999, "u", given[0][2]),
            (9003, "é", "\r\n\r\n" * 1000), given[1], (None, "n", given[2][2]), (None, "n", "alone"), (9004, "u", "x" * 300000)]
    return spark.createDataFrame(given + edge, "page_id long, url string, html string")


def test_pages_and_edges(pages):
    rows = [(r.page_id, r.html) for r in pages.collect()]
    df = clash(pages, "payload", "sha", "first_id", "revisit", "path")
    assert run(df) == plain(rows)
    assert run(df, min_bytes=20) == plain(rows, 20)
    assert run(pages.limit(0)) == []


def test_payloads_come_back_and_archives_are_zips(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(Z, "ARCHIVE_RECORDS", 7)  # several archives a task (where tasks share this module)
    manifest = Z.write_archives(Z.roles(pages), f"file://{tmp_path}/w")
    got = {r.page_id: bytes(r.payload) for r in Z.read_records(Z.locate(manifest), True).collect()
           if r.record_type == "response" and r.page_id is not None}
    want = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    assert all(want[i] == p for i, p in got.items()) and len(got) > 40
    assert sum(r.records for r in manifest.collect()) == pages.count()
    for r in manifest.collect():
        with zipfile.ZipFile(r.path.removeprefix("file://")) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {0}


class Held:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at:at + n]


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 not the end" * 3])
def test_directories(monkeypatch, wide, comment):
    """ZIP and ZIP64 archives, with comments and extra fields, as another writer makes them."""
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    f = io.BytesIO(b"")
    f.write(b"junk before" * 0)
    with zipfile.ZipFile(f, "w", zipfile.ZIP_STORED) as z:
        for i in range(5):
            z.writestr(zipfile.ZipInfo(f"dir/é{i}"), bytes([i]) * (30 * i + 1))
        z.comment = comment
    data = f.getvalue()
    members = Z.read_directory(Held(data), len(data))
    assert {n: data[m["data"]:m["data"] + m["size"]] for n, m in members.items()} == {
        f"dir/é{i}": bytes([i]) * (30 * i + 1) for i in range(5)}
    with pytest.raises(ValueError):
        Z.read_directory(Held(data[:-30]), len(data) - 30)


def test_records_without_their_payload_are_errors():
    import zlib

    raw = Z.warc_record(1, "u", b"payload", None, False).replace(b"payload", b"paYload")
    assert Z.parse_record(raw)["payload"] == b"paYload"
    assert Z.payload_digest(b"payload") != Z.payload_digest(b"paYload")
    assert zlib.decompress(zlib.compress(raw)) == raw and pa.array([1]).to_pylist() == [1]
