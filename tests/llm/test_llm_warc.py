"""ZIP packages and WARC records."""

import gzip
import base64
import hashlib
import io
import zipfile

import pytest

from llm_rows import rows_of
from tickwarden.llm import warc
from tickwarden.llm.zipstore import StoredZipWriter, ZipStoreError, content_start, read_directory


def _reader(data):
    return (lambda at, n: data[at : at + n]), len(data)


@pytest.mark.parametrize("zip64", [False, True])
def test_archives_read_by_zipfile_and_by_ranges(zip64):
    out = io.BytesIO()
    z = StoredZipWriter(out, zip64)
    members = {"a/data.bin": b"hello" * 1000, "indexes/é.txt": b"", "z": b"PK\x05\x06 not an end record"}
    for name, data in members.items():
        z.add(name, data)
    z.finish()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as other:
        assert other.testzip() is None and {n: other.read(n) for n in other.namelist()} == members
    read, size = _reader(out.getvalue())
    found = read_directory(read, size)
    assert {n: read(content_start(read, m), m.size) for n, m in found.items()} == members


def test_reads_other_archives_with_comment_and_many_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(70_000):  # more than the classic end record can count
            z.writestr(f"{i}", b"")
        z.writestr("last", b"content")
        z.comment = b"a comment"
    read, size = _reader(out.getvalue())
    found = read_directory(read, size)
    assert len(found) == 70_001
    assert read(content_start(read, found["last"]), 7) == b"content"


def test_compressed_members_and_other_files_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"y" * 100)
    read, size = _reader(out.getvalue())
    with pytest.raises(ZipStoreError, match="compressed"):
        content_start(read, read_directory(read, size)["x"])
    with pytest.raises(ZipStoreError, match="no end record"):
        read_directory(*_reader(b"nothing"))


PAGES = "page_id bigint, url string, html string, digest string, head bigint"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 99) for r in rows], PAGES)


ODD = [
    (5, "http://a/x y\nz{", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "http://b", None), (8, "http://c", ""),
    (7, "http://d", "one\r\n\r\ntwo\x00"), (3, "http://e", "<p>é</p>"), (None, "http://f", "<p>é</p>"),
    (None, "u v", "alone"), (None, "g", "alone"), (12, "", "z" * 300_000), (13, "h", "z" * 300_000),
]


def expected(rows, least=0):
    groups = {}
    for page, _, html in rows:
        if page is not None:
            groups.setdefault(html or "", []).append(page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        head = min(groups.get(html or "", []), default=None)
        again = head is not None and page != head and len(raw) >= least
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page, len(raw), digest, "revisit" if again else "response", head if again else None))
    return sorted(out, key=str)


NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip_of_odd_pages(spark, least):
    assert rows_of(warc.round_trip(_pages(spark, ODD), least), *NAMES) == expected(ODD, least)


def test_empty_table(spark):
    assert warc.round_trip(_pages(spark, ODD).limit(0)).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_payloads_packages_and_runs(spark, tmp_path, zip64):
    pages = _pages(spark, ODD)
    folder = str(tmp_path)
    packages = warc.write_packages(pages, folder, records_per_package=3, zip64=zip64)
    assert packages.count() >= 4 and all(zipfile.is_zipfile(tmp_path / r.package) for r in packages.collect())
    runs = warc.index_runs(packages, folder, run_bytes=600)
    assert runs.count() > packages.count()
    got = {(r.page_id, r.payload_digest): bytes(r.payload) for r in warc.read_records(runs, folder).collect()
           if r.record_type == "response"}
    for page, _, html in ODD:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert got.get((page, digest), raw) == raw
    assert len(got) == 5


def test_damaged_records_are_noticed():
    data, _ = warc.record(1, "http://x", b"payload")
    import zlib

    raw = zlib.decompress(data, 31)
    assert warc.parse_record(raw, True)[-1] == b"payload"
    with pytest.raises(warc.WarcError, match="differs"):
        warc.parse_record(raw.replace(b"payload", b"pAyload"))
    with pytest.raises(warc.WarcError):
        warc.parse_record(b"HTTP/1.1 200\r\n\r\n")


# ------------------------------------------------- packages of other writers


def _record(kind, rid, payload=b"", refers=None, digest=True):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    block = {"response": http + payload, "revisit": http}.get(kind, b"software: some\r\n")
    head = [b"WARC/1.0", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <" + rid.encode() + b">",
            b"WARC-Target-URI: http://x/" + rid[-4:].encode()]
    if digest and kind in ("response", "revisit"):
        head.append(b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()))
    if refers:
        head.append(b"WARC-Refers-To: <" + refers.encode() + b">")
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _other_package(path, indexed):
    """Two archive members, gzipped and plain, with every kind of record."""
    ids = [f"urn:uuid:0000-{i:04d}" for i in range(8)]
    one = [_record("warcinfo", ids[0]), _record("request", ids[1]), _record("response", ids[2], b"<p>one</p>"),
           _record("metadata", ids[3]), _record("revisit", ids[4], b"<p>one</p>", ids[2])]
    two = [_record("warcinfo", ids[5]), _record("response", ids[6], b"\r\n\r\ntwo" * 9000, digest=False), _record("response", ids[7])]
    packed = [gzip.compress(r) for r in one]
    lines = {"indexes/index.cdxj": [], "indexes/other.cdx.gz": [" CDX N b a m s k r M S V g"]}
    at = 0
    for r, raw in zip(one, packed):
        if b"response" in r or b"revisit" in r:
            lines["indexes/index.cdxj"].insert(0, 'x,y 2020 {"filename": "a.warc.gz", "offset": "%d", "length": "%d"}' % (at, len(raw)))
        at += len(raw)
    at = 0
    for r in two:
        lines["indexes/other.cdx.gz"].append(f"k 2020 u text/html 200 d - - {len(r)} {at} b.warc")
        at += len(r)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as out:
        out.writestr("datapackage.json", "{}")
        out.writestr("archive/a.warc.gz", b"".join(packed))
        out.writestr("archive/b.warc", b"".join(two))
        for name, content in lines.items() if indexed else ():
            data = "\n".join(content).encode() + b"\n"
            out.writestr(name, gzip.compress(data) if name.endswith(".gz") else data)
    return ids


@pytest.mark.parametrize("indexed", [True, False])
def test_packages_of_other_writers(spark, tmp_path, indexed):
    ids = _other_package(tmp_path / "other.wacz", indexed)
    packages = spark.createDataFrame([("other.wacz",)], "package string")
    got = warc.read_packages(spark, packages, str(tmp_path))
    rows = {r.record_id: r for r in got.collect()}
    assert sorted(rows) == [ids[2], ids[4], ids[6], ids[7]]
    assert bytes(rows[ids[2]].payload) == b"<p>one</p>" and rows[ids[2]].page_id is None
    assert (rows[ids[4]].record_type, rows[ids[4]].refers_to_id, rows[ids[4]].payload) == ("revisit", ids[2], None)
    assert rows[ids[4]].payload_digest == rows[ids[2]].payload_digest
    assert bytes(rows[ids[6]].payload) == b"\r\n\r\ntwo" * 9000 and rows[ids[7]].payload_bytes == 0


def test_an_index_that_names_no_member_is_noticed(tmp_path):
    path = tmp_path / "bad.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as out:
        out.writestr("archive/a.warc", _record("response", "urn:uuid:1", b"x"))
        out.writestr("indexes/i.cdxj", 'k 1 {"filename": "c.warc", "offset": 0, "length": 1}\n')
    data = path.read_bytes()
    with pytest.raises(warc.WarcError):
        list(warc._ranges(lambda at, n: data[at : at + n], len(data), "bad"))
