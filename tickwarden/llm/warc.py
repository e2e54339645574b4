"""Web archives in ZIP packages: WARC records, an index, range reads.

A package is a ZIP file with two stored members: ``archive/data.warc.gz``
(WARC 1.1, one gzip member per record) and ``indexes/index.cdxj`` (a
line of JSON per record with its offset and length in the archive
member).  The writer streams a package per task and rolls to a new one
at ``records_per_package``; the reader parses the central directory (and
ZIP64 records), locates the stored archive members (``archive/*.warc`` and
``archive/*.warc.gz``) and the index members (``indexes/*.cdxj``, ``.cdx``,
plain or ``.gz``), and fetches runs of records by byte range; nothing is
extracted.  A member that no index names is walked for its records'
ranges.  Records other than ``response`` and ``revisit`` are passed over;
record ids that are no page ids are kept as text.

Records with equal payloads are written once: the one with the smallest
page_id is a ``response``, the others are ``revisit`` records that name
it; ``min_revisit_bytes`` keeps smaller payloads as responses.  Equality
is that of the SHA-1.

Distribution: the smallest ids per digest are a combined aggregation;
only digests held more than once are joined back, which AQE splits if a
third of the pages share one payload.  Reading is dealt by record runs
of about ``run_bytes``.

Defined cases: a null payload is written empty; a null url is written as
the record's own id; line breaks and other control characters in urls
are percent-encoded.  Rows that share payload *and* smallest page_id are
all responses.  A null page_id is written and read back as null; it
never is the smallest, and a payload held by null ids only is a response
each time.  An empty table writes nothing and reads no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwarden.llm.common import RangeReader, SharedFile, batches, column, prepare, stored
from tickwarden.llm.zipstore import StoredZipWriter, content_start, read_directory
from tickwarden.session import scratch_path

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RECORDS_PER_PACKAGE = 50_000
RUN_BYTES = 4 << 20
DATE = "2000-01-01T00:00:00Z"
LEVEL = 6

PACKAGES = pa.schema([("package", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
RUNS = pa.schema(
    [("package", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("lengths", pa.list_(pa.int64())),
     ("packed", pa.bool_())]
)
RUNS_DDL = "package string, start bigint, length bigint, lengths array<bigint>, packed boolean"
RECORDS = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()),
     ("refers_to_id", pa.string()), ("payload", pa.binary()), ("package", pa.string())]
)
RECORDS_DDL = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
               "refers_to bigint, record_id string, refers_to_id string, payload binary, package string")


def _digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _urn(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def _page(urn: str) -> int | None:
    """The page id of a record id (null: another kind of id)."""
    tail = urn.strip("<>").removeprefix("urn:page:")
    return int(tail) if re.fullmatch("-?[0-9]+", tail) else None


def _uri(url: str | None, page_id: int | None) -> str:
    if not url:
        return _urn(page_id)
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> tuple[bytes, dict]:
    """A record as a gzip member, and its index entry."""
    kind = "response" if refers_to is None else "revisit"
    digest = _digest_text(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    uri = _uri(url, page_id)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_urn(page_id)}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{_urn(refers_to)}>",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush(), {"url": uri, "digest": digest, "type": kind}


class WarcError(ValueError):
    """A record that does not read back as written."""


def _headers(data: bytes, at: int = 0) -> tuple[str, dict[str, str], int]:
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise WarcError("headers do not end")
    first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def parse_record(raw: bytes, with_payload: bool = False) -> tuple | None:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    record_id, refers_to_id, payload) of an uncompressed record, none for one
    that is neither response nor revisit; a response's SHA-1 is checked where
    it is given."""
    version, head, at = _headers(raw)
    if not version.startswith("WARC/"):
        raise WarcError("not a WARC record")
    kind = head.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    block = raw[at : at + int(head["content-length"])]
    http, body = {}, 0
    if b"\r\n\r\n" in block:  # a revisit may come without the HTTP headers
        _, http, body = _headers(block)
    given = head.get("warc-payload-digest", "")
    digest = given.removeprefix("sha1:") if given.startswith("sha1:") else None
    length = http.get("content-length")
    own, refers = head["warc-record-id"].strip("<>"), head.get("warc-refers-to", "").strip("<>") or None
    payload, size = None, int(length) if length else 0
    if kind == "response":
        payload, size = block[body:], len(block) - body
        found = _digest_text(hashlib.sha1(payload).digest())
        if digest not in (None, found) or (length and int(length) != size):
            raise WarcError(f"payload of {own} differs from its digest")
        digest, refers = found, None
    uri = head.get("warc-target-uri")
    return (_page(own), None if uri == own else uri, size, digest, kind, _page(refers or ""), own, refers,
            payload if with_payload else None)


def revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, head): head is the page_id that the record
    revisits, null for a response."""
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    page = F.col("page_id").cast("bigint").alias("page_id")
    rows = pages.select(page, F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    heads = pages.select(page, F.sha1(payload).alias("same"), F.octet_length(payload).alias("size"))
    heads = heads.where(F.col("size") >= min_revisit_bytes).groupBy("same").agg(
        F.min("page_id").alias("head"), F.count(F.lit(1)).alias("n")
    )
    heads = stored(heads.where("n > 1 and head is not null").select("same", "head"), "warc-heads")
    joined = rows.join(heads, rows["digest"] == heads["same"], "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("head"))
    return joined.select("page_id", "url", "payload", F.when(F.col("head").isNotNull() & other, F.col("head")).alias("head"))


def write_packages(
    pages: DataFrame, folder: str, min_revisit_bytes: int = 0, records_per_package: int = RECORDS_PER_PACKAGE,
    zip64: bool = False,
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as packages; returns their names
    (package, records, bytes)."""
    prepare(pages.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # named by attempt: only the packages of the attempt that counts are listed
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        state: dict = {"made": 0, "zip": None}

        def begin() -> None:
            state["name"] = f"{task:06d}-{state['made']:04d}-{attempt}.wacz"
            state["file"] = SharedFile(folder, state["name"])
            state["zip"] = StoredZipWriter(state["file"], zip64)
            state["zip"].begin(ARCHIVE)
            state["index"] = []
            state["made"] += 1

        def finish() -> tuple:
            package = state["zip"]
            package.end()
            package.add(INDEX, "".join(state["index"]).encode())
            package.finish()
            state["file"].close()
            state["zip"] = None
            return state["name"], len(state["index"]), state["file"].size

        def rows():
            for batch in parts:
                for page, url, payload, head in zip(*(column(batch, c) for c in ("page_id", "url", "payload", "head"))):
                    if state["zip"] is None:
                        begin()
                    data, entry = record(page, url, payload, head)
                    entry |= {"offset": str(state["zip"].written), "length": str(len(data)), "filename": ARCHIVE}
                    state["index"].append(f"{entry['url']} {DATE[:4]} {json.dumps(entry)}\n")
                    state["zip"].write(data)
                    if len(state["index"]) >= records_per_package:
                        yield finish()
            if state["zip"] is not None:
                yield finish()

        yield from batches(rows(), PACKAGES, 1)

    marked = revisits(pages, min_revisit_bytes)
    return stored(marked.mapInArrow(run, "package string, records bigint, bytes bigint"), "warc-packages")


# the fields of a CDX line without a header: the usual eleven
CDX_FIELDS = "N b a m s k r M S V g"


def index_entries(name: str, data: bytes) -> Iterator[tuple[str, int, int]]:
    """(file name, offset, length) of the records that an index lists."""
    if name.endswith(".gz"):
        data = b"".join(_unpacked(data))
    fields = CDX_FIELDS.split()
    for line in data.decode("utf-8", "replace").split("\n"):
        if line.startswith(" CDX "):
            fields = line.split()[1:]
        elif " {" in line:  # the key and the time hold no blank
            entry = json.loads(line[line.index(" {") + 1 :])
            yield entry["filename"], int(entry["offset"]), int(entry["length"])
        elif line.strip() and not line.startswith("!"):
            entry = dict(zip(fields, line.split()))
            yield entry["g"], int(entry["V"]), int(entry["S"])


def _unpacked(data: bytes) -> Iterator[bytes]:
    """The contents of gzip members one after the other."""
    while data:
        one = zlib.decompressobj(31)
        yield one.decompress(data) + one.flush()
        data = one.unused_data


def walk(read, start: int, size: int, packed: bool, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(offset, length) of a member's records, without an index."""
    at, stop = start, start + size
    while at < stop:
        length = 0
        if packed:
            one = zlib.decompressobj(31)
            while not one.eof and at + length < stop:
                data = read(at + length, min(step, stop - at - length))
                one.decompress(data)
                length += len(data)
            length -= len(one.unused_data)
        else:
            head, width = b"", 1 << 14
            while b"\r\n\r\n" not in head and len(head) < stop - at:
                head, width = read(at, min(width, stop - at)), 4 * width
            _, fields, body = _headers(head)
            length = body + int(fields["content-length"]) + 4
        yield at, length
        at += length


def _ranges(read, size: int, package: str) -> Iterator[tuple[int, int, bool]]:
    """(offset, length, whether gzipped) of a package's records, in order."""
    members = read_directory(read, size)
    archives = {n: m for n, m in members.items() if n.startswith("archive/") and n.endswith((".warc", ".warc.gz"))}
    base = {n: content_start(read, m) for n, m in archives.items()}
    named = {n.removeprefix("archive/"): n for n in archives} | {n: n for n in archives}
    listed: dict[str, set[tuple[int, int]]] = {n: set() for n in archives}
    for name, m in members.items():
        if name.startswith("indexes/") and name.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")):
            data = read(content_start(read, m), m.size)
            if zlib.crc32(data) != m.crc32:
                raise WarcError(f"{package}: the index {name} differs from its checksum")
            for file, offset, length in index_entries(name, data):
                if file not in named:
                    raise WarcError(f"{package}: the index names {file}, which is no stored archive")
                listed[named[file]].add((offset, length))
    for n, m in sorted(archives.items()):
        packed = n.endswith(".gz")
        found = sorted((base[n] + a, length) for a, length in listed[n]) or walk(read, base[n], m.size, packed)
        for at, length in found:
            yield at, length, packed


def index_runs(packages: DataFrame, folder: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Runs of records as byte ranges of the packages, from their central
    directories and indexes: (package, start, length, lengths, packed)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in parts:
                for name in column(batch, "package"):
                    start, lengths, total, kind = 0, [], 0, True
                    with RangeReader(folder, name) as file:
                        for at, length, packed in _ranges(file.read, file.size, name):
                            if lengths and (at != start + total or total + length > run_bytes or packed != kind):
                                yield name, start, total, lengths, kind
                                lengths, total = [], 0
                            if not lengths:
                                start, kind = at, packed
                            lengths.append(length)
                            total += length
                    if lengths:
                        yield name, start, total, lengths, kind

        yield from batches(rows(), RUNS, 64)

    prepare(packages.sparkSession)
    return packages.select("package").mapInArrow(run, RUNS_DDL)


def read_records(runs: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of runs of byte ranges, one row each."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in parts:
                for name, start, length, lengths, packed in zip(*(column(batch, c) for c in RUNS.names)):
                    with RangeReader(folder, name) as file:
                        data = file.read(start, length)
                    at = 0
                    for n in lengths:
                        raw = data[at : at + n]
                        at += n
                        found = parse_record(zlib.decompress(raw, 31) if packed else raw, with_payload)
                        if found is not None:
                            yield *found, name

        yield from batches(rows(), RECORDS, 512)

    prepare(runs.sparkSession)
    return runs.mapInArrow(run, RECORDS_DDL)


def read_packages(spark: SparkSession, packages: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the listed packages."""
    runs = index_runs(packages.repartition("package"), folder)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_records(runs.repartition(width, "package", "start"), folder, with_payload)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write packages below the shared folder and read them back (without payloads)."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    packages = write_packages(pages, folder, min_revisit_bytes)
    return read_packages(spark, packages, folder, with_payload=False).drop("payload")
