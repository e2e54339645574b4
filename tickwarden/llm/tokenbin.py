"""Token-id files: documents in ascending doc_id order, Re-Pair compressed.

Documents are range-partitioned by doc_id and sorted; each task encodes
its range and writes shard files (see :mod:`tickwarden.llm.repair`) of
about ``shard_tokens`` ids.  Only the list of shards (a row per file)
comes back; a running total over it gives every shard the number of ids
before it.  Files are named by task attempt, and the list names the
files of the attempts that counted.

Defined cases: a null or empty text is a document of the end id alone;
null ids come first; rows of equal id follow each other in the order of
their texts; an empty table writes no file and reads no rows; other
columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwarden.llm.common import RangeReader, SharedFile, batches, column, prepare, stored, worker_task
from tickwarden.llm.repair import Shard, shard_bytes
from tickwarden.llm.tokens import END_ID, default_tokenizer, encoded, encoder
from tickwarden.session import scratch_path

SHARD_TOKENS = 2_000_000
RANGE_BYTES = 16 << 20  # of text for each task
READ_DOCS = 256
MEMO_PIECES = 800_000

SHARDS = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("documents", pa.int64()),
                    ("tokens", pa.int64()), ("bytes", pa.int64())])
SHARDS_DDL = "part int, number int, file string, documents bigint, tokens bigint, bytes bigint"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
DOCS_DDL = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def write_shards(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Write the shard files; returns their list in order (part, number)."""
    spark = docs.sparkSession
    prepare(spark)
    path = tokenizer or default_tokenizer()
    end = end_id.to_bytes(4, "little")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path, MEMO_PIECES)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]

        def write(number: int, ids: list, found: list[bytes]) -> tuple:
            lengths = [len(f) // 4 for f in found]
            data = shard_bytes(ids, lengths, b"".join(found), enc.size)
            name = f"{part:06d}-{number:04d}-{attempt}.ids"
            out = SharedFile(folder, name)
            out.write(data)
            out.close()
            return part, number, name, len(ids), sum(lengths), len(data)

        def rows():
            number, ids, found, size = 0, [], [], 0
            for doc, code in encoded(parts, enc):
                ids.append(doc)
                found.append(code + end)
                size += len(code) // 4 + 1
                if size >= shard_tokens:
                    yield write(number, ids, found)
                    number, ids, found, size = number + 1, [], [], 0
            if ids:
                yield write(number, ids, found)

        yield from batches(rows(), SHARDS, 1)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    ordered = slim.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(worker_task(run, pieces=True), SHARDS_DDL), "token-shards")


def with_offsets(shards: DataFrame, block: int = 1024) -> DataFrame:
    """The list with ``base``: ids of all shards before.  Totals run inside
    blocks of parts, then over the blocks, so no task sees a long list."""
    rows = shards.withColumn("block", F.floor(F.col("part") / block))
    before = Window.partitionBy("block").orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    totals = rows.groupBy("block").agg(F.sum("tokens").alias("total"))
    # the blocks again in blocks: a window over one row per block**2 parts
    outer = totals.withColumn("outer", F.floor(F.col("block") / block))
    sums = outer.groupBy("outer").agg(F.sum("total").alias("sum"))
    over = Window.orderBy("outer").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("outer", F.coalesce(F.sum("sum").over(over), F.lit(0)).alias("far"))
    near = Window.partitionBy("outer").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = outer.withColumn("near", F.coalesce(F.sum("total").over(near), F.lit(0))).join(sums, "outer")
    totals = totals.select("block", (F.col("near") + F.col("far")).alias("ahead"))
    return inside.join(totals, "block").select(*shards.columns, (F.col("ahead") + F.col("inside")).alias("base"))


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Documents of the listed files: doc_id, start, n_tokens, ids_crc32."""
    spark = shards.sparkSession
    prepare(spark)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in parts:
                for name, base in zip(column(batch, "file"), column(batch, "base")):
                    with RangeReader(folder, name) as file:
                        shard = Shard(file.read)
                        first = shard.first_token.tolist()
                        for a in range(0, len(shard.doc_ids), READ_DOCS):
                            b = min(a + READ_DOCS, len(shard.doc_ids))
                            raw = memoryview(shard.documents(a, b).tobytes())
                            for k in range(a, b):
                                ids = raw[4 * (first[k] - first[a]) : 4 * (first[k + 1] - first[a])]
                                yield shard.doc_ids[k], base + first[k], first[k + 1] - first[k], zlib.crc32(ids)

        yield from batches(rows(), DOCS)

    listed = stored(with_offsets(shards).select("part", "number", "file", "base"), "token-offsets")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(width, "file").mapInArrow(worker_task(run, pieces=True), DOCS_DDL)


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write shard files below the shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "token-ids")
    return read_shards(write_shards(docs, folder, tokenizer), folder)
