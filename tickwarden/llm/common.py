"""Helpers shared by the corpus operators: words, shared files, prefix sums."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwarden.session import scratch_path, ship_package

# A word is a run of characters other than blank and U+0009..U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

# Arrow batches handed to Python stay small, so that a batch of very long
# texts does not fill a worker.
ROWS_PER_BATCH = 512


def prepare(spark: SparkSession) -> None:
    """Make the package importable in Python workers; bound Arrow batches."""
    ship_package(spark)
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH),
        ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20),
    ):
        now = spark.conf.get(key, None)
        try:
            low = now is not None and 0 < int(now) <= most
        except ValueError:
            low = False
        if not low:
            spark.conf.set(key, str(most))


def worker_task(run: Callable[[Iterator], Iterator], pieces: bool = False) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that leaves its Python worker small.

    Workers are reused by later tasks: what the task freed goes back to the
    system, and the tokenisers' memos stay only for tasks that use them
    (``pieces``).
    """

    def task(parts: Iterator) -> Iterator:
        for name in () if pieces else ("tokens", "bytebpe"):
            if module := sys.modules.get(f"tickwarden.llm.{name}"):
                module.forget()
        try:
            yield from run(parts)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return task


def words(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8 (``bytes.split`` splits on exactly
    blank and U+0009..U+000D)."""
    return text.encode("utf-8", "replace").split() if text else []


def col_of(name: str) -> Column:
    """The column of exactly this name (which may hold dots)."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that their names cannot clash with ours."""
    return F.struct(*[col_of(c) for c in df.columns])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str, partition_by: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and the
    rows survive the loss of executors."""
    path = scratch_path(df.sparkSession, purpose)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus`` (null for a null id)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus).cast("bigint"))


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys' text only:
    the first 52 bits of an MD5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return bits / F.lit(float(1 << 52))


# ------------------------------------------------------------ shared files


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder URI (``file:``, ``hdfs:``,
    ``s3:`` ...; a bare path is a file path)."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


class SharedFile:
    """A new file in a shared folder that appears under its final name only
    when complete; each task attempt writes under a name of its own, so a
    repeated or speculative attempt cannot spoil it."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.path = f"{root}/{name}"
        self._temp = f"{root}/_{uuid.uuid4().hex}.{name}"
        self._out = self.fs.open_output_stream(self._temp)
        self.size = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self._out.close()
        try:
            self.fs.move(self._temp, self.path)
        except (OSError, pa.ArrowException):
            # another attempt of the task was first; its file is equal
            if self.fs.get_file_info(self.path).type != pafs.FileType.File:
                raise
            self.fs.delete_file(self._temp)


class RangeReader:
    """Random access to a file of a shared folder."""

    def __init__(self, folder: str, name: str) -> None:
        fs, root = filesystem(folder)
        self._file = fs.open_input_file(f"{root}/{name}")
        self.size = self._file.size()

    def read(self, offset: int, length: int) -> bytes:
        return self._file.read_at(length, offset)

    def __enter__(self) -> RangeReader:
        return self

    def __exit__(self, *_) -> None:
        self._file.close()


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches from tuples."""
    block: list[tuple] = []
    for row in rows:
        block.append(row)
        if len(block) >= size:
            yield _batch(block, schema)
            block = []
    if block:
        yield _batch(block, schema)


def _batch(block: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*block), schema)], schema=schema
    )
