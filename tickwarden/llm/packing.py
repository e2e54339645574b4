"""Best-fit packing of documents into sequences of a fixed length.

Method: bounded-space online best-fit.  Pieces arrive in an order that
depends on their ids only.  At most ``open_bins`` sequences are open at a
time; they are kept by free space, and an integer whose bit *f* says "a
sequence with *f* tokens free is open" finds the best fit (the lowest set
bit at or above the piece's length) without a search.  When a new
sequence would be one too many, the fullest open one closes.

A document longer than a sequence is cut into full-length pieces; the
remainder is the *first* piece.  Full pieces are sequences by
themselves; all others are packed.

Distribution: only ``(doc_id, lengths, checksums)`` leaves the
tokenising tasks.  Those rows are dealt by a hash of the document into
tasks of about ``rows_per_task`` rows, each with open sequences of its
own.  What a task still holds open at its end is packed again with what
the other tasks hold open, in ever fewer tasks, so that a part-filled
sequence is only left over where nothing fits.

Defined cases: a null or empty text is a document of the end id alone; a
null doc_id packs like any other; repeated rows are packed once per row;
other columns are not read; an empty table gives no rows.  Rows of equal
id order by content, so reruns agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwarden.llm.common import batches, prepare, stored, worker_task
from tickwarden.llm.tokens import END_ID, default_tokenizer, encoded, encoder

MAX_TOKENS = 1024
OPEN_BINS = 2048
ROWS_PER_TASK = 250_000
ROUND_SHRINK = 16
MEMO = 800_000  # pieces remembered per Python worker

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
     ("ids_crc32", pa.int64()), ("token_ids", pa.binary())]
)
PIECES_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, token_ids binary"
PLACED = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
     ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
     ("open", pa.bool_()), ("token_ids", pa.binary())]
)
PLACED_DDL = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, "
              "offset bigint, open boolean, token_ids binary")


class OpenSequences:
    """Open sequences by free space; ``place`` gives a piece its sequence."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.free = [[] for _ in range(capacity + 1)]  # free space -> sequences
        self.bits = 0
        self.count = 0

    def _take(self, space: int):
        row = self.free[space]
        seq = row.pop()
        if not row:
            self.bits &= ~(1 << space)
        self.count -= 1
        return seq

    def _put(self, space: int, seq) -> None:
        self.free[space].append(seq)
        self.bits |= 1 << space
        self.count += 1

    def place(self, length: int, item) -> Iterator[list]:
        """Add an item; yields the sequences (lists of items) that close."""
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            seq = self._take(space)
        else:
            if self.count >= self.limit:
                yield self._take((self.bits & -self.bits).bit_length() - 1)
            space, seq = self.capacity, []
        seq.append(item)
        if space == length:
            yield seq
        else:
            self._put(space - length, seq)

    def rest(self) -> Iterator[list]:
        """The sequences still open, fullest first."""
        for row in self.free:
            yield from row


def document_pieces(
    docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID,
    with_ids: bool = False, memo: int = MEMO,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and the
    piece's ids as ``token_ids``, little-endian 32-bit, if asked for)."""
    prepare(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    end = end_id.to_bytes(4, "little")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, memo)

        def rows():
            for doc, ids in encoded(parts, enc):
                ids += end
                n = len(ids) // 4
                first = n % max_tokens or min(n, max_tokens)
                start, piece = 0, 0
                while start < n:
                    length = first if start == 0 else max_tokens
                    part = ids[4 * start : 4 * (start + length)]
                    yield doc, piece, start, length, zlib.crc32(part), part if with_ids else None
                    start, piece = start + length, piece + 1

        yield from batches(rows(), PIECES)

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(worker_task(run, pieces=True), PIECES_DDL)


def _pack_task(max_tokens: int, open_bins: int, tag: int):
    """Packs one task's rows; sequence ids are (round, task, number)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = (tag << 58) | (TaskContext.get().partitionId() << 32)
        number = 0

        def emit(seq: list, still_open: bool):
            nonlocal number
            offset = 0
            for doc, piece, start, length, check, ids in seq:
                yield doc, piece, start, length, check, base + number, offset, still_open, ids
                offset += length
            number += 1

        def rows():
            bins = OpenSequences(max_tokens, open_bins)
            for batch in parts:
                cols = [batch.column(i).to_pylist() for i in range(6)]
                for item in zip(*cols):
                    for seq in bins.place(item[3], item):
                        yield from emit(seq, False)
            for seq in bins.rest():
                yield from emit(seq, True)

        yield from batches(rows(), PLACED)

    return run


def pack_pieces(
    pieces: DataFrame, max_tokens: int = MAX_TOKENS, open_bins: int = OPEN_BINS, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Give every piece a sequence and an offset."""
    names = PIECES.names
    waiting = stored(pieces.select(*names), "pieces")
    # a piece as long as a sequence is one already
    full = F.col("length") >= max_tokens
    number = F.monotonically_increasing_id()
    done = [waiting.where(full).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (-number - 1).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"), "token_ids",
    )]
    waiting = waiting.where(~full)
    rows = waiting.count()
    tasks = max(1, -(-rows // rows_per_task))
    tag = 0
    while True:
        order = [F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32"), *(F.col(c) for c in names[:5])]
        placed = stored(
            waiting.repartition(tasks, order[0]).sortWithinPartitions(*order)
            .mapInArrow(worker_task(_pack_task(max_tokens, open_bins, tag), pieces=True), PLACED_DDL),
            "packed",
        )
        last = tasks == 1
        kept = placed if last else placed.where(~F.col("open"))
        done.append(kept.drop("open"))
        if last:
            break
        waiting = placed.where("open").select(*names)
        tasks, tag = -(-tasks // ROUND_SHRINK), tag + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, open_bins: int = OPEN_BINS,
    rows_per_task: int = ROWS_PER_TASK, with_ids: bool = False, memo: int = MEMO,
) -> DataFrame:
    """Documents to packed pieces (see the module's text)."""
    pieces = document_pieces(docs, tokenizer, max_tokens, with_ids=with_ids, memo=memo)
    out = pack_pieces(pieces, max_tokens, open_bins, rows_per_task)
    return out if with_ids else out.drop("token_ids")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence with its ids (needs ``with_ids=True``)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "token_ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.expr("aggregate(parts, 0L, (n, p) -> n + p.length)").alias("length"),
        F.expr("transform(parts, p -> p.doc_id)").alias("doc_ids"),
        F.expr("aggregate(parts, X'', (b, p) -> concat(b, p.token_ids))").alias("token_ids"),
    )
