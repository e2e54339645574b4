"""Language-model scoring with stupid backoff.

Words and word pairs are n-grams of order 1 and 2, named by 64-bit
hashes.  The model is trained on the whole table: a pair's score is
count(v w) / count(v) if it occurs at least ``min_count`` times, else
``BACKOFF`` x count(w) / total; a text's first word has its unigram
score.  A document's score is the sum of the logarithms.

Relationally: blocks of documents are exploded into their distinct
n-grams with local counts; these rows are partitioned by the n-gram's
hash, where the counts of all blocks are summed and joined back to the
blocks that hold the n-gram; a block's answers then meet its documents,
and the logarithms are summed per document.  The rows of one block and
hash partition travel as arrays in one row.  Pairs are pre-aggregated
per block, so a frequent word counts once per block, not once per
occurrence.  A block's word numbers wait in a file of the shared folder, named by its
content, so that a task repeated after a lost executor asks the same.

The number of hash partitions grows with the text, and so does what is
gathered; nothing of it passes through the driver but the total count.

Defined cases: a null or empty text has no words, log_score 0 and a null
mean; rows of a null or repeated doc_id are scored each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwarden.llm.common import RangeReader, SharedFile, column, prepare, stored, words, worker_task
from tickwarden.session import scratch_path

BACKOFF = 0.4
MIN_COUNT = 2
BLOCK_WORDS = 1_500_000
PART_BYTES = 16 << 20  # of text for each hash partition

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two words' hashes, in order."""
    x = (first * _A) ^ ((second >> np.uint64(29)) + second * _B)
    x ^= x >> np.uint64(32)
    x *= _A
    return x ^ (x >> np.uint64(29))


class _Block:
    """Word numbers of a run of documents, in order."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.docs: list = []
        self.lengths: list[int] = []
        self.words: list[np.ndarray] = []
        self.size = 0

    def add(self, doc, text: str | None) -> None:
        ws = words(text)
        number = self.number
        self.words.append(np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int32, len(ws)))
        self.docs.append(doc)
        self.lengths.append(len(ws))
        self.size += len(ws)

    def arrays(self) -> dict[str, np.ndarray]:
        names = np.fromiter(
            (xxhash.xxh64_intdigest(w) for w in self.number), np.uint64, len(self.number)
        )
        flat = np.concatenate(self.words) if self.words else np.zeros(0, np.int32)
        return {
            "names": names, "flat": flat, "lengths": np.array(self.lengths, np.int64),
            "docs": np.array([0 if d is None else d for d in self.docs], np.int64),
            "null": np.array([d is None for d in self.docs], bool),
        }


_KINDS = {"names": np.uint64, "flat": np.int32, "lengths": np.int64, "docs": np.int64, "null": np.bool_}


def _pack(a: dict[str, np.ndarray]) -> tuple[bytes, str]:
    """A block as bytes, and a name that follows from its content."""
    raw = b"".join(a[k].astype(t).tobytes() for k, t in _KINDS.items())
    head = np.array([len(a[k]) for k in _KINDS] + [len(raw)], "<i8").tobytes()
    return head + pa.compress(raw, "zstd", asbytes=True), xxhash.xxh64_hexdigest(head + raw)


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    *sizes, length = np.frombuffer(data[:48], "<i8").tolist()
    raw, at, out = pa.decompress(data[48:], length, "zstd", asbytes=True), 0, {}
    for (k, t), n in zip(_KINDS.items(), sizes):
        out[k] = np.frombuffer(raw, t, n, at)
        at += n * np.dtype(t).itemsize
    return out


def _planes(h: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte plane by byte plane: the high
    planes are zero, which the shuffle's compression removes."""
    d = np.diff(h, prepend=np.uint64(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _numbers(n: np.ndarray) -> bytes:
    """Counts in 4 bytes each where they fit, told by a first byte."""
    narrow = not len(n) or int(n.max()) < 1 << 31
    return (b"\x04" if narrow else b"\x08") + n.astype("<i4" if narrow else "<i8").tobytes()


def _unnumbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i4" if data[0] == 4 else "<i8", offset=1).astype(np.int64)


def _pairs(a: dict[str, np.ndarray]):
    """Distinct pair hashes, each pair's number among them, where pairs
    start (positions of their first word), and the distinct pairs' counts."""
    flat = a["flat"]
    if len(flat) < 2:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    inside = np.ones(len(flat), bool)  # position p pairs with p + 1 unless a document ends there
    ends = np.cumsum(a["lengths"]) - 1
    inside[ends[a["lengths"] > 0]] = False
    at = np.flatnonzero(inside)
    h = _pair_hash(a["names"][flat[at]], a["names"][flat[at + 1]])
    distinct, which, n = np.unique(h, return_inverse=True, return_counts=True)
    return distinct, which, at, n


def _partition(h: np.ndarray, parts: int) -> np.ndarray:
    """The hash partition, from the top bits (so that it ascends with h)."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _cut(h: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(partition, from, to) of a sorted hash array."""
    p = _partition(h, parts)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(p)) + 1)) if len(p) else np.zeros(0, int)
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(p)]):
        yield int(p[s]), s, e


ASK_DDL = "part int, block string, kind int, first int, names binary, counts binary"
ANSWER_DDL = "block string, kind int, first int, counts binary"
SCORE_DDL = "doc_id bigint, n_words bigint, log_sum double, by_unigram bigint, backed_off bigint"


def _explode(folder: str, parts: int):
    """Documents to blocks: the block's file, and its n-grams by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0

        def finished(block: _Block) -> Iterator[pa.RecordBatch]:
            nonlocal made
            a = block.arrays()
            packed, content = _pack(a)
            # a repeated attempt writes the same file and asks the same
            name = f"{task:06d}-{made:04d}-{content}"
            made += 1
            out = SharedFile(folder, name)
            out.write(packed)
            out.close()
            order = np.argsort(a["names"])
            counts = np.bincount(a["flat"], minlength=len(order))[order]
            pair_names, _, _, pair_counts = _pairs(a)
            rows = []
            for kind, h, n in ((1, a["names"][order], counts), (2, pair_names, pair_counts)):
                for p, s, e in _cut(h, parts):
                    rows.append((p, name, kind, s, _planes(h[s:e]), _numbers(n[s:e])))
            if not rows:  # so that a block without words is answered too
                rows.append((0, name, 1, 0, b"", _numbers(np.zeros(0, np.int64))))
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(
                        zip(*rows[i : i + 256]),
                        (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()),
                    )],
                    names=["part", "block", "kind", "first", "names", "counts"],
                )

        block = _Block()
        for batch in batches:
            for doc, text in zip(column(batch, "doc_id"), column(batch, "text")):
                block.add(doc, text)
                if block.size >= BLOCK_WORDS:
                    yield from finished(block)
                    block = _Block()
        if block.docs:
            yield from finished(block)

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """One hash partition: sum the blocks' counts, answer each block."""
    out = []
    for kind, rows in pdf.groupby("kind"):
        names = [_unplanes(b) for b in rows["names"]]
        _, which = np.unique(np.concatenate(names), return_inverse=True)
        counts = np.concatenate([_unnumbers(b) for b in rows["counts"]])
        total = np.bincount(which, weights=counts).astype(np.int64)
        answers = np.split(total[which], np.cumsum([len(n) for n in names])[:-1])
        for block, first, a in zip(rows["block"], rows["first"], answers):
            out.append((block, kind, first, _numbers(a)))
    return pd.DataFrame(out, columns=["block", "kind", "first", "counts"])


def _score(folder: str, backoff: float, min_count: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["block"].iloc[0]
        with RangeReader(folder, name) as file:
            a = _unpack(file.read(0, file.size))
        got = {1: np.zeros(0, np.int64), 2: np.zeros(0, np.int64)}
        for kind, rows in pdf.groupby("kind"):
            rows = rows.sort_values("first")
            got[kind] = np.concatenate([_unnumbers(b) for b in rows["counts"]])
        flat, lengths = a["flat"], a["lengths"]
        distinct, which, at, _ = _pairs(a)
        if len(got[1]) != len(a["names"]) or len(got[2]) != len(distinct):
            raise RuntimeError(f"block {name}: answers are missing")
        single = np.zeros(len(a["names"]), np.int64)
        single[np.argsort(a["names"])] = got[1]
        # the logarithm of the total is subtracted later, once per word in
        # ``by_unigram``
        logs = np.log(single[flat]) if len(flat) else np.zeros(0)
        alone, off = np.ones(len(flat), np.int64), np.zeros(len(flat), np.int64)
        if len(at):
            pair = got[2][which]
            seen = pair >= min_count
            logs[at + 1] = np.where(
                seen, np.log(pair / single[flat[at]]), np.log(backoff) + logs[at + 1]
            )
            off[at + 1] = ~seen
            alone[at + 1] = ~seen
        out = pd.DataFrame({"doc_id": pd.array(a["docs"], dtype="Int64"), "n_words": lengths})
        out.loc[a["null"], "doc_id"] = pd.NA
        starts = (np.cumsum(lengths) - lengths)[lengths > 0]
        for column_name, values in (("log_sum", logs), ("by_unigram", alone), ("backed_off", off)):
            sums = np.zeros(len(lengths), values.dtype)
            if len(starts):
                sums[lengths > 0] = np.add.reduceat(values, starts)
            out[column_name] = sums
        return out

    return run


def score(docs: DataFrame, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score, backed_off (words scored
    by backoff) of every row, under the model of all rows."""
    spark = docs.sparkSession
    prepare(spark)
    folder = scratch_path(spark, "lm-blocks")
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    asked = slim.mapInArrow(worker_task(_explode(folder, parts)), ASK_DDL)
    answers = asked.groupBy("part").applyInPandas(_answer, ANSWER_DDL)
    scored = stored(answers.groupBy("block").applyInPandas(_score(folder, backoff, min_count), SCORE_DDL), "lm-scores")
    total = scored.agg(F.sum("n_words")).first()[0] or 1
    log_score = F.col("log_sum") - F.col("by_unigram") * F.log(F.lit(float(total)))
    out = scored.withColumn("log_score", F.when(F.col("n_words") > 0, log_score).otherwise(0.0))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return out.select("doc_id", "n_words", "log_score", mean.alias("mean_log_score"), "backed_off")
