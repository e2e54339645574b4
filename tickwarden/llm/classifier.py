"""Quality classifier: naive-Bayes support vectors.

Features of a whole text are presence indicators of hashed byte 4-grams
(case kept) and of shape marks: a word equal to the one before, the
share of lines equal to an earlier one, the share of distinct words.  Training counts, for every n-gram, the labelled training
documents of each class that hold it; the log-count ratio of the two
classes scales the indicator, and a linear hinge-loss model is fitted to
the scaled, length-normalised indicators by dual coordinate descent.

The counts cover all labelled training rows.  The descent runs on a
bounded sample of them, ``FIT_ROWS`` in expectation, half of each class,
chosen by a hash of the id, and fewer where their indicators would exceed
``FIT_BYTES``; it is one task's work on compact arrays, and only the
weights (2 MB) come to the driver.  A logistic curve fitted to the
sample's margins maps margins to scores.

Defined cases: empty and null texts have no indicators and get the score
of the bias alone.  Several labels of one id: their mean, 0.5 or more
being 1.  Null labels are ignored.  With one class only, every score is
0 or 1 accordingly; without labels 0.5.  A row with a null doc_id is not
learned from and held_out is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwarden.llm.common import column, id_remainder, prepare, stored, words, worker_task

BUCKETS = 1 << 18
ALPHA = 1.0
COST = 1.0
EPOCHS = 8
FIT_ROWS = 12_000
FIT_BYTES = 256 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - 18)


def _hashed(values: np.ndarray, kind: int) -> np.ndarray:
    salted = values.astype(np.uint64) * np.uint64(8) + np.uint64(kind)
    salted ^= salted >> np.uint64(31)
    return ((salted * _MIX) >> _SHIFT).astype(np.int32)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    ws = words(text)
    if not ws:
        return np.zeros(0, np.int32)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    out = []
    if len(raw) >= 4:
        grams = (raw[:-3] << np.uint64(24)) | (raw[1:-2] << np.uint64(16)) | (raw[2:-1] << np.uint64(8)) | raw[3:]
        out.append(_hashed(grams, 0))
    distinct: dict[bytes, int] = {}
    for w in ws:
        distinct.setdefault(w, len(distinct))
    n = len(ws)
    shape = [int(8 * len(distinct) / n) + 16]
    if any(a == b for a, b in zip(ws, ws[1:])):
        shape.append(1)
    lines = [s for s in text.split("\n") if s.strip()]
    repeated = len(lines) - len(set(lines))
    if repeated:
        shape.append(2 + int(4 * repeated / len(lines)))
    out.append(_hashed(np.array(shape), 3))
    return np.unique(np.concatenate(out))


def _count_classes(rows: DataFrame) -> DataFrame:
    """(text, label) rows to (code, label, n): documents of a class that
    hold a feature; code -1 counts the documents."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        docs = [0, 0]
        for batch in parts:
            for text, label in zip(column(batch, "text"), column(batch, "label")):
                sums[label][features(text)] += 1
                docs[label] += 1
        for label in (0, 1):
            found = np.flatnonzero(sums[label]).astype(np.int32)
            codes = np.concatenate((np.array([-1], np.int32), found))
            n = np.concatenate(([docs[label]], sums[label][found]))
            for i in range(0, len(codes), 16384):
                part = codes[i : i + 16384]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(np.full(len(part), label, np.int32)), pa.array(n[i : i + 16384])],
                    names=["code", "label", "n"],
                )

    partial = rows.mapInArrow(worker_task(run), "code int, label int, n bigint")
    return partial.groupBy("code", "label").agg(F.sum("n").alias("n"))


class Model:
    """Margin ``weights . scaled indicators + bias`` and its logistic curve."""

    def __init__(self, ratio: np.ndarray, weights: np.ndarray, bias: float, slope: float, offset: float) -> None:
        self.ratio, self.scaled = ratio.astype(np.float32), (ratio * weights).astype(np.float32)
        self.bias, self.slope, self.offset = bias, slope, offset

    def margin(self, text: str | None) -> float:
        f = features(text)
        norm = float(np.sqrt(np.square(self.ratio[f], dtype=np.float64).sum()))
        return float(self.scaled[f].sum(dtype=np.float64)) / norm + self.bias if norm else self.bias

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(text) + self.offset
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


def constant(score: float) -> Model:
    z = 500.0 if score >= 1 else -500.0 if score <= 0 else float(np.log(score / (1 - score)))
    zero = np.zeros(BUCKETS, np.float32)
    return Model(zero, zero, 0.0, 0.0, z)


def log_ratios(counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Log-count ratios of class 1 against class 0, from document counts."""
    p = (counts + ALPHA) / (docs[:, None] + 2 * ALPHA)
    return np.log(p[1] / p[0])


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS):
    """Weights and bias of the hinge-loss model on the scaled, normalised
    indicators (the bias is an extra feature of value 1)."""
    w, bias = np.zeros(len(ratio)), 0.0
    values = [ratio[f] / (np.sqrt(np.square(ratio[f]).sum()) or 1.0) for f in rows]
    square = np.array([np.square(v).sum() + 1.0 for v in values])
    dual = np.zeros(len(rows))
    rng = np.random.default_rng(7)
    upper = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, v = rows[i], values[i]
            gradient = y[i] * (w[f] @ v + bias) - 1.0
            new = min(max(dual[i] - gradient / square[i], 0.0), upper[i])
            step = (new - dual[i]) * y[i]
            if step:
                w[f] += step * v
                bias += step
                dual[i] = new
    return w, bias


def _logistic(margins: np.ndarray, y: np.ndarray, prior: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1 | margin), weighted to the class shares."""
    t = (y + 1) / 2
    weight = np.where(y > 0, prior[1] / max(1, (y > 0).sum()), prior[0] / max(1, (y < 0).sum()))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = weight * (p - t)
        h = weight * np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([(g * margins).sum() + 1e-3 * a, g.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


FIT_DDL = "weights binary, bias double, slope double, offset double"


def _fit(ratio: np.ndarray, prior: np.ndarray):
    """The descent over all rows of one task; no row without both classes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, labels = [], []
        for batch in parts:
            found += [np.frombuffer(b, np.int32) for b in column(batch, "found")]
            labels += column(batch, "label")
        if len(set(labels)) < 2:
            return
        y = np.where(np.array(labels) > 0, 1.0, -1.0)
        w, bias = dual_descent(found, y, ratio)
        norms = [np.sqrt(np.square(ratio[f]).sum()) for f in found]
        margins = np.array([(ratio[f] * w[f]).sum() / n + bias if n else bias for f, n in zip(found, norms)])
        slope, offset = _logistic(margins, y, prior)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.tobytes()], pa.binary()), *(pa.array([float(v)]) for v in (bias, slope, offset))],
            names=["weights", "bias", "slope", "offset"],
        )

    return run


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Model:
    """``docs``: (doc_id, text) rows that may be learned from; ``labels``:
    (doc_id, label)."""
    prepare(docs.sparkSession)
    one = labels.where("label is not null").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    # labels grow with the documents: always a merge join, at any size
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(one.hint("merge"), F.col("_id") == F.col("doc_id"))
    rows = stored(rows.select("_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), "label"), "nbsvm-rows")
    table = _count_classes(rows).toPandas()  # at most 2 x (BUCKETS + 1) rows
    docs_of, counts = np.zeros(2), np.zeros((2, BUCKETS))
    total = table["code"].to_numpy() < 0
    docs_of[table["label"][total]] = table["n"][total]
    counts[table["label"][~total], table["code"][~total]] = table["n"][~total]
    if not docs_of.all():
        return constant(0.5 if not docs_of.any() else float(docs_of[1] > 0))
    ratio = log_ratios(counts, docs_of)
    # the bounded sample: ids whose hash falls below the class's share
    share = [min(1.0, fit_rows / 2 / d) for d in docs_of]
    draw = F.pmod(F.xxhash64(F.col("_id"), F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < F.when(F.col("label") == 1, share[1]).otherwise(share[0]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = [features(t).tobytes() for t in column(batch, "text")]
            at = batch.schema.get_field_index
            yield pa.RecordBatch.from_arrays(
                [batch.column(at("_id")), pa.array(found, pa.binary()), batch.column(at("label"))],
                names=["_id", "found", "label"],
            )

    found = sample.mapInArrow(worker_task(run), "_id bigint, found binary, label int")
    found = stored(found.withColumn("draw", F.pmod(F.xxhash64("_id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)), "nbsvm-fit")
    size = found.agg(F.sum(F.octet_length("found"))).first()[0] or 0
    if size > fit_bytes:  # a smaller share by the same hash
        keep = fit_bytes / size
        found = found.where(F.col("draw") < F.when(F.col("label") == 1, share[1] * keep).otherwise(share[0] * keep))
    order = found.select("_id", "found", "label").repartition(1).sortWithinPartitions("_id", "found", "label")
    fitted = order.mapInArrow(worker_task(_fit(ratio, docs_of / docs_of.sum())), FIT_DDL).first()
    if fitted is None:
        return constant(float(docs_of[1] / docs_of.sum()))
    weights = np.frombuffer(bytes(fitted["weights"]), np.float64)
    return Model(ratio, weights, fitted["bias"], fitted["slope"], fitted["offset"])


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    spark = docs.sparkSession
    usable = docs.select("doc_id", "text").where(id_remainder(F.col("doc_id"), 3) != 1)
    known = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    shared = spark.sparkContext.broadcast(train(usable, known, fit_rows))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = [shared.value.score(t) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(found, pa.float64())],
                names=["doc_id", "score"],
            )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(worker_task(run), "doc_id bigint, score double").select(
        "doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
