"""Hard negatives by inner product, mined with coordinate pruning.

For every anchor row, its positives are the best rows of its label; for
each positive, the negatives are the best rows of other labels whose score
lies in a window of per cents of the positive's score.

Method (LEMP style): rows are sorted by length into buckets.  A bucket
holds, per coordinate, the sorted values of its unit vectors.  If a score
must reach s, the angle between anchor and row is at most
``arccos(s / (|anchor| longest))``; buckets where that ratio exceeds 1 are
left out.  For the anchor's focus coordinates (its largest) that angle
gives a range of feasible values, which two binary searches find in the
sorted list; the shortest list is intersected with the ranges of the other
focus coordinates, and what is left is verified by exact integer products.
The longest bucket is searched first; the k-th best score found there is
the floor that the other buckets start from.

Distribution: buckets are ranges of length (a hash of the id splits equal
lengths) of about ``bucket_rows`` rows, anchors are dealt by hash into
groups of about ``anchor_rows``.  One task's unit is a pair of a bucket
and a group, both bounded, whatever the labels; anchors are not sent to
buckets that their floor rules out.  Only k rows per anchor, positive and
bucket leave a task.

Defined cases: rows with a null id, label or vector, or with a null or
non-finite component take no part.  Every row of a repeated id is a
candidate and, if it is an anchor, asks for itself; rows of an anchor's
own id are none of its positives or negatives.  Vectors of unequal length
meet on their common positions.  Scores are exact (see ``vectors``).
Ties go to the smaller id.  Other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwarden.llm.common import prepare, stored
from tickwarden.llm.vectors import NARROW, SCALE, SCORE, Rows, as_long, as_score, exact, usable

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # per cent of the positive's score
BUCKET_ROWS = 16_384
ANCHOR_ROWS = 8_192
FOCUS = 5
SLACK = 1e-6  # for rounding in the feasible ranges


class Bucket:
    """Rows of similar length with sorted coordinate lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list, scale: int = SCALE) -> None:
        self.ids, self.labels = ids, labels
        self.rows = Rows(vectors, scale)
        matrix = self.rows.matrix
        lengths = np.sqrt((matrix * matrix).sum(axis=1))
        listed = lengths > 0  # neither wide nor all zero
        self.always = np.flatnonzero(~listed)
        self.listed = np.flatnonzero(listed)
        self.lengths = lengths[self.listed]
        self.unit = matrix[self.listed] / self.lengths[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.unit, self.order, axis=0)
        self.most = float(np.abs(matrix).max(initial=0.0))
        # products that stay below 2^24 are exact in 32 bits too
        self.small = matrix.astype(np.float32) if self.rows.width * self.most * self.most < 1 << 24 else None

    def feasible(self, query: np.ndarray, length: float, floor: int | None) -> np.ndarray:
        """Rows (of the listed ones) that can reach the floor."""
        n = len(self.listed)
        if floor is None or n == 0 or length == 0:
            return np.arange(n)
        reach = float(floor) / (length * (self.lengths.max() if floor > 0 else self.lengths.min()))
        if reach > 1 + SLACK:
            return np.arange(0)
        if reach <= -1:
            return np.arange(n)
        angle = math.acos(min(1.0, reach))
        unit = query[: self.rows.width] / length
        ranges = []
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            own = math.acos(max(-1.0, min(1.0, unit[f])))
            low = math.cos(min(math.pi, own + angle)) - SLACK
            high = math.cos(max(0.0, own - angle)) + SLACK
            a = int(np.searchsorted(self.sorted[:, f], low, "left"))
            b = int(np.searchsorted(self.sorted[:, f], high, "right"))
            ranges.append((b - a, int(f), a, b, low, high))
        if not ranges:
            return np.arange(n)
        _, f, a, b, _, _ = ranges.pop(min(range(len(ranges)), key=lambda i: ranges[i][0]))
        found = self.order[a:b, f]
        for _, f, _, _, low, high in ranges:
            values = self.unit[found, f]
            found = found[(values >= low) & (values <= high)]
        if floor > 0:  # of rows in reach by angle, the long enough ones
            found = found[self.lengths[found] * length * (1 + SLACK) >= float(floor)]
        return found

    def _products(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact inner products with the listed rows ``at``."""
        matrix, width = self.rows.matrix, min(self.rows.width, len(query))
        query = query[:width]
        if self.small is not None and width * self.most * np.abs(query).max(initial=0.0) < 1 << 24:
            matrix, query = self.small, query.astype(np.float32)
        if width < self.rows.width:
            matrix = matrix[:, :width]
        if 4 * len(at) > len(self.ids):  # cheaper than gathering the rows
            return (matrix @ query)[at].astype(np.int64)
        return (matrix[at] @ query).astype(np.int64)

    def scores(self, vector: np.ndarray, floor: int | None, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact scores of the rows of ``kind`` (a mask) that
        can reach the floor."""
        with np.errstate(over="ignore"):
            query = np.floor(vector * SCALE)
        if np.abs(query).max(initial=0.0) > NARROW:
            whole = exact(vector)
            at = np.flatnonzero(kind)
            return at, np.array([self.rows.product(i, whole) for i in at] + [None], object)[:-1]
        at = self.listed[self.feasible(query, math.sqrt(float(query @ query)), floor)]
        at = at[kind[at]]
        products, always = self._products(query, at), self.always[kind[self.always]]
        if not len(always):
            return at, products
        # zero rows score 0; products with wide rows need wide integers
        whole = [int(v) for v in query]
        rest = [self.rows.product(i, whole) for i in always]
        if self.rows.wide:
            return np.concatenate([at, always]), np.array([*products.tolist(), *rest, None], object)[:-1]
        return np.concatenate([at, always]), np.concatenate([products, np.zeros(len(rest), np.int64)])

    def best(self, at: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best: score descending, id ascending."""
        if len(at) > k:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            at, scores = at[scores >= edge], scores[scores >= edge]
        pairs = sorted(zip((-scores).tolist(), self.ids[at].tolist()))[:k]
        return [(i, -s) for s, i in pairs]


def window(target, floor, low: int, high: int) -> tuple[int | None, int | None]:
    """Lowest and highest score that counts."""
    least = most = None
    if target is not None:
        target = int(target)
        least, most = -(-low * target // 100), high * target // 100
    if floor is not None:
        least = int(floor) if least is None else max(least, int(floor))
    return least, most


def _search(same: bool, k: int, low: int, high: int):
    names = ["q", "slot", "vec_id", "score"]

    def run(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            bucket = Bucket(rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), list(rows["x"]))
            for q, own, label, x, targets, floors in zip(*(asked[c] for c in ("q", "anchor_id", "label", "x", "targets", "floors"))):
                windows = [window(t, f, low, high) for t, f in zip(targets, floors)]
                least = [a for a, b in windows if a is None or b is None or a <= b]
                if not least:
                    continue
                kind = ((bucket.labels == label) == same) & (bucket.ids != own)
                at, scores = bucket.scores(np.asarray(x, np.float64), None if None in least else min(least), kind)
                for slot, (a, b) in enumerate(windows):
                    inside = np.ones(len(at), bool)
                    if a is not None:
                        inside &= scores >= a
                    if b is not None:
                        inside &= scores <= b
                    out += [(q, slot, i, as_score(s)) for i, s in bucket.best(at[inside], scores[inside], k)]
        return pd.DataFrame(out, columns=names)

    return run


def _floor(names: tuple[str, str], low: int):
    """The least score that any slot can use, as a double (null: any score)."""
    targets, floors = names
    per_slot = F.zip_with(
        targets, floors,
        lambda t, f: F.when(t.isNull() & f.isNull(), float("-inf")).otherwise(
            F.greatest(t.cast("double") * (low / 100.0), f.cast("double"))
        ),
    )
    return F.array_min(per_slot)


def _found(rows: DataFrame, anchors: DataFrame, buckets: DataFrame, same: bool, k: int, low: int, high: int) -> DataFrame:
    """k best per (anchor, slot) and bucket; ``buckets`` (bucket, longest)
    names the buckets to search."""
    reach = F.col("length") * F.col("longest") * (1 + 1e-9) + 1.0
    everywhere = anchors.select("*", F.explode(F.sequence(F.lit(0), F.col("last_bucket"))).alias("bucket"))
    sent = everywhere.join(buckets, "bucket").where(
        (F.col("length") > NARROW) | (reach >= _floor(("targets", "floors"), low))
    )
    pairs = sent.select(F.col("bucket").alias("at"), F.col("part").alias("for_part")).distinct()
    held = rows.select("vec_id", "label", "x", F.col("bucket").alias("at")).join(pairs, "at")
    left, right = held.groupBy("at", "for_part"), sent.groupBy("bucket", "part")
    return left.cogroup(right).applyInPandas(
        _search(same, k, low, high), f"q bigint, slot int, vec_id bigint, score {SCORE}"
    )


def _best(rows: DataFrame, anchors: DataFrame, buckets: DataFrame, same: bool, k: int, low: int, high: int) -> DataFrame:
    """(q, slot, vec_id, score, rank): the longest bucket first, then the
    others from the floors it gives."""
    first = buckets.agg(F.min("bucket")).first()[0] or 0
    found = stored(_found(rows, anchors, buckets.where(F.col("bucket") == first), same, k, low, high), "hardneg-first")
    floors = found.groupBy("q", "slot").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    floors = floors.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("slot", "floor"))).alias("known"))
    raised = anchors.join(floors, "q", "left").withColumn(
        "floors", F.transform("floors", lambda f, i: F.coalesce(F.greatest(f, F.try_element_at("known", i)), f))
    ).drop("known")
    rest = _found(rows, raised, buckets.where(F.col("bucket") != first), same, k, low, high)
    order = Window.partitionBy("q", "slot").orderBy(F.desc("score"), "vec_id")
    return found.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
    high: int = HIGH, bucket_rows: int = BUCKET_ROWS, anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """vectors(vec_id, embedding, label) to anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score."""
    prepare(vectors.sparkSession)
    label = F.col("label").cast("bigint")
    rows = usable(vectors, "vec_id", "embedding", label=label).where(F.col("label").isNotNull())
    # at least the length of the integer vector
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + (F.abs(v) * SCALE + 1.0) * (F.abs(v) * SCALE + 1.0)))
    rows = rows.withColumn("length", length)
    n = rows.count()
    rows = stored(
        rows.repartitionByRange(max(1, -(-n // bucket_rows)), F.desc("length"), F.xxhash64("vec_id"))
        .withColumn("bucket", F.spark_partition_id()),
        "hardneg-rows",
    )
    buckets = stored(rows.groupBy("bucket").agg(F.max("length").alias("longest")), "hardneg-buckets")
    last = buckets.agg(F.max("bucket")).first()[0] or 0
    asking = rows.where(is_anchor)
    parts = max(1, -(-asking.count() // anchor_rows))
    none = F.lit(None).cast(SCORE)
    anchors = stored(
        asking.select(
            F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("anchor_id"), "label", "x", "length",
            F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(parts)).cast("int").alias("part"),
            F.lit(last).cast("int").alias("last_bucket"),
        ),
        "hardneg-anchors",
    )
    asked = anchors.select("*", F.array(none).alias("targets"), F.array(none).alias("floors"))
    near = stored(
        _best(rows, asked, buckets, True, positives, low, high).select(
            "q", (F.col("rank") - 1).cast("int").alias("slot"), F.col("vec_id").alias("positive_id"),
            F.col("score").alias("positive_score"),
        ),
        "hardneg-positives",
    )
    targets = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("t"))
    asked = anchors.join(targets, "q").select(
        *anchors.columns, F.col("t.positive_score").alias("targets"), F.transform("t", lambda t: none).alias("floors")
    )
    far = _best(rows, asked, buckets, False, negatives, low, high)
    return far.join(near, ["q", "slot"]).join(anchors.select("q", "anchor_id"), "q").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        as_long(F.col("positive_score")).alias("positive_score"), as_long(F.col("score")).alias("negative_score"),
    )
