"""Hard negatives and exact top-k against plain products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_rows import rows_of
from tickwarden.llm import hardneg, topk

DDL = "vec_id bigint, embedding array<double>, label int, x string, `q.q` string, bucket string"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
LONGS = -(1 << 63), (1 << 63) - 1


def usable(rows):
    return [r for r in rows if r[0] is not None and r[1] is not None
            and all(v is not None and math.isfinite(v) for v in r[1])]


def weights(x):
    return [math.floor(256 * v) if abs(v) < 1e300 else int(v) * 256 for v in x]


def clip(v):
    return max(LONGS[0], min(LONGS[1], v))


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def plain_mine(rows, every=50, positives=5, negatives=3):
    rows = [(i, weights(x), label) for i, x, label, *_ in usable(rows) if label is not None]
    out = []
    for i, x, label in rows:
        if i % every:
            continue
        scored = sorted((-product(x, y), j, other) for j, y, other in rows if j != i)
        for s, j, other in [t for t in scored if t[2] == label][:positives]:
            fit = [t for t in scored if t[2] != label and 50 * -s <= 100 * -t[0] <= 95 * -s][:negatives]
            out += [(i, j, r + 1, k, clip(-s), clip(-t)) for r, (t, k, _) in enumerate(fit)]
    return sorted(out, key=str)


def some_rows(seed, n=230, dims=6, values=(0.0, 0.0, 0.5, -0.25, 0.1)):
    rng = random.Random(seed)
    return [(i, [rng.choice(values) for _ in range(dims)], rng.randrange(3), "a", "b", "c") for i in range(n)]


ODD = [(300, None, 0), (350, [1.0, None], 0), (400, [float("nan")] * 6, 0), (None, [1.0] * 6, 0), (450, [1.0, 2.0], 0),
       (500, [], 0), (7, [0.5] * 6, 1), (50, [0.1] * 6, 2), (50, [0.1] * 6, 2), (550, [float("inf")], 0),
       (600, [0.5] * 6, None), (650, [0.0] * 6, 1), (700, [0.5] * 9, 1), (701, [3e6] * 6, 1), (702, [-1e20, 1.0], 2)]


def frame(spark, rows):
    return spark.createDataFrame([(*r[:3], "a", "b", "c") for r in rows], DDL)


@pytest.mark.parametrize("bucket_rows,anchor_rows", [(16_384, 8_192), (29, 3)])
def test_ties_nulls_copies_zero_and_wide_rows(spark, bucket_rows, anchor_rows):
    rows = some_rows(2) + ODD
    got = hardneg.mine(frame(spark, rows), F.col("vec_id") % 50 == 0, bucket_rows=bucket_rows, anchor_rows=anchor_rows)
    assert rows_of(got, *COLUMNS) == plain_mine(rows)


def test_lengths_of_many_sizes_and_a_label_with_most_rows(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        scale = rng.choice([0.01, 0.3, 1.0, 5.0, 40.0])
        rows.append((i, [rng.gauss(0.2, 1) * scale for _ in range(12)], 0 if rng.random() < 0.7 else rng.randrange(4)))
    got = hardneg.mine(frame(spark, rows), F.col("vec_id") % 50 == 0, bucket_rows=40, anchor_rows=2)
    assert rows_of(got, *COLUMNS) == plain_mine(rows)


def test_wide_anchor(spark):
    rows = some_rows(4, 60) + [(0, [2e7, 1.0, -3e9, 0.5, 0.5, 0.5], 1), (50, [1e306, 1.0], 0), (61, [1e305], 0)]
    got = hardneg.mine(frame(spark, rows[1:]), F.col("vec_id") % 50 == 0, bucket_rows=20)
    # beyond 38 digits scores count as equal
    want = [r for r in plain_mine(rows[1:]) if r[0] == 0]
    assert [r for r in rows_of(got, *COLUMNS) if r[0] == 0] == want


def test_empty_and_tiny(spark):
    anchor = F.col("vec_id") % 50 == 0
    assert hardneg.mine(frame(spark, []), anchor).count() == 0
    assert hardneg.mine(frame(spark, [(0, [1.0], 1)]), anchor).count() == 0
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.6], 2), (3, [0.4], 2), (4, [0.97], 2)]
    assert rows_of(hardneg.mine(frame(spark, rows), anchor), *COLUMNS) == plain_mine(rows)


def test_feasible_ranges_lose_nothing_and_prune():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    vectors = (centres[rng.integers(20, size=2000)] + 0.1 * rng.normal(size=(2000, 16))) * rng.uniform(0.9, 1.1, size=(2000, 1))
    bucket = hardneg.Bucket(np.arange(2000), np.zeros(2000, np.int64), list(vectors))
    pruned = 0
    for _ in range(40):
        query = np.floor((centres[rng.integers(20)] + 0.1 * rng.normal(size=16)) * 256)
        scores = bucket.rows.matrix @ query
        length = math.sqrt(query @ query)
        for floor in (int(np.sort(scores)[-5]), 0, int(scores.min())):
            found = bucket.feasible(query, length, floor)
            assert set(np.flatnonzero(scores >= floor)) <= set(bucket.listed[found])
        pruned += len(bucket.feasible(query, length, int(np.sort(scores)[-5]))) < 1000
    assert pruned >= 20
    assert len(bucket.feasible(query, length, int(1e9))) == 0


# -------------------------------------------------------------------- top-k


def plain_top(rows, k=5, every=50):
    rows = [(i, weights(x)) for i, x, *_ in usable(rows)]
    out = []
    for i, x in rows:
        if i % every == 0:
            scored = sorted((-product(x, y), j) for j, y in rows if j != i)[:k]
            out += [(i, r + 1, j, clip(-s)) for r, (s, j) in enumerate(scored)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_rows,query_rows", [(16_384, 4_096), (37, 2)])
def test_top_k_keeps_every_row_and_exact_scores(spark, block_rows, query_rows):
    rows = some_rows(5) + ODD
    df = topk.searchable(frame(spark, rows))
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=block_rows, query_rows=query_rows)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == plain_top(rows)


def test_top_k_large_components_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [5.0, 0.0], 0), (2, [3e6, 0.0], 0)]
    got = topk.top_k(topk.searchable(frame(spark, rows)), F.col("vec_id") == 0)
    assert rows_of(got, "vec_id", "score") == [(1, 327680), (1, 65536), (2, 196608000000)]
