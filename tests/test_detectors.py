import math
import random

import numpy as np
import pytest
from model import change_model, target_model

from tickwarden.operators import detectors
from tickwarden.streaming.processor import change_step, target_step

SCHEMA = "ticker string, timestamp long, datetime string, close double, seq long"
SPECIAL = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0]


def random_rows(seed, n=3000, tickers=25, special=0.08):
    rnd = random.Random(seed)
    rows = []
    ts = 1_700_000_000_000
    for seq in range(n):
        t = f"T{rnd.randrange(tickers)}"
        if rnd.random() < special:
            close = rnd.choice(SPECIAL)
        else:
            close = round(rnd.uniform(0.5, 300.0), 2)
        ts += rnd.randrange(1, 5_000)  # increasing with seq
        rows.append((t, ts, f"d{seq}", close, seq))
    return rows


def _same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


def test_null_keys_alert_alike_at_every_width(spark):
    rows = [(None if t in ("T0", "T1") else t, *rest) for t, *rest in random_rows(5, n=900, tickers=6)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = detectors.price_change_alerts(df, 5.0)
    cut = detectors.price_change_alerts(df, 5.0, task_rows=20)
    alerts = [sorted(map(str, out.collect())) for out in (whole, cut)]
    assert alerts[0] == alerts[1]
    assert whole.where("ticker is null").count() > 0


@pytest.mark.parametrize("seed,chunk_ms", [(1, 60_000), (2, 5_000), (3, 3_600_000), (11, None)])
@pytest.mark.parametrize("threshold", [0.0, 5.0, 50.0])
def test_change_detector_matches_sequential_model(spark, seed, chunk_ms, threshold):
    rows = random_rows(seed)
    expect = change_model([(t, c, d) for t, _, d, c, _ in rows], threshold)
    df = spark.createDataFrame(rows, SCHEMA)
    got = detectors.price_change_alerts(df, threshold, chunk_ms=chunk_ms).collect()
    got = sorted((r.ticker, r.datetime, r.previous_price, r.current_price, r.price_change_percentage) for r in got)
    expect = sorted(expect)
    assert len(got) == len(expect)
    for g, e in zip(got, expect):
        assert all(_same(x, y) for x, y in zip(g, e)), (g, e)


@pytest.mark.parametrize("seed", [4, 5])
def test_target_detector_matches_sequential_model(spark, seed):
    rows = random_rows(seed)
    expect = sorted(target_model([(t, c, d) for t, _, d, c, _ in rows], 150.0))
    df = spark.createDataFrame(rows, SCHEMA)
    got = detectors.target_price_alerts(df, 150.0).collect()
    assert sorted((r.ticker, r.datetime, r.current_price) for r in got) == expect
    assert all(r.alert_type == "target_price" and r.target_price == 150.0 for r in got)


@pytest.mark.parametrize("seed", [6, 7, 8])
def test_streaming_steps_match_model_for_any_batch_split(seed):
    rows = random_rows(seed, n=1500, tickers=10)
    rnd = random.Random(seed)
    expect_c = sorted(change_model([(t, c, d) for t, _, d, c, _ in rows], 5.0))
    expect_t = sorted(target_model([(t, c, d) for t, _, d, c, _ in rows], 150.0))
    state_c, state_t, got_c, got_t = {}, {}, [], []
    i = 0
    while i < len(rows):
        j = min(len(rows), i + rnd.randrange(1, 200))
        batch = rows[i:j]
        i = j
        for t in {r[0] for r in batch}:
            part = [r for r in batch if r[0] == t and r[3] is not None]
            closes = np.array([r[3] for r in part], dtype="float64")
            idx, prev, chg, new_state = change_step(closes, state_c.get(t), 5.0)
            got_c += [(t, part[k][2], p, part[k][3], c) for k, p, c in zip(idx, prev, chg)]
            if new_state is not None:
                state_c[t] = new_state
            k = target_step(closes, state_t.get(t, False), 150.0)
            if k is not None:
                state_t[t] = True
                got_t.append((t, part[k][2], part[k][3]))
    assert sorted(got_t) == expect_t
    got_c = sorted(got_c)
    assert len(got_c) == len(expect_c)
    for g, e in zip(got_c, expect_c):
        assert all(_same(float(x) if isinstance(x, np.floating) else x, y) for x, y in zip(g, e))


def _ticks(spark, closes, ticker="A"):
    rows = [(ticker, 1000 * (i + 1), f"t{i}", c, i) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, SCHEMA)


def test_zero_close_latches_the_ticker(spark):
    # 10 -> 0 alerts (-100%), after that the state is stuck at 0
    out = detectors.price_change_alerts(_ticks(spark, [10.0, 0.0, 20.0, 40.0, 80.0]), 5.0).collect()
    assert [(r.previous_price, r.current_price, r.price_change_percentage) for r in out] == [
        (10.0, 0.0, -100.0)
    ]
    skip = detectors.price_change_alerts(
        _ticks(spark, [10.0, 0.0, 20.0, 40.0]), 5.0, zero_policy="skip"
    ).collect()
    assert sorted(r.current_price for r in skip) == [20.0, 40.0]


def test_threshold_is_inclusive_after_rounding(spark):
    # +5.0% exactly, and 4.996% which rounds to 5.0
    out = detectors.price_change_alerts(_ticks(spark, [100.0, 105.0, 110.2462]), 5.0).collect()
    assert sorted(r.price_change_percentage for r in out) == [5.0, 5.0]


def test_target_crossed_twice_alerts_once(spark):
    out = detectors.target_price_alerts(_ticks(spark, [90.0, 101.0, 80.0, 120.0]), 100.0).collect()
    assert [(r.datetime, r.current_price) for r in out] == [("t1", 101.0)]


def test_target_nan_and_null_never_fire(spark):
    out = detectors.target_price_alerts(
        _ticks(spark, [None, float("nan"), 99.0, float("inf")]), 100.0
    ).collect()
    assert [r.current_price for r in out] == [float("inf")]


def test_nan_close_suppresses_the_next_comparison(spark):
    out = detectors.price_change_alerts(_ticks(spark, [10.0, float("nan"), 20.0, 40.0]), 5.0).collect()
    assert [(r.previous_price, r.current_price) for r in out] == [(20.0, 40.0)]


def test_alert_union_has_both_shapes(spark):
    ticks = _ticks(spark, [90.0, 101.0, 80.0])
    u = detectors.alerts_union(
        detectors.target_price_alerts(ticks, 100.0), detectors.price_change_alerts(ticks, 5.0)
    )
    rows = u.collect()
    assert sorted(r.alert_type for r in rows) == ["percentage_change", "percentage_change", "target_price"]
    assert [f.name for f in u.schema.fields] == [
        "ticker", "datetime", "timestamp", "target_price", "previous_price",
        "current_price", "price_change_percentage", "alert_type",
    ]


def test_measured_chunks_match_the_model(spark):
    # a third of all rows in one ticker, windows of about 50 rows
    rows = [(("HOT" if i % 3 == 0 else r[0]), *r[1:]) for i, r in enumerate(random_rows(12))]
    expect = sorted(change_model([(t, c, d) for t, _, d, c, _ in rows], 5.0))
    df = spark.createDataFrame(rows, SCHEMA)
    out = detectors.price_change_alerts(df, 5.0, task_rows=50)
    assert "_chunk" in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.ticker, r.datetime, r.previous_price, r.current_price, r.price_change_percentage) for r in out.collect())
    assert len(got) == len(expect)
    for g, e in zip(got, expect):
        assert all(_same(x, y) for x, y in zip(g, e)), (g, e)


def _counts(df, task_rows, order=("timestamp", "seq")):
    rows = detectors.even_chunks(detectors.detector_rows(df, "ticker", order), order, task_rows)
    if "_chunk" not in rows.columns:
        return None
    return {(r["_k"], r["_chunk"]): r["count"] for r in rows.groupBy("_k", "_chunk").count().collect()}


def test_a_burst_spreads_over_even_chunks(spark):
    # HOT: 95 % of its rows in one minute, many of them in the same millisecond
    burst = spark.range(19_000).selectExpr("'HOT' AS ticker", "1000000 + (id div 400) AS timestamp", "id AS seq")
    rest = spark.range(1_000).selectExpr("'HOT' AS ticker", "id * 3600000 AS timestamp", "id AS seq")
    cold = spark.range(900).selectExpr("string(id % 30) AS ticker", "id * 1000 AS timestamp", "id AS seq")
    both = burst.unionByName(rest).unionByName(cold).selectExpr("*", "'x' AS datetime", "double(seq % 97) + 1 AS close")
    counts = _counts(both, 2_000)
    hot = [n for (k, _), n in counts.items() if k == "HOT"]
    assert len(hot) >= 10 and sum(hot) == 20_000 and max(hot) <= 4_000
    assert {c for (k, c) in counts if k != "HOT"} == {0}
    assert _counts(both, 20_000) is None  # windowed whole


def _tied_rows(seed, n=600):
    """Rows that tie on all order columns, null order values, few closes."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        ts = rnd.choice([None, *range(1000, 1040)])
        rows.append((rnd.choice(["A", "A", "A", "B", None]), ts, f"d{i % 7}",
                     rnd.choice([1.0, 2.0, 4.0, float("nan"), 3.0]), rnd.choice([None, 1, 2])))
    return rows


@pytest.mark.parametrize("order", [("timestamp", "seq"), ("timestamp",), ("datetime",), ("day", "seq")])
def test_alerts_are_equal_at_every_width_on_ties_nulls_text_and_dates(spark, order):
    df = spark.createDataFrame(_tied_rows(21), SCHEMA).selectExpr(
        "*", "date_add(DATE'2024-01-01', cast(timestamp % 9 AS int)) AS day"
    )
    whole = sorted(map(str, detectors.price_change_alerts(df, 5.0, order_by=order).collect()))
    assert whole
    for task_rows in (7, 40, 200):
        cut = detectors.price_change_alerts(df, 5.0, order_by=order, task_rows=task_rows)
        assert sorted(map(str, cut.collect())) == whole, task_rows
    for chunk_ms in (1, 10, 1000):
        cut = detectors.price_change_alerts(df, 5.0, order_by=order, chunk_ms=chunk_ms)
        assert sorted(map(str, cut.collect())) == whole, chunk_ms


def test_zero_latch_crosses_borders(spark):
    rows = [("A", 1000 + i, f"t{i}", 0.0 if i == 130 else float(1 + i % 5), i) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = detectors.price_change_alerts(df, 5.0)
    cut = detectors.price_change_alerts(df, 5.0, task_rows=30)
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
    assert cut.agg({"timestamp": "max"}).first()[0] == 1130


def test_alerts_do_not_depend_on_the_chunk_width(spark):
    from pyspark.sql import functions as F

    from tickwarden.sources.tables import event_ticks

    ticks = event_ticks(spark, "/root/testdata/sf0.01")
    whole = detectors.price_change_alerts(ticks, 500.0)
    for width in (60_000, 86_400_000):
        cut = detectors.price_change_alerts(ticks, 500.0, chunk_ms=width)
        assert cut.exceptAll(whole).count() == 0 and whole.exceptAll(cut).count() == 0
    assert whole.where(F.col("previous_price").isNull()).count() == 0


def test_parameter_checks(spark):
    ticks = _ticks(spark, [1.0, 2.0])
    with pytest.raises(ValueError):
        detectors.price_change_alerts(ticks, 5.0, chunk_ms=0)
    with pytest.raises(ValueError):
        detectors.price_change_alerts(ticks, 5.0, zero_policy="other")


def test_chunks_follow_the_leading_order_column(spark):
    # arrival order by seq while timestamps are shuffled: chunks must be
    # cut on seq, or the carry between chunks would follow the wrong order
    rnd = random.Random(9)
    rows = random_rows(10, n=1500, tickers=8)
    stamps = [r[1] for r in rows]
    rnd.shuffle(stamps)
    rows = [(t, ts, d, c, seq) for (t, _, d, c, seq), ts in zip(rows, stamps)]
    expect = sorted(change_model([(t, c, d) for t, _, d, c, _ in rows], 5.0))
    df = spark.createDataFrame(rows, SCHEMA)
    got = detectors.price_change_alerts(df, 5.0, order_by=("seq",), chunk_ms=37).collect()
    got = sorted((r.ticker, r.datetime, r.previous_price, r.current_price, r.price_change_percentage) for r in got)
    assert len(got) == len(expect)
    for g, e in zip(got, expect):
        assert all(_same(x, y) for x, y in zip(g, e)), (g, e)
