"""Property tests (hypothesis) of the streaming step functions.

Any sequence of closes, cut into micro-batches at any points, must give
the alerts of the sequential model.  No Spark needed: the functions are
the numpy core of the stateful processor.
"""

from decimal import Decimal
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from model import change_model, target_model

from tickwarden.streaming.processor import change_step, target_step

closes = st.one_of(
    st.sampled_from([None, 0.0, -0.0, float("nan"), float("inf"), float("-inf")]),
    st.floats(min_value=-1e6, max_value=1e6, allow_nan=False),
    st.integers(min_value=1, max_value=50_000).map(lambda c: c / 100),
)


def _same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


def _run(values, cuts, threshold, target):
    rows = [("T", c, i) for i, c in enumerate(values)]
    state_c, latched, got_c, got_t = None, False, [], []
    bounds = sorted(set([0, len(rows)] + [c % (len(rows) + 1) for c in cuts]))
    for lo, hi in zip(bounds, bounds[1:]):
        part = [r for r in rows[lo:hi] if r[1] is not None]
        arr = np.array([r[1] for r in part], dtype="float64")
        idx, prev, chg, new_state = change_step(arr, state_c, threshold)
        got_c += [("T", part[k][2], float(p), part[k][1], float(c)) for k, p, c in zip(idx, prev, chg)]
        if new_state is not None:
            state_c = new_state
        k = target_step(arr, latched, target)
        if k is not None:
            latched = True
            got_t.append(("T", part[k][2], part[k][1]))
    return got_c, got_t


@settings(max_examples=300, deadline=None)
@given(
    values=st.lists(closes, min_size=0, max_size=60),
    cuts=st.lists(st.integers(min_value=0, max_value=100), max_size=8),
    threshold=st.sampled_from([0.0, 1.0, 5.0, 100.0]),
    target=st.sampled_from([0.0, 10.0, 250.0]),
)
def test_steps_equal_sequential_model_for_any_batching(values, cuts, threshold, target):
    got_c, got_t = _run(values, cuts, threshold, target)
    rows = [("T", c, i) for i, c in enumerate(values)]
    expect_c = change_model(rows, threshold)
    expect_t = target_model(rows, target)
    assert got_t == expect_t
    assert len(got_c) == len(expect_c)
    for g, e in zip(got_c, expect_c):
        assert all(_same(x, y) for x, y in zip(g, e)), (g, e)


@settings(max_examples=15, deadline=None)
@given(
    values=st.lists(st.tuples(st.sampled_from(["A", "B", "C"]), closes), min_size=1, max_size=80),
    threshold=st.sampled_from([0.0, 5.0, 50.0]),
)
def test_chunked_batch_detector_equals_model(spark, values, threshold):
    from tickwarden.operators import detectors

    rows = [(t, i * 1, f"d{i}", c, i) for i, (t, c) in enumerate(values)]
    df = spark.createDataFrame(rows, "ticker string, timestamp long, datetime string, close double, seq long")
    # 2 ms chunks: almost every row sits at a chunk border
    got = detectors.price_change_alerts(df, threshold, chunk_ms=2).collect()
    got = sorted((r.ticker, r.datetime, r.previous_price, r.current_price, r.price_change_percentage) for r in got)
    expect = sorted(change_model([(t, c, d) for t, _, d, c, _ in rows], threshold))
    assert len(got) == len(expect)
    for g, e in zip(got, expect):
        assert all(_same(x, y) for x, y in zip(g, e)), (g, e)


tick_values = st.one_of(
    st.none(),
    st.floats(allow_nan=True, allow_infinity=True, width=64),
    st.integers(min_value=-(2**53), max_value=2**53).map(float),
)


@settings(max_examples=10, deadline=None)
@given(
    st.lists(
        st.fixed_dictionaries(
            {
                "ticker": st.one_of(st.none(), st.text(min_size=1, max_size=6)),
                "timestamp": st.one_of(st.none(), st.integers(min_value=-(2**62), max_value=2**62)),
                "datetime": st.one_of(st.none(), st.text(max_size=10)),
                "open": tick_values, "close": tick_values, "high": tick_values,
                "low": tick_values, "volume": tick_values, "vwap": tick_values,
                "number_of_trades": st.one_of(st.none(), st.integers(min_value=0, max_value=2**62)),
            }
        ),
        min_size=1,
        max_size=40,
    )
)
def test_decode_round_trips_python_json(spark, ticks):
    import json as _json

    from tickwarden.operators import decode

    texts = [(_json.dumps(t), i) for i, t in enumerate(ticks)]
    good, bad = decode.decode(spark.createDataFrame(texts, "value string, offset long"), keep=("offset",))
    got = {r.offset: r.asDict() for r in good.collect()}
    reasons = {r.offset: r.reason for r in bad.collect()}
    for i, t in enumerate(ticks):
        if t["ticker"] is None:
            assert reasons[i] == "missing_ticker"
            continue
        row = got[i]
        for k, v in t.items():
            assert _same(row[k], v) or row[k] == v, (k, row[k], v)


@settings(max_examples=8, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["A", "B"]),
            st.integers(min_value=1_704_067_200_000, max_value=1_704_067_200_000 + 3 * 86_400_000),
            st.integers(min_value=1, max_value=99_999).map(lambda c: c / 100),
            st.integers(min_value=0, max_value=50),
        ),
        min_size=1,
        max_size=120,
    ),
    st.sampled_from([(1, "day", 86_400_000), (5, "minute", 300_000)]),
)
def test_bars_equal_python_ohlcv(spark, trades, span):
    from tickwarden.operators import bars

    m, timespan, width = span
    rows = [(t, ts, c, k, i) for i, (t, ts, c, k) in enumerate(trades)]
    df = spark.createDataFrame(rows, "ticker string, timestamp long, close double, size long, seq long")
    got = {(r.ticker, r.timestamp): r for r in bars.bars(df, m, timespan).collect()}
    groups = {}
    for t, ts, c, k, i in rows:
        groups.setdefault((t, ts - ts % width), []).append((ts, i, c, k))
    assert got.keys() == groups.keys()
    for key, g in groups.items():
        g.sort()
        r = got[key]
        volume = float(sum(k for *_, k in g))
        notional = float(sum(Decimal(str(c)) * k for _, _, c, k in g))
        assert (r.open, r.close) == (g[0][2], g[-1][2])
        assert (r.high, r.low) == (max(c for _, _, c, _ in g), min(c for _, _, c, _ in g))
        assert (r.volume, r.number_of_trades) == (volume, len(g))
        assert r.vwap == (None if volume == 0 else notional / volume)


def test_streaming_step_orders_text_and_null_keys_like_the_batch_window():
    import pandas as pd

    from tickwarden.streaming.processor import AlertLogic

    logic = AlertLogic(None, 5.0, order_by=("dt", "offset"))
    frame = pd.DataFrame({
        "ticker": ["A"] * 4,
        "timestamp": [3, 1, 2, 4],
        "datetime": ["c", "a", "b", None],
        "dt": ["2024-01-03", "2024-01-01", "2024-01-02", None],  # text order column, one null
        "close": [30.0, 10.0, 20.0, 5.0],
        "offset": [0, 1, 2, 3],
    })
    out, _, last = logic.step([frame], False, None)
    # order: null (5.0), 01 (10.0), 02 (20.0), 03 (30.0)
    assert list(out["current_price"]) == [10.0, 20.0, 30.0]
    assert list(out["previous_price"]) == [5.0, 10.0, 20.0]
    assert last == 30.0


def test_detectors_of_many_tickers_at_once_equal_one_by_one():
    import random

    import pandas as pd

    from tickwarden.streaming.processor import NULL_INT, AlertLogic

    rng = random.Random(3)
    logic = AlertLogic(40.0, 25.0, order_by=("timestamp", "offset"))
    held, single = {}, {}
    same = lambda states: {k: (v[0], repr(v[1])) for k, v in states.items()}
    for _ in range(30):
        rows = [(rng.choice(["a", "b", "c", "d", None]), rng.choice([NULL_INT, 5, 6, 7]), "d",
                 rng.choice([0.0, 1.0, 30.0, 50.0, 60.0, 60.0, 70.0, float("nan"), float("inf")]), i)
                for i in range(rng.randrange(1, 12))]
        batch = pd.DataFrame(rows, columns=["ticker", "timestamp", "datetime", "close", "offset"])
        out, changed = logic.steps([batch], held)
        held.update(changed)
        found = [] if out is None else [tuple(map(str, r)) for r in out.astype(object).to_numpy()]
        want = []
        for ticker in {r[0] for r in rows}:
            mine = pd.DataFrame([r for r in rows if r[0] == ticker], columns=batch.columns)
            one, latched, close = logic.step([mine], *single.get(ticker, (False, None)))
            if latched or close is not None:
                single[ticker] = (latched, close)
            if one is not None:
                one["timestamp"] = one["timestamp"].mask(one["timestamp"] == NULL_INT)
                want += [tuple(map(str, r)) for r in one.astype(object).to_numpy()]
        assert sorted(found) == sorted(want) and same(held) == same(single)
        if rng.random() < 0.2:
            held, single = {}, {}


def test_state_of_a_stream_is_kept_by_shard(spark):
    from tickwarden.operators import detectors
    from tickwarden.session import scratch_path
    from tickwarden.streaming import jobs

    nan, inf = float("nan"), float("inf")
    ddl = "ticker string, timestamp long, datetime string, close double, offset long"
    odd = [("n\"a", nan), ("in", inf), ("-in", -inf), ("zero", 0.0), ("é", 0.1 + 0.2)]
    rows = [(t, None if i % 2 else i, "d", c, i) for i, (t, c) in enumerate(odd)]
    rows += [(f"T{i}", i, "d", 1.0 + i, 10 + i) for i in range(3 * jobs.SHARDS)]
    base = scratch_path(spark, "test-shard-state")
    ticks = spark.createDataFrame(rows, ddl)
    ticks.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(ddl).parquet(f"{base}/in")
    jobs.start_parquet_sink(jobs.alert_stream(stream, 500.0, 10.0), f"{base}/out", f"{base}/ck", available_now=True).awaitTermination()
    assert spark.read.format("statestore").load(f"{base}/ck").count() <= jobs.SHARDS
    want = detectors.detector_state(ticks.withColumnRenamed("offset", "seq"), 500.0)
    assert sorted(map(str, jobs.stored_state(spark, f"{base}/ck").collect())) == sorted(map(str, want.collect()))
