import json

from tickwarden.operators import detectors
from tickwarden.session import scratch_path
from tickwarden.streaming import jobs
from tickwarden.streaming.replay import replay, replay_with_restart
from tickwarden.sources import files


def _tick(ticker, ts, close):
    return json.dumps({"ticker": ticker, "timestamp": ts, "datetime": f"d{ts}", "open": close,
                       "close": close, "high": close, "low": close, "volume": 1.0, "vwap": close,
                       "number_of_trades": 1})


def _feed(spark):
    # offsets are arrival order; ticker A's rows 3 and 4 arrive reversed
    # in one slice but the processor sorts a batch by (timestamp, offset)
    rows = [
        (_tick("A", 1, 10.0), 0), (_tick("B", 1, 50.0), 1), (_tick("A", 2, 12.0), 2),
        (_tick("A", 4, 30.0), 4), (_tick("A", 3, 0.5), 3), ("not json", 5),
        (_tick("B", 2, 60.0), 6), (_tick("A", 5, 31.0), 7), (_tick("B", 3, 100.0), 8),
        (_tick("A", 6, 200.0), 9),
        # NaN close (becomes the previous value, suppresses one comparison),
        # a null close (no effect), infinities and a zero (the latch)
        (_tick("C", 1, 10.0), 10), (_tick("C", 2, float("nan")), 11), (_tick("C", 3, 50.0), 12),
        (_tick("C", 4, 60.0).replace("60.0", "null"), 13), (_tick("C", 5, 80.0), 14),
        (_tick("D", 1, 5.0), 15), (_tick("D", 2, float("inf")), 16), (_tick("D", 3, 7.0), 17),
        (_tick("E", 1, 5.0), 18), (_tick("E", 2, 0.0), 19), (_tick("E", 3, 7.0), 20),
        # a tick without timestamp sorts first within its batch (nulls first)
        (_tick("F", 1, 20.0), 21), (_tick("F", None, 10.0), 22),
    ]
    return spark.createDataFrame(rows, "value string, offset long")


def _batch_expect(spark, feed):
    from tickwarden.operators import decode

    good, _ = decode.decode(feed, keep=("offset",))
    return detectors.alerts_union(
        detectors.target_price_alerts(good, 99.0, order_by=("offset",)),
        detectors.price_change_alerts(good, 10.0, order_by=("offset",)),
    )


def _rows(df):
    return sorted(tuple(repr(x) for x in r) for r in df.collect())


import pytest  # noqa: E402


@pytest.mark.parametrize("api", ["pandas_with_state", "transform_with_state"])
def test_stream_equals_batch_with_running_query_and_with_restarts(spark, api):
    feed = _feed(spark)
    expect = _rows(_batch_expect(spark, feed))
    assert len(expect) > 3
    for restart in (False, True):
        base = scratch_path(spark, "test-stream")
        land, out, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"

        def build():
            ticks = jobs.decoded_ticks(files.stream_topic(spark, land))
            return jobs.alert_stream(ticks, 99.0, 10.0, api=api)

        if restart:
            replay_with_restart(feed, land, lambda: jobs.start_parquet_sink(build(), out, ckpt, available_now=True), slices=3)
        else:
            replay(feed, land, lambda: jobs.start_parquet_sink(build(), out, ckpt), slices=3)
        assert _rows(spark.read.parquet(out)) == expect


def test_stream_quarantine(spark):
    feed = _feed(spark)
    base = scratch_path(spark, "test-quarantine")
    land, out, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    replay(feed, land, lambda: jobs.start_parquet_sink(jobs.quarantined(files.stream_topic(spark, land)), out, ckpt), slices=2)
    rows = spark.read.parquet(out).collect()
    assert [(r.value, r.reason, r.offset) for r in rows] == [("not json", "malformed", 5)]


def test_stream_bars_all_spans_equal_batch_bars(spark):
    from tickwarden.operators import bars as bars_op
    from tickwarden.operators import decode

    rows = []
    ts = 1704067200000  # 2024-01-01, a Monday
    for i in range(400):
        ts += 3_600_000 * 5 + i  # increasing, several weeks and two months
        rows.append((_tick("A" if i % 3 else "B", ts, float(10 + i % 17)), i))
    feed = spark.createDataFrame(rows, "value string, offset long")
    good, _ = decode.decode(feed, keep=("offset",))
    for m, span in [(2, "hour"), (1, "week"), (1, "month")]:
        expect = sorted(tuple(repr(x) for x in r) for r in bars_op.bars(good, m, span, order_by=("timestamp", "offset")).collect())
        base = scratch_path(spark, f"test-bars-{span}")
        land, out, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"

        def start():
            ticks = jobs.decoded_ticks(files.stream_topic(spark, land))
            return jobs.start_bar_sink(jobs.bar_stream(ticks, m, span), out, ckpt)

        replay(feed, land, start, slices=3)
        got = jobs.latest_bars(spark, out, m, span).select(*bars_op.BAR_FIELDS)
        assert sorted(tuple(repr(x) for x in r) for r in got.collect()) == expect, span


def test_split_sink_writes_both_outputs_once(spark):
    feed = _feed(spark)
    base = scratch_path(spark, "test-split")
    land, ckpt = f"{base}/in", f"{base}/ckpt"
    replay(feed, land, lambda: jobs.start_split_sink(files.stream_topic(spark, land), f"{base}/good", f"{base}/bad", ckpt), slices=3)
    good = spark.read.parquet(f"{base}/good")
    bad = spark.read.parquet(f"{base}/bad")
    assert good.count() == 22 and good.select("offset").distinct().count() == 22
    assert [(r.value, r.reason) for r in bad.collect()] == [("not json", "malformed")]


def test_debug_memory_sink(spark):
    feed = _feed(spark)
    base = scratch_path(spark, "test-debug")
    feed.write.parquet(f"{base}/in")
    q = jobs.start_debug_sink(files.stream_topic(spark, f"{base}/in"), "memory", "tw_debug_tail")
    q.processAllAvailable()
    q.stop()
    assert spark.table("tw_debug_tail").count() == 23


def test_apps_on_files(spark):
    import pytest

    from tickwarden.operators import points
    from tickwarden.streaming import apps

    base = scratch_path(spark, "test-apps")
    alerts = [
        '{"ticker":"A","datetime":"t1","target_price":100.0,"current_price":101.0,"alert_type":"target_price"}',
        '{"ticker":"A","datetime":"t2","timestamp":2,"previous_price":90.0,"current_price":101.0,'
        '"price_change_percentage":12.22,"alert_type":"percentage_change"}',
        '{"ticker":"A","alert_type":"other"}', "garbage", "{}",
    ]
    spark.createDataFrame([(a, i) for i, a in enumerate(alerts)], "value string, offset long").write.parquet(f"{base}/alerts")
    q = apps.message_app(files.stream_topic(spark, f"{base}/alerts"), f"{base}/ck1", out=f"{base}/msgs", trigger="availableNow")
    q.awaitTermination()
    msgs = sorted(r.message for r in spark.read.parquet(f"{base}/msgs").collect())
    assert msgs == [
        "t1 A price has reached the target of $100.0. Current price: $101.0",
        "t2 A price has increased by 12.22%. Current price: $101.0",
    ]

    snaps = ['{"current": {"time": "x", "interval": 900, "temperature_2m": 20.5, "rain": 0}}', '{"hourly": {}}']
    spark.createDataFrame([(v, i) for i, v in enumerate(snaps)], "value string, offset long").write.parquet(f"{base}/snaps")
    apps.route_app(files.stream_topic(spark, f"{base}/snaps"), f"{base}/ck2", out=f"{base}/routed", trigger="availableNow").awaitTermination()
    routed = sorted((r.topic, r.value) for r in spark.read.parquet(f"{base}/routed").collect())
    assert routed == [("rain", "0"), ("temperature_2m", "20.5")]
    apps.route_app(files.stream_topic(spark, f"{base}/snaps"), f"{base}/ck5", out=f"{base}/routed2",
                   trigger="availableNow", quarantine=f"{base}/rejected").awaitTermination()
    routed2 = sorted((r.topic, r.value) for r in spark.read.parquet(f"{base}/routed2").collect())
    assert routed2 == routed
    assert [(r.value, r.reason) for r in spark.read.parquet(f"{base}/rejected").collect()] == [
        ('{"hourly": {}}', "missing_timespan")]

    pts = ['{"ticker": "A", "close": "1.005", "datetime": "2025-01-01T00:00:00Z"}', '{"ticker": "A", "close": 2.0, "datetime": "2025-01-01T00:00:00"}']
    spark.createDataFrame([(v, i) for i, v in enumerate(pts)], "value string, offset long").write.parquet(f"{base}/pts")
    apps.point_app(files.stream_topic(spark, f"{base}/pts"), f"{base}/ck3", f"{base}/points", trigger="availableNow").awaitTermination()
    assert [r.price for r in points.upsert_points(spark.read.parquet(f"{base}/points")).collect()] == [2.0]

    with pytest.raises(ValueError):
        apps.message_app(files.stream_topic(spark, f"{base}/alerts"), f"{base}/ck4")


def test_stream_zero_policy_skip_equals_batch(spark):
    from tickwarden.operators import decode

    feed = _feed(spark)
    good, _ = decode.decode(feed, keep=("offset",))
    expect = _rows(detectors.price_change_alerts(good, 10.0, order_by=("offset",), zero_policy="skip"))
    base = scratch_path(spark, "test-skip")
    land, out, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"

    def build():
        ticks = jobs.decoded_ticks(files.stream_topic(spark, land))
        return jobs.alert_stream(ticks, None, 10.0, zero_policy="skip")

    replay(feed, land, lambda: jobs.start_parquet_sink(build(), out, ckpt), slices=3)
    got = spark.read.parquet(out).select("ticker", "datetime", "timestamp", "previous_price", "current_price",
                                         "price_change_percentage", "alert_type")
    assert _rows(got) == expect
    assert any("'E'" in r[0] for r in expect)  # ticker E alerts after its zero under "skip"


def test_command_line_alerts_app(spark):
    from tickwarden.__main__ import run

    feed = _feed(spark)
    base = scratch_path(spark, "test-cli")
    feed.write.parquet(f"{base}/in")
    run(["alerts", "--source", f"{base}/in", "--target", "99", "--threshold", "10",
         "--checkpoint", f"{base}/ck", "--out", f"{base}/out", "--quarantine", f"{base}/bad", "--once"],
        spark=spark)
    got = spark.read.parquet(f"{base}/out")
    assert set(got.columns) == {"key", "value"}
    assert got.count() == len(_batch_expect(spark, feed).collect())
    bad = spark.read.parquet(f"{base}/bad").collect()
    assert [(r.value, r.reason) for r in bad] == [("not json", "malformed")]


def test_whole_file_snapshots_stream_as_one_record_each(spark, tmp_path):
    from tickwarden.operators import routing

    land = tmp_path / "snaps"
    land.mkdir()
    for i in range(2):  # one pretty-printed document per poll, as landed
        (land / f"poll{i}.json").write_text(json.dumps({"current": {"time": "t", "interval": 900, "rain": i}}, indent=2))
    base = scratch_path(spark, "test-wholetext")
    stream = files.stream_text(spark, str(land), whole_text=True)
    q = jobs.start_parquet_sink(routing.route_fields(stream), f"{base}/out", f"{base}/ck", available_now=True)
    q.awaitTermination()
    assert sorted((r.topic, r.value) for r in spark.read.parquet(f"{base}/out").collect()) == [("rain", "0"), ("rain", "1")]


def test_command_line_points_messages_route(spark):
    from tickwarden.__main__ import run

    base = scratch_path(spark, "test-cli2")
    pts = ['{"ticker": "A", "close": "1.5", "datetime": "2025-01-01T00:00:00Z"}']
    alerts = ['{"ticker":"A","datetime":"t","target_price":1.0,"current_price":2.0,"alert_type":"target_price"}']
    snaps = ['{"current": {"time": "x", "rain": 1}}', '{"other": {}}']
    for name, values in (("pts", pts), ("alerts", alerts), ("snaps", snaps)):
        spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value string, offset long").write.parquet(f"{base}/{name}")
    run(["points", "--source", f"{base}/pts", "--checkpoint", f"{base}/c1", "--out", f"{base}/o1", "--once"], spark=spark)
    run(["messages", "--source", f"{base}/alerts", "--checkpoint", f"{base}/c2", "--out", f"{base}/o2", "--once"], spark=spark)
    run(["route", "--source", f"{base}/snaps", "--checkpoint", f"{base}/c3", "--out", f"{base}/o3",
         "--quarantine", f"{base}/q3", "--once"], spark=spark)
    assert [r.price for r in spark.read.parquet(f"{base}/o1").collect()] == [1.5]
    assert [r.message for r in spark.read.parquet(f"{base}/o2").collect()] == [
        "t A price has reached the target of $1.0. Current price: $2.0"]
    assert [(r.topic, r.value) for r in spark.read.parquet(f"{base}/o3").collect()] == [("rain", "1")]
    assert spark.read.parquet(f"{base}/q3").count() == 1


def test_month_bars_keep_a_row_two_seconds_late(spark, tmp_path):
    from tickwarden.streaming import jobs

    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "ticker string, timestamp long, close double, size long, offset long"
    month = 1_706_745_600_000  # 2024-02-01

    def bars():
        ticks = spark.readStream.schema(schema).parquet(src)
        return jobs.start_bar_sink(jobs.bar_stream(ticks, 1, "month"), out, ckpt)
    batches = [("A", month - 5000, 1.0, 1, 0)], [("A", month + 1000, 2.0, 1, 1)], [("A", month - 1000, 3.0, 1, 2)]
    query = None
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        query = query or bars()
        query.processAllAvailable()
    query.stop()
    got = {r.timestamp: r for r in jobs.latest_bars(spark, out, 1, "month").collect()}
    assert got[1_704_067_200_000].number_of_trades == 2 and got[1_704_067_200_000].close == 3.0
    assert got[month].number_of_trades == 1


def test_message_app_quarantine(spark, tmp_path):
    from tickwarden.sources import files
    from tickwarden.streaming import apps

    src, out, bad = (str(tmp_path / n) for n in ("in", "out", "bad"))
    good = '{"ticker":"A","datetime":"d","target_price":1.0,"current_price":2.0,"alert_type":"level"}'
    spark.createDataFrame([(good, 0), (good.replace("level", "x"), 1), ("?", 2)], "value string, offset long").write.parquet(src)
    apps.message_app(files.stream_topic(spark, src), str(tmp_path / "ck"), out=out, trigger="availableNow",
                     quarantine=bad, target_type="level").awaitTermination()
    assert spark.read.parquet(out).count() == 1
    assert sorted(r.reason for r in spark.read.parquet(bad).collect()) == ["malformed", "unknown_alert_type"]


def test_a_fresh_stream_goes_on_from_the_state_of_a_history(spark):
    from tickwarden.operators import detectors
    from tickwarden.session import scratch_path
    from tickwarden.streaming import jobs

    nan = float("nan")
    closes = {"A": [10.0, 300.0, 20.0, 40.0], "B": [5.0, 0.0, 7.0, 9.0], "C": [1.0, nan, 2.0, 9.0], "D": [None, None, 3.0, 400.0]}
    rows = [(t, 1000 * i, f"d{i}", c, i) for t, cs in closes.items() for i, c in enumerate(cs)]
    rows.append(("E", 5000, "d5", 260.0, 5))
    ddl = "ticker string, timestamp long, datetime string, close double, offset long"
    df = spark.createDataFrame(rows, ddl)
    whole = detectors.alerts_union(
        detectors.target_price_alerts(df, 250.0, order_by=["offset"]),
        detectors.price_change_alerts(df, 50.0, order_by=["offset"]),
    )
    history = df.where("offset < 2")
    state = detectors.detector_state(history, 250.0, order_by=["offset"])
    assert {r.ticker: (r.latched, str(r.last_close)) for r in state.collect()} == {
        "A": (True, "300.0"), "B": (False, "0.0"), "C": (False, "nan")}
    base = scratch_path(spark, "test-state")
    df.where("offset >= 2").coalesce(1).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(ddl).parquet(f"{base}/in")
    later = jobs.alert_stream(stream, 250.0, 50.0, api="transform_with_state", initial_state=state)
    jobs.start_parquet_sink(later, f"{base}/out", f"{base}/ck", available_now=True).awaitTermination()
    both = detectors.alerts_union(
        detectors.target_price_alerts(history, 250.0, order_by=["offset"]),
        detectors.price_change_alerts(history, 50.0, order_by=["offset"]), spark.read.parquet(f"{base}/out"))
    assert sorted(map(str, both.collect())) == sorted(map(str, whole.collect()))
    # what the checkpoint holds is the state of the whole history
    want = detectors.detector_state(df, 250.0, order_by=["offset"])
    assert sorted(map(str, jobs.stored_state(spark, f"{base}/ck").collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        jobs.alert_stream(stream, 250.0, 50.0, initial_state=state)


def test_documents_land_as_files_side_by_side_and_slices_are_spread(spark, tmp_path):
    from tickwarden.sources import landing
    from tickwarden.sources.tables import event_ticks
    from tickwarden.streaming.replay import land_slice

    docs = spark.createDataFrame([(f"p{i}", "{\n  1\n}" * i) for i in range(1, 8)], "poll string, value string")
    landing.land_documents(docs, str(tmp_path / "docs"))
    assert not [p for p in (tmp_path / "docs").iterdir() if p.is_dir()]
    found = spark.read.text(str(tmp_path / "docs"), wholetext=True)
    assert sorted(r.value.rstrip("\n") for r in found.collect()) == sorted(r.value for r in docs.collect())
    ev = spark.range(4000).selectExpr("id event_id", "timestamp_ntz'2024-01-01 00:00:00' ts", "id % 9 user_id",
                                      "'view' event_type", "id * 0.5D value", "'{\"k\": 3}' props")
    ev.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    tasks = lambda df: {r[0] for r in df.selectExpr("spark_partition_id()").distinct().collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert len(tasks(event_ticks(spark, str(tmp_path)).where("seq < 1000"))) == 1
        feed = landing.tick_feed(spark, str(tmp_path))
        assert len(tasks(feed.where("offset < 1000"))) > 1
        land_slice(feed, str(tmp_path / "in"), 0, 1000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spark.read.parquet(str(tmp_path / "in")).count() == 1000
