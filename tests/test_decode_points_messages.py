import datetime
import json

from tickwarden.operators import decode, messages, points

TICK = {
    "ticker": "TEST", "timestamp": 1640995200000, "datetime": "2022-01-01T00:00:00",
    "open": 150.0, "close": 151.0, "high": 152.0, "low": 149.5, "volume": 1000.0,
    "vwap": 150.5, "number_of_trades": 500,
}


def _records(spark, texts):
    return spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "value string, offset long")


def test_decode_reasons(spark):
    texts = [
        json.dumps(TICK),
        "bad", "", "   ", None, "5", "null", '[{"ticker": "X"}]',
        '{"a":1}{"b":2}', "{}", json.dumps({**TICK, "ticker": None}),
        json.dumps({**TICK, "close": "151.0"}), json.dumps({**TICK, "close": True}),
    ]
    good, bad = decode.decode(_records(spark, texts), keep=("offset",))
    assert [r.ticker for r in good.collect()] == ["TEST"]
    reasons = {r.offset: r.reason for r in bad.collect()}
    assert reasons == {
        1: "malformed", 2: "empty", 3: "empty", 4: "empty", 5: "malformed", 6: "malformed",
        7: "malformed", 8: "missing_ticker", 9: "missing_ticker", 10: "missing_ticker",
        11: "malformed", 12: "malformed",
    }


def test_decode_keeps_all_tick_fields(spark):
    good, _ = decode.decode(_records(spark, [json.dumps(TICK)]))
    assert good.first().asDict() == TICK


def test_point_reference_samples(spark):
    texts = [
        '{"ticker": "TEST", "close": "150.00", "datetime": "2025-01-01T00:00:00Z"}',
        '{"ticker": "TEST", "close": 151.234, "datetime": "2025-01-02T00:00:00"}',
        '{"ticker": "TEST", "close": "abc", "datetime": "2025-01-03T00:00:00"}',
        '{"ticker": "TEST", "close": 1.0, "datetime": "2025-01-04T01:00:00+01:00"}',
        '{"ticker": null, "close": 1.0, "datetime": "2025-01-05T00:00:00"}',
    ]
    pts = points.points_from_records(_records(spark, texts), "stocks").collect()
    got = [(p.measurement, p.time, p.ticker, p.price) for p in pts]
    assert got == [
        ("stocks", datetime.datetime(2025, 1, 1), "TEST", 150.0),
        ("stocks", datetime.datetime(2025, 1, 2), "TEST", 151.23),
        ("stocks", datetime.datetime(2025, 1, 4), "TEST", 1.0),
    ]


def test_point_upsert_last_write_wins(spark):
    texts = [
        '{"ticker": "A", "close": 1.0, "datetime": "2025-01-01T00:00:00"}',
        '{"ticker": "A", "close": 2.0, "datetime": "2025-01-01T00:00:00Z"}',
        '{"ticker": "B", "close": 3.0, "datetime": "2025-01-01T00:00:00"}',
    ]
    up = points.upsert_points(points.points_from_records(_records(spark, texts))).collect()
    assert sorted((r.ticker, r.price) for r in up) == [("A", 2.0), ("B", 3.0)]


def test_points_range_is_start_inclusive_stop_exclusive(spark, tmp_path):
    texts = [
        '{"ticker": "A", "close": 1.0, "datetime": "2025-01-01T00:00:00"}',
        '{"ticker": "A", "close": 2.0, "datetime": "2025-01-02T00:00:00"}',
        '{"ticker": "A", "close": 3.0, "datetime": "2025-01-03T00:00:00"}',
        '{"ticker": "A", "close": 4.0, "datetime": "2025-01-01T00:00:00"}',
    ]
    path = str(tmp_path / "points")
    points.write_point_log(points.points_from_records(_records(spark, texts)), path)
    out = points.read_points_range(spark, path, "2025-01-01 00:00:00", "2025-01-03 00:00:00")
    assert sorted(r.price for r in out.collect()) == [2.0, 4.0]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def _alerts(spark, rows):
    schema = ("ticker string, datetime string, timestamp long, target_price double, "
              "previous_price double, current_price double, price_change_percentage double, alert_type string")
    return spark.createDataFrame(rows, schema)


def test_message_texts_of_the_reference(spark):
    rows = [
        ("TEST", "2023-01-01T00:00:00", None, 100.0, None, 105.0, None, "target_price"),
        ("TEST", "2023-01-01T00:00:00", None, None, None, 105.0, 5.0, "percentage_change"),
        ("TEST", "2023-01-01T00:00:00", None, None, None, 95.0, -5.0, "percentage_change"),
        ("TEST", "2023-01-01T00:00:00", None, None, None, 95.0, 0.0, "percentage_change"),
        ("TEST", None, None, None, None, 1e7, 1e-5, "percentage_change"),
        ("TEST", "x", None, None, None, 1.0, 1.0, "other"),
        ("TEST", "x", None, None, None, 1.0, 1.0, None),
    ]
    df = _alerts(spark, rows)
    msgs = [r.message for r in messages.alert_messages(df).collect()]
    assert msgs == [
        "2023-01-01T00:00:00 TEST price has reached the target of $100.0. Current price: $105.0",
        "2023-01-01T00:00:00 TEST price has increased by 5.0%. Current price: $105.0",
        "2023-01-01T00:00:00 TEST price has decreased by -5.0%. Current price: $95.0",
        "2023-01-01T00:00:00 TEST price has decreased by 0.0%. Current price: $95.0",
        "None TEST price has increased by 1e-05%. Current price: $10000000.0",
    ]
    bad = {r.reason for r in messages.undeliverable(df).collect()}
    assert bad == {"unknown_alert_type", "missing_alert_type"}


def test_custom_alert_types_end_to_end(spark):
    rows = [("T", "d", None, 100.0, None, 105.0, None, "level"), ("T", "d", 1, None, 1.0, 105.0, 5.0, "jump"),
            ("T", "d", 1, None, 1.0, 105.0, 5.0, "percentage_change"), ("T", "d", 1, None, 1.0, 1.0, 5.0, None)]
    types = {"target_type": "level", "change_type": "jump"}
    topic = messages.alert_records(_alerts(spark, rows), **types)
    more = spark.createDataFrame([("T", "not json"), ("T", None)], "key string, value string")
    topic = topic.unionByName(more)
    msgs = messages.alert_messages(messages.alerts_from_records(topic, **types), **types).collect()
    assert sorted(m.alert_type for m in msgs) == ["jump", "level"] and all(m.message for m in msgs)
    bad = sorted(r.reason for r in messages.rejected_records(topic, **types).collect())
    assert bad == ["empty", "malformed", "missing_alert_type", "unknown_alert_type"]


def test_point_times(spark):
    cases = {
        "2025-01-01T12:00:00+05": datetime.datetime(2025, 1, 1, 7), "2025-01-01T12:00:00+0530": datetime.datetime(2025, 1, 1, 6, 30),
        "2025-01-01T12:00:00-05:30": datetime.datetime(2025, 1, 1, 17, 30), "2025-01-01T12:00:00 Europe/Berlin": None,
        "2025-01-01T12:00Z": datetime.datetime(2025, 1, 1, 12), "2025-01-01T12:00+05": datetime.datetime(2025, 1, 1, 7),
        "2025-01-01 12:00:00.25": datetime.datetime(2025, 1, 1, 12, 0, 0, 250000),
        "2025-01-01": datetime.datetime(2025, 1, 1), "soon": None, None: None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.at for r in df.select("t", points.parse_point_time(df.t).alias("at")).collect()}
    assert got == cases


def test_last_write_wins_across_partitions(spark):
    text = '{"ticker": "A", "close": %s, "datetime": "2025-01-01T00:00:00"}'
    rows = [(text % 1.0, 900, 0, 1), (text % 2.0, 5, 1, 2)]
    recs = spark.createDataFrame(rows, "value string, offset long, partition int, record_time int")
    assert [r.price for r in points.upsert_points(points.points_from_records(recs)).collect()] == [2.0]


def test_one_hot_ticker_day_is_written_by_several_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from tickwarden.streaming import jobs

    text = F.format_string('{"ticker":"A","close":1.0,"datetime":"2025-01-01T%02d:%02d:00"}',
                           F.col("id") % 24, (F.col("id") / 24).cast("int") % 60)
    recs = spark.range(20_000).select(text.alias("value"), F.col("id").alias("offset"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = jobs.point_stream(recs).select(F.spark_partition_id()).distinct().count()
        points.write_point_log(points.points_from_records(recs), str(tmp_path / "log"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    log = spark.read.parquet(str(tmp_path / "log"))
    assert tasks > 1 and log.select(F.input_file_name()).distinct().count() > 1
