"""Physical-plan properties the scale design relies on."""

import re

import pytest
from conftest import SF_SMALL

import __spark_entry__ as E
from tickwarden.operators import messages


def plan(spark, key, **conf):
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = E.queries()[key](spark, SF_SMALL)
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_target_filter_reaches_the_scan(spark):
    p = plan(spark, "target_price_alerts")
    assert "GreaterThanOrEqual(value,250.0)" in p
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>", p)


def test_change_detector_shuffles_the_input_once_by_ticker_and_chunk(spark):
    from tickwarden.operators import detectors
    from tickwarden.sources.tables import event_ticks

    ticks = event_ticks(spark, SF_SMALL)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = detectors.detector_rows(ticks, "ticker", ["timestamp", "seq"])
        rows = detectors.even_chunks(rows, ["timestamp", "seq"], 5)
        stage = detectors.window_stage(rows, ["_k", "_chunk"], ["timestamp", "seq"])
        stage = stage._jdf.queryExecution().executedPlan().toString()
        carry = detectors.chunk_carry(rows, ["timestamp", "seq"])
        carry = carry._jdf.queryExecution().executedPlan().toString()
        whole = detectors.price_change_alerts(ticks, 500.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    # the pass over all rows: one exchange on (ticker, chunk), one window
    assert len(re.findall(r"Exchange hashpartitioning\(_k#\d+, _chunk#\d+L?, \d+\)", stage)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(_k#\d+, \d+\)", stage)) == 0
    assert stage.count("Window [") == 1
    # the summary is combined before its shuffle
    assert carry.index("partial_max(struct") > 0
    # borders (one row per hot ticker) reach the rows without a shuffle
    assert stage.count("BroadcastHashJoin") == 1 and stage.count("Exchange hashpartitioning") == 1
    # no ticker is larger than a task: one exchange, one window, no join
    assert whole.count("Exchange ") == 1 and whole.count("Window [") == 1 and "Join" not in whole


def test_bars_use_hash_aggregation(spark):
    for key in ("bars_day", "bars_month", "bars_rollup"):
        p = plan(spark, key, **{"spark.sql.adaptive.enabled": "false"})
        assert "HashAggregate" in p and "SortAggregate" not in p, key


def test_points_range_prunes_partitions(spark):
    p = plan(spark, "points_range")
    assert "PartitionFilters: [isnotnull(measurement" in p and "(measurement#" in p
    assert "date#" in p


def test_date_range_is_pushed_down(spark):
    p = plan(spark, "date_range")
    assert "GreaterThanOrEqual(o_orderdate" in p and "LessThan(o_orderdate" in p


@pytest.mark.parametrize("key", ["decode_ticks", "quarantine"])
def test_each_record_is_parsed_once(spark, key):
    df = E.queries()[key](spark, SF_SMALL)
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("from_json") == 1


def test_messages_run_without_python(spark):
    alerts = E.queries()["alert_messages"](spark, SF_SMALL)
    read = messages.alert_messages(
        messages.alerts_from_records(E.queries()["alert_records"](spark, SF_SMALL))
    )  # what the message application computes
    for df in (alerts, read):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEval" not in text and "BatchEval" not in text


def test_no_join_hint_broadcasts(spark):
    for key in E.queries():
        if key.startswith("stream_") or key in ("scan_ticks", "raw_tail", "snapshot_scan", "points_range", "pages_explode"):
            continue
        logical = E.queries()[key](spark, SF_SMALL)._jdf.queryExecution().analyzed().toString()
        assert "broadcast" not in logical.lower(), key
