"""Change alerts whose leading order column is null, text or a date."""

import pytest

from tickwarden.operators import detectors

ROWS = [("a", None, 1, 100.0), ("a", None, 2, 300.0), ("a", 5_000, 3, 100.0), ("a", 90_000, 4, 101.0), ("a", 200_000, 5, 500.0)]


def _alerts(df, order):
    out = detectors.price_change_alerts(df, 50.0, order_by=order)
    return sorted((r.previous_price, r.current_price) for r in out.collect())


def test_null_timestamps_come_first_and_alert(spark):
    df = spark.createDataFrame(ROWS, "ticker string, timestamp bigint, seq bigint, close double")
    df = df.selectExpr("*", "'x' AS datetime")
    assert _alerts(df, ("timestamp", "seq")) == [(100.0, 300.0), (101.0, 500.0), (300.0, 100.0)]


@pytest.mark.parametrize("expr", ["lpad(seq, 8, '0')", "date_add(DATE'2024-01-01', int(seq))", "timestamp_millis(seq)"])
def test_other_order_types(spark, expr):
    df = spark.createDataFrame(ROWS, "ticker string, timestamp bigint, seq bigint, close double")
    df = df.selectExpr("*", "'x' AS datetime", f"{expr} AS at")
    assert _alerts(df, ("at",)) == [(100.0, 300.0), (101.0, 500.0), (300.0, 100.0)]
