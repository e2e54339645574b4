"""Bars emitted once at the watermark, late rows as an output."""

import random

from tickwarden.operators import bars as bars_op
from tickwarden.session import scratch_path
from tickwarden.streaming import closing, jobs

DDL = "ticker string, timestamp long, close double, volume double, offset long"


def drain(spark, batches, multiplier=1, timespan="minute", delay="15 seconds"):
    """Each batch is landed and drained; returns the tagged rows."""
    base = scratch_path(spark, "test-closing")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(DDL).parquet(f"{base}/in")
        jobs.start_parquet_sink(
            closing.closing_bars(stream, multiplier, timespan, delay), f"{base}/out", f"{base}/ck", available_now=True
        ).awaitTermination()
    return spark.read.parquet(f"{base}/out")


def test_bars_close_once_and_equal_batch_bars(spark):
    rng = random.Random(1)
    rows = [(rng.choice("AB"), 1000 * i + rng.randrange(1000), round(rng.uniform(1, 90), 2), float(rng.randrange(5)), i)
            for i in range(600)]
    tagged = drain(spark, [rows[:200], rows[200:410], rows[410:]])
    got = closing.closed_bars(tagged)
    assert got.groupBy("ticker", "timestamp").count().where("count > 1").isEmpty()
    done = 1000 * 599 - 15_000  # about where the watermark stands
    df = spark.createDataFrame(rows, DDL)
    want = bars_op.bars(df, 1, "minute", order_by=("timestamp", "offset")).where(f"timestamp + 60000 <= {done}")
    assert sorted(map(str, got.where(f"timestamp + 60000 <= {done}").collect())) == sorted(map(str, want.collect()))
    assert want.count() >= 16 and closing.late_rows(tagged).isEmpty()


def test_rows_after_the_close_come_out_as_late(spark):
    early = [("A", 1000 * i, 1.0 + i, 1.0, i) for i in range(200)]
    late = [("A", 30_500, 7.0, 2.0, 300), ("A", 190_000, 8.0, 1.0, 301)]  # the second is behind, its bar is open
    last = [("A", 400_000, 9.0, 1.0, 400)]
    tagged = drain(spark, [early, late, last, [("B", 500_000, 1.0, 1.0, 500)]])
    assert [tuple(r) for r in closing.late_rows(tagged).collect()] == [("A", 30_500, 7.0, 2.0, 300)]
    bars = {r.timestamp: r for r in closing.closed_bars(tagged).where("ticker = 'A'").collect()}
    assert bars[0].number_of_trades == 60 and bars[180_000].number_of_trades == 21
    assert bars[180_000].close == 200.0 and bars[180_000].high == 200.0


def test_a_shard_of_tickers_is_one_call_and_one_state_value(spark):
    """Python calls and state values follow shards, not tickers."""
    n = 3 * closing.SHARDS
    early = [(f"T{i}", 1000 * (i % 50), 1.0 + i, 2.0, i) for i in range(n)]
    more = [(f"T{i}", 55_000, 0.5, 1.0, n + i) for i in range(0, n, 2)]
    base = scratch_path(spark, "test-shards")
    for rows in (early, more):
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(DDL).parquet(f"{base}/in")
        jobs.start_parquet_sink(closing.closing_bars(stream, 1, "minute"), f"{base}/out", f"{base}/ck",
                                available_now=True).awaitTermination()
    held = spark.read.format("statestore").option("stateVarName", "open").load(f"{base}/ck")
    assert 0 < held.count() <= closing.SHARDS
    spark.createDataFrame([("Z", 200_000, 1.0, 1.0, 2 * n)], DDL).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(DDL).parquet(f"{base}/in")
    jobs.start_parquet_sink(closing.closing_bars(stream, 1, "minute"), f"{base}/out", f"{base}/ck",
                            available_now=True).awaitTermination()
    got = closing.closed_bars(spark.read.parquet(f"{base}/out"))
    want = bars_op.bars(spark.createDataFrame(early + more, DDL), 1, "minute", order_by=("timestamp", "offset"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
