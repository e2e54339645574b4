"""Send times against a loop over the messages."""

import random

import pytest

from tickwarden.operators.schedule import send_schedule

DDL = "at long, channel string, n long, `a.b` string"


def loop(rows, spacing, by_channel):
    last, out = {}, []
    order = lambda r: (r[0], r[2]) if by_channel else (r[0], r[1] is not None, r[1] or "", r[2])
    for at, channel, n, x in sorted((r for r in rows if r[0] is not None), key=order):
        key = channel if by_channel else ""
        last[key] = at if key not in last else max(at, last[key] + spacing)
        out.append((at, channel, n, x, last[key]))
    return sorted([*out, *((*r, None) for r in rows if r[0] is None)], key=str)


@pytest.mark.parametrize("by_channel", [True, False])
@pytest.mark.parametrize("spread", [200, 5000])
def test_equals_a_sequential_loop(spark, by_channel, spread):
    rng = random.Random(spread)
    rows, at = [], 0
    for n in range(700):  # bursts and pauses; two thirds on one channel
        at += rng.choice([0, 0, rng.randrange(spread), rng.randrange(10 * spread) if n % 50 == 0 else 1])
        rows.append((at if n % 97 else None, rng.choice(["hot", "hot", "b", None]), n, "x"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")  # the hot channel lies in several tasks
    try:
        df = spark.createDataFrame(rows, DDL).repartition(5)
        got = send_schedule(df, channel="channel" if by_channel else None)
        assert got.columns == ["at", "channel", "n", "a.b", "send_ms"]
        assert sorted(map(tuple, got.collect()), key=str) == loop(rows, 1200, by_channel)
    finally:
        spark.conf.set(key, old)


def test_empty_and_wrong_spacing(spark):
    df = spark.createDataFrame([], DDL)
    assert send_schedule(df).count() == 0
    with pytest.raises(ValueError):
        send_schedule(df, spacing_ms=-1)
