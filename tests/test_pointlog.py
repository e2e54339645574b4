"""The point table of sorted runs: ranges, snapshots, merges, crashes."""

import datetime
import random

import pytest

from tickwarden.operators.pointlog import PointLog
from tickwarden.session import scratch_path

DDL = "measurement string, ticker string, time timestamp_ntz, price double, offset bigint"


def day(d, h=0):
    return datetime.datetime(2024, 1, d, h)


def random_points(rng, n=200):
    return [("m" if rng.random() < 0.8 else "other", f"T{rng.randrange(6)}", day(rng.randrange(1, 9), rng.randrange(4)),
             float(rng.randrange(1000)), i) for i in range(n)]


def plain(batches, lo=None, hi=None, measurement=None):
    table = {}
    for batch in batches:
        for m, t, at, price, _ in sorted(batch, key=lambda r: r[4]):
            table[m, t, at] = price
    return sorted((m, t, str(at), p) for (m, t, at), p in table.items()
                  if (lo is None or lo <= at < hi) and measurement in (None, m))


def rows(df):
    return sorted((r.measurement, r.ticker, str(r.time), r.price) for r in df.collect())


@pytest.fixture(scope="module")
def filled(spark):
    rng = random.Random(1)
    batches = [random_points(rng) for _ in range(5)]
    log = PointLog(spark, scratch_path(spark, "test-log"))
    for b in batches:
        log.append(spark.createDataFrame(b, DDL))
    return log, batches


def test_later_runs_win_and_merges_change_nothing(spark, filled):
    log, batches = filled
    assert rows(log.read()) == plain(batches)
    version = log.manifest()["version"]
    assert log.merge() == 5 and len(log.manifest()["runs"]) == 1
    assert rows(log.read()) == plain(batches)
    later = [("m", "T0", day(3), -1.0, 0), ("m", "T0", day(30), -2.0, 1)]
    log.append(spark.createDataFrame(later, DDL))
    assert rows(log.read()) == plain([*batches, later])
    assert rows(log.read(version)) == plain(batches)  # an older snapshot
    assert log.merge() == 0


def test_a_range_opens_only_its_files(spark, filled):
    log, batches = filled
    got = log.read_range("2024-01-03 00:00:00", "2024-01-05 00:00:00", "other")
    assert rows(got) == plain(batches, day(3), day(5), "other")
    opened = got.inputFiles()
    assert opened and all("date=2024-01-03" in f or "date=2024-01-04" in f for f in opened)
    one = log.read_range("2024-01-01 00:00:00", "2024-01-09 00:00:00", "m", tickers=("T2", "T2"))
    assert {r.ticker for r in one.collect()} == {"T2"}
    assert log.read_range("2025-01-01 00:00:00", "2025-01-02 00:00:00", "m").count() == 0


@pytest.mark.parametrize("step", ["data", "files", "manifest", "rename"])
def test_a_write_or_merge_that_breaks_off_leaves_the_table(spark, step, monkeypatch):
    rng = random.Random(2)
    batches = [random_points(rng, 40) for _ in range(4)]
    log = PointLog(spark, scratch_path(spark, "test-crash"))
    for b in batches:
        log.append(spark.createDataFrame(b, DDL))
    before = rows(log.read())

    class Lost(Exception):
        pass

    def lose(*_):
        raise Lost

    if step in ("data", "files"):
        real = spark.createDataFrame([(1,)], "a int").write.__class__.parquet

        def parquet(self, path, *args, **kwargs):
            if path.endswith(f"/{step}"):
                raise Lost
            return real(self, path, *args, **kwargs)

        monkeypatch.setattr(spark.createDataFrame([(1,)], "a int").write.__class__, "parquet", parquet)
    elif step == "manifest":
        monkeypatch.setattr(PointLog, "_commit", lose)
    else:
        monkeypatch.setattr(PointLog, "_publish", lose)
    with pytest.raises(Lost):
        log.append(spark.createDataFrame([("m", "T0", day(1), 1.0, 0)], DDL))
    with pytest.raises(Lost):
        log.merge()
    monkeypatch.undo()
    assert rows(log.read()) == before and len(log.manifest()["runs"]) == 4
    assert log.merge() == 4 and rows(log.read()) == before
    assert len(log.vacuum()) >= 4 and rows(log.read()) == before


def test_two_writers_both_commit(spark):
    path = scratch_path(spark, "test-writers")
    a, b = PointLog(spark, path), PointLog(spark, path)
    a.append(spark.createDataFrame([("m", "A", day(1), 1.0, 0)], DDL))
    real, raced = PointLog.manifest, []

    def stale(self, version=None):
        found = real(self, version)
        if self is b and not raced:
            raced.append(1)  # another writer commits between b's read and its rename
            a.append(spark.createDataFrame([("m", "B", day(1), 2.0, 0)], DDL))
        return found

    PointLog.manifest = stale
    try:
        b.append(spark.createDataFrame([("m", "C", day(1), 3.0, 0)], DDL))
    finally:
        PointLog.manifest = real
    assert [r[1] for r in rows(a.read())] == ["A", "B", "C"] and a.manifest()["version"] == 3


def test_empty_table_and_nulls(spark):
    log = PointLog(spark, scratch_path(spark, "test-empty"))
    assert log.read().count() == 0 and log.merge() == 0 and log.vacuum() == []
    assert log.append(spark.createDataFrame([], DDL))["runs"] == []
    log.append(spark.createDataFrame([("m", None, day(1), 1.0, 0), ("m", "A", None, 1.0, 0), ("m", "A", day(1), 1.0, None)], DDL))
    assert rows(log.read()) == [("m", "A", str(day(1)), 1.0)]


def test_the_default_range_is_the_last_two_years(spark):
    from tickwarden.operators import points

    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    ages = {"hour": datetime.timedelta(hours=1), "year": datetime.timedelta(days=700), "old": datetime.timedelta(days=760),
            "ahead": -datetime.timedelta(hours=3)}
    df = spark.createDataFrame([("stock_price", t, now - age, 1.0, 0) for t, age in ages.items()], DDL)
    path = scratch_path(spark, "test-default")
    points.write_point_log(df, f"{path}/log")
    log = PointLog(spark, f"{path}/table")
    log.append(df)
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            for got in (points.read_points_range(spark, f"{path}/log"), log.read_range()):
                assert sorted(r.ticker for r in got.collect()) == ["hour", "year"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
