"""Ingest, bars and tail applications; merged bar folders; dead letters."""

import json

import pytest

from tickwarden.__main__ import run
from tickwarden.operators import bars as bars_op
from tickwarden.session import scratch_path
from tickwarden.sources import files, kafka
from tickwarden.sources.landing import land
from tickwarden.streaming import apps, jobs


def _bar(day, **changes):
    bar = {"v": 1000, "vw": 150.5, "o": 150.0, "c": 151.0, "h": 152.0, "l": 149.5,
           "t": 1640995200000 + day * 86_400_000, "n": 500}
    bar.update(changes)
    return {k: v for k, v in bar.items() if v != "absent"}


def _records(spark, texts, first=0):
    rows = [(t, first + i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "value string, offset long").coalesce(1)


def _tick(ticker, ts, close):
    return json.dumps({"ticker": ticker, "timestamp": ts, "datetime": f"d{ts}", "open": close,
                       "close": close, "high": close, "low": close, "volume": 1.0, "vwap": close,
                       "number_of_trades": 1})


def test_ingest_command_reads_whole_files_and_keeps_what_it_refuses(spark, tmp_path):
    pages = [
        json.dumps({"ticker": "A", "results": [_bar(0), _bar(1), _bar(1, c="absent"), _bar(40)]}, indent=2),
        json.dumps({"ticker": "B", "results": [_bar(1, n=5.0)], "next_url": None}, indent=2),
        '{"ticker": "C", "results": [{"v": 1',
        json.dumps({"ticker": "D", "results": []}),
    ]
    source = tmp_path / "pages"
    source.mkdir()
    for i, text in enumerate(pages):
        (source / f"page{i}.json").write_text(text)
    base = scratch_path(spark, "test-ingest")
    run(["ingest", "--source", str(source), "--whole-files", "--start-date", "2022-01-01",
         "--end-date", "2022-01-31", "--checkpoint", f"{base}/ck", "--out", f"{base}/out",
         "--quarantine", f"{base}/bad", "--once"], spark=spark)
    got = [(r.key, json.loads(r.value)) for r in spark.read.parquet(f"{base}/out").collect()]
    assert sorted((k, v["datetime"], v["number_of_trades"]) for k, v in got) == [
        ("A", "2022-01-01T00:00:00", 500), ("A", "2022-01-02T00:00:00", 500), ("B", "2022-01-02T00:00:00", 5)]
    bad = spark.read.parquet(f"{base}/bad").collect()
    assert sorted(r.reason for r in bad) == ["incomplete_bar", "malformed"]
    assert pages[2] in [r.value for r in bad]


def test_ingest_checks_its_parameters(spark, tmp_path):
    stream = files.stream_text(spark, str(tmp_path))
    for wrong in ({"multiplier": 0}, {"timespan": "invalid"}, {"end_date": "invalid"}):
        with pytest.raises(ValueError):
            apps.ingest_app(stream, str(tmp_path / "ck"), out=str(tmp_path / "out"), **wrong)


def test_tail_command_keeps_records_as_they_are(spark):
    base = scratch_path(spark, "test-tail")
    texts = ["{}", "no json", ""]
    _records(spark, texts).write.parquet(f"{base}/in")
    run(["tail", "--source", f"{base}/in", "--checkpoint", f"{base}/ck", "--out", f"{base}/out", "--once"],
        spark=spark)
    assert sorted(r.value for r in spark.read.parquet(f"{base}/out").collect()) == sorted(texts)


def test_merged_bar_folders_give_the_same_bars(spark):
    base = scratch_path(spark, "test-compact")
    source, out = f"{base}/in", f"{base}/out"
    texts = [_tick(t, 60_000 * m, 10.0 * m + i) for m in range(6) for i, t in enumerate("AB")]

    def drain(checkpoint, records, at):
        records.write.mode("append").parquet(source)
        run(["bars", "--source", source, "--checkpoint", checkpoint, "--out", out, "--multiplier", "2",
             "--once"], spark=spark)
        bars = jobs.latest_bars(spark, out).select(*bars_op.BAR_FIELDS)
        assert bars.groupBy("ticker", "timestamp").count().where("count > 1").isEmpty(), at
        return sorted(map(tuple, bars.collect()), key=str)

    def folders():
        return {(r.run, r.batch_id) for r in spark.read.parquet(out).select("run", "batch_id").distinct().collect()}

    for i in range(0, 12, 3):  # a bar's rows come in several micro-batches
        before = drain(f"{base}/ck", _records(spark, texts[i : i + 3], i), i)
    old = folders()
    assert jobs.compact_bars(spark, out) == len(old) - 1
    assert len(folders()) == 2 and max(old, key=lambda f: f[1]) in folders()
    assert sorted(map(tuple, jobs.latest_bars(spark, out).select(*bars_op.BAR_FIELDS).collect()), key=str) == before
    assert jobs.compact_bars(spark, out) == 0  # one merged folder, one that may be replayed
    # a restart on a new checkpoint counts from 0: its folders touch no others
    extra = _records(spark, [_tick("A", 299_000, 99.0)], 12)
    after = drain(f"{base}/ck2", extra, "ck2")
    close = next(r for r in after if r[0] == "A" and r[1] == 240_000)
    assert len(after) == len(before) and 99.0 in close
    jobs.compact_bars(spark, out)
    assert sorted(map(tuple, jobs.latest_bars(spark, out).select(*bars_op.BAR_FIELDS).collect()), key=str) == after


def _bar_folders(spark, batches, checkpoint="ck"):
    """A bar sink's folders of so many micro-batches, and the bars."""
    base = scratch_path(spark, "test-merge")
    for i in range(batches):
        _records(spark, [_tick(t, 60_000 * (i // 2), 1.0 + i) for t in "AB"], 2 * i).write.mode("append").parquet(f"{base}/in")
        run(["bars", "--source", f"{base}/in", "--checkpoint", f"{base}/{checkpoint}", "--out", f"{base}/out",
             "--multiplier", "1", "--once"], spark=spark)
    return f"{base}/out"


def _bars(spark, out):
    return sorted(map(str, jobs.latest_bars(spark, out).select(*bars_op.BAR_FIELDS).collect()))


def test_a_merge_that_broke_off_is_made_good(spark):
    out = _bar_folders(spark, 3)
    before = _bars(spark, out)
    # it broke off while writing: the folder is there, nothing committed
    jobs.Ledger(spark, f"{out}/run={jobs.COMPACTED}/batch_id=0/_temporary/0").add("part")
    assert jobs.compact_bars(spark, out) == 2 and _bars(spark, out) == before
    # it broke off before the old folders went: everything is there twice
    out = _bar_folders(spark, 4)
    before = _bars(spark, out)
    drop = jobs.Ledger.drop
    try:
        jobs.Ledger.drop = lambda self, names: (_ for _ in ()).throw(OSError("lost"))
        with pytest.raises(OSError):
            jobs.compact_bars(spark, out)
    finally:
        jobs.Ledger.drop = drop
    assert _bars(spark, out) == before
    jobs.compact_bars(spark, out)
    assert _bars(spark, out) == before


def test_replaced_folders_outlive_the_merge_for_readers_that_listed_them(spark):
    out = _bar_folders(spark, 4)
    reader = jobs.latest_bars(spark, out).select(*bars_op.BAR_FIELDS)  # its files are listed now
    before = sorted(map(str, reader.collect()))
    assert jobs.compact_bars(spark, out, grace=True) == 3
    assert sorted(map(str, reader.collect())) == before == _bars(spark, out)
    assert jobs.compact_bars(spark, out, grace=True) == 0  # nothing new to merge


def test_an_older_clock_does_not_pick_the_older_version(spark):
    out = _bar_folders(spark, 2)
    rows = spark.read.parquet(out)
    newest = rows.agg({"batch_id": "max"}).first()[0]
    back = f"{out}/run={rows.first()['run']}/batch_id={newest}"
    kept = spark.read.parquet(back).collect()
    schema = spark.read.parquet(back).schema
    old = spark.createDataFrame([r.asDict() | {"emitted_at": r.emitted_at.replace(year=2001)} for r in kept], schema)
    old.write.mode("overwrite").parquet(back)
    assert all(r.number_of_trades == 2 for r in jobs.latest_bars(spark, out).collect())


def test_alerts_and_rejected_records_come_from_one_scan(spark):
    base = scratch_path(spark, "test-one-scan")
    texts = [_tick("A", 1000, 10.0), "no json", _tick("A", 2000, 20.0), '{"close": 1}', "", _tick("B", 1000, 300.0),
             _tick("A", 3000, 0.0), _tick("A", 4000, 5.0)]
    _records(spark, texts).write.parquet(f"{base}/in")
    query = apps.alert_app(
        files.stream_topic(spark, f"{base}/in"), 250.0, 50.0, f"{base}/ck", out=f"{base}/out",
        quarantine=f"{base}/bad", trigger="availableNow")
    query.awaitTermination()
    assert not spark.streams.active and len(query.lastProgress["sources"]) == 1
    assert sum(p["numInputRows"] for p in query.recentProgress) == len(texts)
    alerts = [json.loads(r.value) for r in spark.read.parquet(f"{base}/out").collect()]
    assert sorted((a["ticker"], a["alert_type"], a["current_price"]) for a in alerts) == [
        ("A", "percentage_change", 0.0), ("A", "percentage_change", 20.0), ("B", "target_price", 300.0)]
    bad = spark.read.parquet(f"{base}/bad").collect()
    assert sorted((r.offset, r.value, r.reason) for r in bad) == [
        (1, "no json", "malformed"), (3, '{"close": 1}', "missing_ticker"), (4, "", "empty")]
    # as the plain alert query
    apps.alert_app(files.stream_topic(spark, f"{base}/in"), 250.0, 50.0, f"{base}/ck2", out=f"{base}/plain",
                   trigger="availableNow").awaitTermination()
    plain = spark.read.parquet(f"{base}/plain")
    assert sorted(r.value for r in plain.collect()) == sorted(json.dumps(a, separators=(",", ":")) for a in alerts)


def test_a_repeated_batch_leaves_finished_topics_alone(spark, monkeypatch):
    base = scratch_path(spark, "test-ledger")
    _records(spark, [_tick("A", 1000, 300.0), "no json"]).write.parquet(f"{base}/in")
    sent = []

    def send(rows, bootstrap, topic):
        if topic == "dlq" and len(sent) < 2:
            sent.append(("failed", 0))
            raise OSError("broker is down")
        sent.append((topic, rows.count()))

    monkeypatch.setattr(kafka, "write_topic", send)

    def drain():
        apps.alert_app(
            files.stream_topic(spark, f"{base}/in"), 250.0, None, f"{base}/ck", kafka=("b:9092", "alerts"),
            quarantine=("b:9092", "dlq"), trigger="availableNow").awaitTermination()

    with pytest.raises(Exception, match="broker is down"):
        drain()
    drain()
    assert sent == [("alerts", 1), ("failed", 0), ("dlq", 1)]


def test_flat_files_of_a_repeated_batch_are_replaced(spark):
    out = scratch_path(spark, "test-flat")
    jobs.write_flat(spark.range(10).repartition(3), out, "r1-0")
    jobs.write_flat(spark.range(10, 12), out, "r1-1")
    jobs.write_flat(spark.range(10).repartition(2), out, "r1-0")  # again
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(12))
    jobs.write_flat(spark.range(0), out, "r1-2")
    assert spark.read.parquet(out).columns == ["id"]


def test_routed_topics_and_a_dead_letter_topic_together(spark, monkeypatch):
    base = scratch_path(spark, "test-route-topics")
    _records(spark, ['{"current": {"time": "x", "t2m": 1.5, "rain": 0}}', '{"hourly": {}}']).write.parquet(f"{base}/in")
    sent = {}
    monkeypatch.setattr(kafka, "write_topic", lambda rows, servers, topic: sent.update({topic: rows.collect()}))
    apps.route_app(files.stream_topic(spark, f"{base}/in"), f"{base}/ck", bootstrap="b:9092",
                   quarantine=("b:9092", "dlq"), trigger="availableNow").awaitTermination()
    assert sorted((r.topic, r.value) for r in sent[None]) == [("rain", "0"), ("t2m", "1.5")]
    assert [r.value for r in sent["dlq"]] == ['{"hourly": {}}']


def test_a_live_feed_of_points_spreads_over_writers(spark):
    texts = [json.dumps({"ticker": f"T{i % 500}", "datetime": "2024-01-01T10:00:30", "close": 1.0}) for i in range(3000)]
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # it would merge so few rows
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        rows = jobs.point_stream(_records(spark, texts))
        parts = rows.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    finally:
        spark.conf.set(key, old)
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 1500


def test_dead_letter_topic_records(spark):
    rejected = spark.createDataFrame([("bad", "malformed"), (None, "empty")], "value string, reason string")
    out = kafka.dead_letter_records(rejected)
    assert sorted(map(tuple, out.collect()), key=str) == [("empty", None), ("malformed", "bad")]
    assert kafka.batch_sink_options("b:9092", "dlq") == {
        "kafka.bootstrap.servers": "b:9092", "kafka.acks": "all", "topic": "dlq"}
    rows, target, _ = jobs.dead_letters(lambda df: df, ("b:9092", "dlq"))
    assert rows(rejected).columns == ["key", "value"] and target == ("b:9092", "dlq")
    rows, target, _ = jobs.dead_letters(lambda df: df, "/folder")
    assert rows(rejected).columns == ["value", "reason"] and target == "/folder"


def test_command_line_refuses_a_dead_letter_topic_without_servers(spark):
    base = scratch_path(spark, "test-dlq")
    land(_records(spark, ["{}"]), f"{base}/in")
    with pytest.raises(SystemExit):
        run(["messages", "--source", f"{base}/in", "--checkpoint", f"{base}/ck", "--out", f"{base}/out",
             "--dead-letter-topic", "dlq", "--once"], spark=spark)
