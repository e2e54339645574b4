"""Benchmark the query catalogue.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

``BENCH_EVENT_LOG_DIR`` (a scratch folder) writes Spark's event log for
stage and task times.

Every batch key is executed in full through the ``noop`` sink (nothing
is collected to the driver); the best of ``BENCH_REPEAT`` runs counts.
The streaming alert key is timed once, end to end
(``BENCH_STREAM_KEYS=all``: every streaming key); the alert application's
processing rate over a landed tick topic is reported as rows per
second.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickwarden.plans import params as P  # noqa: E402
from tickwarden.plans.catalog import QUERIES  # noqa: E402
from tickwarden.session import build_session, scratch_path  # noqa: E402
from tickwarden.sources import files, landing  # noqa: E402
from tickwarden.streaming import apps  # noqa: E402

STREAM_KEYS = {k for k in QUERIES if k.startswith("stream_")} | {
    "scan_ticks",
    "raw_tail",
    "snapshot_scan",
}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    conf = {"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")}
    event_log = os.environ.get("BENCH_EVENT_LOG_DIR")  # stage/task times, no UI needed
    if event_log:
        os.makedirs(event_log, exist_ok=True)
        conf.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_log})
    spark = build_session(
        f"local[{cpus}]",
        app_name="tickwarden-bench",
        shuffle_partitions=int(cpus) * 2,
        conf=conf,
    )
    # warm up the JVM and the parquet reader
    run(spark.read.parquet(f"{sf_dir}/events.parquet"))

    timings: dict[str, float] = {}
    for key in sorted(QUERIES):
        if key in STREAM_KEYS:
            continue
        best = float("inf")
        for _ in range(repeat):
            t0 = time.perf_counter()
            run(QUERIES[key](spark, sf_dir))
            best = min(best, time.perf_counter() - t0)
        timings[key] = round(best, 3)
    batch_total = round(sum(timings.values()), 3)

    # end to end: landing, replay, read-back
    every = os.environ.get("BENCH_STREAM_KEYS") == "all"
    for key in sorted(STREAM_KEYS) if every else ["stream_alerts"]:
        t0 = time.perf_counter()
        run(QUERIES[key](spark, sf_dir))
        timings[key] = round(time.perf_counter() - t0, 3)

    # The streaming alert application's own rate: the tick topic is landed
    # once (not timed), then drained by availableNow runs on fresh
    # checkpoints; the best run counts (warm Python workers, as in a
    # long-running stream).
    # landed as one file per core of contiguous offsets, like a topic
    # with that many partitions
    feed_path = scratch_path(spark, "bench-ticks")
    landing.tick_feed(spark, sf_dir).repartitionByRange(int(cpus), "offset").write.parquet(feed_path)
    rows = spark.read.parquet(feed_path).count()
    best = float("inf")
    for i in range(2):
        t0 = time.perf_counter()
        apps.alert_app(
            files.stream_topic(spark, feed_path), P.TARGET_PRICE, P.PRICE_CHANGE_THRESHOLD,
            f"{feed_path}-ck{i}", out=f"{feed_path}-out{i}", trigger="availableNow",
        ).awaitTermination()
        best = min(best, time.perf_counter() - t0)
    stream_rates = {
        "alert_app_seconds": round(best, 3),
        "alert_app_rows_per_sec": round(rows / best, 1),
    }
    spark.stop()

    m = re.search(r"sf([0-9.]+)$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "batch_catalogue_seconds",
                "value": batch_total,
                "unit": "sec",
                "queries": timings,
                "sf": float(m.group(1)) if m else sf_dir,
                **stream_rates,
            }
        )
    )


if __name__ == "__main__":
    main()
