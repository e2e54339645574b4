"""Command line: run one of the streaming applications.

    python -m tickwarden alerts   --source DIR | --bootstrap B --topic T
                                  --target 250 --threshold 5
                                  --checkpoint DIR (--out DIR | --sink-topic T)
    python -m tickwarden points   ... --out DIR [--measurement stock_price]
    python -m tickwarden messages ... (--out DIR | --sink-topic T)
    python -m tickwarden route    ... (--out DIR | --sink-bootstrap B)
                                  [--timespan current] [--whole-files]
    python -m tickwarden ingest   ... (--out DIR | --sink-topic T) [--whole-files]
                                  [--multiplier 1] [--timespan day]
                                  [--start-date D] [--end-date D]
    python -m tickwarden bars     ... --out DIR [--multiplier 5] [--timespan minute]
    python -m tickwarden tail     ... [--out DIR]

``--quarantine DIR`` or ``--dead-letter-topic T`` (alerts, messages, route,
ingest) keeps the records that cannot be used.  ``--trigger`` takes ``"60 seconds"``-style intervals or ``availableNow``;
``--once`` is ``availableNow`` and waits for the end.  A file source is
a folder of topic-record parquet files ``(value, offset)``; ``ingest``
reads landed JSON pages, and ``--whole-files`` one document per file.
"""

from __future__ import annotations

import argparse
import sys

from tickwarden.schemas import (
    DEFAULT_MEASUREMENT,
    DEFAULT_TIMESPAN_KEY,
    PERCENTAGE_CHANGE_ALERT,
    TARGET_PRICE_ALERT,
)
from tickwarden.session import build_session
from tickwarden.sources import files, kafka
from tickwarden.streaming import apps


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m tickwarden")
    p.add_argument("app", choices=["alerts", "points", "messages", "route", "ingest", "bars", "tail"])
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--source", help="folder of topic-record parquet files")
    src.add_argument("--bootstrap", help="Kafka bootstrap servers of the source")
    p.add_argument("--topic", help="Kafka topic to read")
    p.add_argument("--max-per-trigger", type=int, default=None)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--out", help="parquet output folder")
    p.add_argument("--sink-topic", help="Kafka topic to write (alerts, messages)")
    p.add_argument("--sink-bootstrap", help="Kafka servers to write to (default: --bootstrap)")
    p.add_argument("--target", type=float, default=None)
    p.add_argument("--threshold", type=float, default=None)
    p.add_argument("--zero-policy", choices=["latch", "skip"], default="latch")
    p.add_argument("--target-type", default=TARGET_PRICE_ALERT, help="alert type of target alerts")
    p.add_argument("--change-type", default=PERCENTAGE_CHANGE_ALERT, help="alert type of change alerts")
    p.add_argument("--measurement", default=DEFAULT_MEASUREMENT)
    p.add_argument("--timespan", help="route: the snapshots' object (default: current); "
                   "ingest, bars: the bars' unit (default: day, minute)")
    p.add_argument("--multiplier", type=int, help="ingest, bars: units a bar (default: 1, 5)")
    p.add_argument("--start-date", help="ingest: first UTC date, YYYY-MM-DD")
    p.add_argument("--end-date", help="ingest: last UTC date")
    p.add_argument("--whole-files", action="store_true", help="route, ingest: one document per file")
    p.add_argument("--quarantine", help="folder for undecodable ticks (alerts), undeliverable "
                   "alerts (messages), snapshots without the timespan object (route), and "
                   "pages and bars that cannot be used (ingest)")
    p.add_argument("--dead-letter-topic", help="Kafka topic instead of the folder")
    p.add_argument("--trigger", default=None)
    p.add_argument("--once", action="store_true", help="drain what is there and stop")
    p.add_argument("--master", default=None)
    return p


def run(argv: list[str] | None = None, spark=None):
    args = parser().parse_args(argv)
    spark = spark or build_session(args.master, app_name=f"tickwarden-{args.app}")
    if args.source and (args.app == "ingest" or args.whole_files):
        records = files.stream_text(
            spark, args.source, args.whole_files,
            args.max_per_trigger or files.DEFAULT_MAX_FILES_PER_TRIGGER,
        )
    elif args.source:
        records = files.stream_topic(
            spark, args.source, args.max_per_trigger or files.DEFAULT_MAX_FILES_PER_TRIGGER
        )
    else:
        if not args.topic:
            raise SystemExit("--topic is needed with --bootstrap")
        records = kafka.read_topic_stream(
            spark, args.bootstrap, args.topic,
            max_offsets_per_trigger=args.max_per_trigger or kafka.DEFAULT_MAX_OFFSETS_PER_TRIGGER,
        )
    trigger = "availableNow" if args.once else args.trigger
    sink_servers = args.sink_bootstrap or args.bootstrap
    sink = (sink_servers, args.sink_topic) if args.sink_topic else None
    quarantine = args.quarantine
    if args.dead_letter_topic:
        if quarantine or not sink_servers:
            raise SystemExit("--dead-letter-topic needs Kafka servers and no --quarantine")
        quarantine = (sink_servers, args.dead_letter_topic)
    if args.app == "alerts":
        if args.target is None and args.threshold is None:
            raise SystemExit("alerts needs --target or --threshold")
        query = apps.alert_app(
            records, args.target, args.threshold, args.checkpoint, out=args.out, kafka=sink,
            trigger=trigger, zero_policy=args.zero_policy, quarantine=quarantine,
            target_type=args.target_type, change_type=args.change_type,
        )
    elif args.app == "points":
        query = apps.point_app(records, args.checkpoint, args.out, args.measurement, trigger)
    elif args.app == "messages":
        query = apps.message_app(
            records, args.checkpoint, out=args.out, kafka=sink, trigger=trigger,
            quarantine=quarantine, target_type=args.target_type, change_type=args.change_type,
        )
    elif args.app == "route":
        query = apps.route_app(
            records, args.checkpoint, out=args.out, bootstrap=None if args.out else sink_servers,
            timespan=args.timespan or DEFAULT_TIMESPAN_KEY, trigger=trigger, quarantine=quarantine,
        )
    elif args.app == "ingest":
        query = apps.ingest_app(
            records, args.checkpoint, out=args.out, kafka=sink, trigger=trigger,
            multiplier=1 if args.multiplier is None else args.multiplier,
            timespan=args.timespan or "day",
            start_date=args.start_date, end_date=args.end_date, quarantine=quarantine,
        )
    elif args.app == "bars":
        if not args.out:
            raise SystemExit("bars needs --out")
        query = apps.bar_app(
            records, args.checkpoint, args.out, trigger=trigger,
            multiplier=5 if args.multiplier is None else args.multiplier,
            timespan=args.timespan or "minute",
        )
    else:
        query = apps.tail_app(records, args.checkpoint, args.out, trigger)
    # the first failure is raised
    running = [query, *(q for q in spark.streams.active if q.id != query.id)]
    while running:
        for q in running:
            q.awaitTermination(1)
        running = [q for q in running if q.isActive]
    query.awaitTermination()
    return query


if __name__ == "__main__":
    run(sys.argv[1:])
