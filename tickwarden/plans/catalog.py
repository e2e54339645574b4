"""The query catalogue: one callable per operator key of the survey.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame computed
from the fixture tables (or from files Spark derives from them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwarden.functions.exprs import iso_datetime, ntz_to_ms
from tickwarden.functions.exprs import round2 as round2_expr
from tickwarden.operators import bars as bars_op
from tickwarden.operators import chains, decode, detectors, messages, points, records, routing, schedule
from tickwarden.operators.pointlog import PointLog
from tickwarden.plans import params as P
from tickwarden.schemas import (
    CHANGE_ALERT_FIELDS,
    LINKED_PAGE,
    PERCENTAGE_CHANGE_ALERT,
    TARGET_ALERT_FIELDS,
    TARGET_PRICE_ALERT,
)
from tickwarden.session import materialized, scratch_path
from tickwarden.sources import files, landing
from tickwarden.sources.tables import event_ticks, order_ticks, read_table
from tickwarden.streaming import apps, jobs
from tickwarden.streaming.replay import land_slice, offset_slices, replay, replay_with_restart

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


# ------------------------------------------------------------ detectors


@query("price_change_alerts")
def q_price_change_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-2, PRJ-6, FLT-2: change alerts on events ticks (threshold 500 %)."""
    return detectors.price_change_alerts(event_ticks(spark, sf_dir), P.PRICE_CHANGE_THRESHOLD)


@query("target_price_alerts")
def q_target_price_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-1, FLT-1: one-shot target alerts on events ticks (target 250)."""
    return detectors.target_price_alerts(event_ticks(spark, sf_dir), P.TARGET_PRICE)


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = event_ticks(spark, sf_dir)
    return detectors.alerts_union(
        detectors.target_price_alerts(ticks, P.TARGET_PRICE),
        detectors.price_change_alerts(ticks, P.PRICE_CHANGE_THRESHOLD),
    )


@query("alerts_union")
def q_alerts_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-1, PRJ-9: both alert shapes in one table."""
    return _alerts(spark, sf_dir)


@query("alert_messages")
def q_alert_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-7, PRJ-8, FLT-5, SNK-6: message text per alert."""
    return messages.alert_messages(_alerts(spark, sf_dir))


@query("alert_records")
def q_alert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1, S16: alert-topic records, per-type JSON, key = ticker."""
    return messages.alert_records(_alerts(spark, sf_dir))


@query("alerts_custom_type")
def q_alerts_custom_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-9, SNK-1, SRC-3, SNK-6 with configured alert types: detectors,
    topic records, and messages read back from them."""
    ticks = event_ticks(spark, sf_dir)
    types = {"target_type": P.CUSTOM_TARGET_TYPE, "change_type": P.CUSTOM_CHANGE_TYPE}
    alerts = detectors.alerts_union(
        detectors.target_price_alerts(ticks, P.TARGET_PRICE, alert_type=P.CUSTOM_TARGET_TYPE),
        detectors.price_change_alerts(
            ticks, P.PRICE_CHANGE_THRESHOLD, alert_type=P.CUSTOM_CHANGE_TYPE
        ),
    )
    topic = messages.alert_records(alerts, **types)
    return messages.alert_messages(messages.alerts_from_records(topic, **types), **types)


@query("message_schedule")
def q_message_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-6: when each alert's message goes out on a channel that takes one
    every 1.2 s."""
    alerts = _alerts(spark, sf_dir).select("ticker", "alert_type", "current_price", schedule.alert_time().alias("arrived"))
    return schedule.send_schedule(alerts, "arrived")


@query("alert_quarantine")
def q_alert_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-5, SNK-7: alert records that give no message.  The reader knows
    another target type than the writer, and the records of tickers ending
    in 3 are garbled."""
    topic = messages.alert_records(_alerts(spark, sf_dir))
    text = F.when(F.col("key").endswith("3"), F.translate("value", ":", "=")).otherwise(F.col("value"))
    return messages.rejected_records(
        topic.select(text.alias("value")), target_type=P.CUSTOM_TARGET_TYPE
    )


@query("order_change_alerts")
def q_order_change_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-2 on a second series: orders by customer, tie-broken by order key."""
    return detectors.price_change_alerts(
        order_ticks(spark, sf_dir),
        P.ORDER_CHANGE_THRESHOLD,
        order_by=("timestamp", "seq"),
    )


# ---------------------------------------------------------- projections


@query("round2")
def q_round2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-5: half-even rounding to cents of lineitem revenue."""
    li = read_table(spark, sf_dir, "lineitem")
    amount = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    return li.select(
        "l_orderkey",
        "l_linenumber",
        amount.alias("amount"),
        round2_expr(amount).alias("amount_r2"),
    )


@query("iso_datetime")
def q_iso_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-2: epoch ms and ISO text of every event."""
    ev = read_table(spark, sf_dir, "events")
    ms = ntz_to_ms(F.col("ts"))
    return ev.select("event_id", ms.alias("timestamp"), iso_datetime(ms).alias("datetime"))


@query("record_json")
def q_record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-3, SNK-5: tick records as JSON text keyed by ticker."""
    return records.tick_records(event_ticks(spark, sf_dir))


# ------------------------------------------------------ decode / pages


@query("decode_ticks")
def q_decode_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEC-1, DEC-2: typed ticks from the dirty tick feed."""
    good, _ = decode.decode(landing.dirty_tick_feed(spark, sf_dir))
    return good


@query("quarantine")
def q_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEC-3, SNK-7: undecodable records with their reason."""
    _, bad = decode.decode(landing.dirty_tick_feed(spark, sf_dir))
    return bad


@query("pages_explode")
def q_pages_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6, GEN-2: landed response pages unnested."""
    path = landing.land(landing.page_feed(spark, sf_dir), scratch_path(spark, "pages"), "json")
    pages, _ = records.decode_pages(files.read_pages(spark, path))
    return records.explode_pages(pages)


def _linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = landing.land(landing.linked_page_feed(spark, sf_dir), scratch_path(spark, "chains"), "json")
    return decode.decode(files.read_pages(spark, path), LINKED_PAGE)[0]


@query("pages_chain")
def q_pages_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6: landed pages put in the order that following ``next_url`` gives,
    with each page's number of bars."""
    pages = _linked_pages(spark, sf_dir)
    ranks = chains.rank_pages(materialized(chains.page_links(pages), "links"))
    bars = pages.select("url", F.size("results").cast("bigint").alias("bars"))
    return ranks.join(bars, "url")


@query("pages_chain_report")
def q_pages_chain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6: how each chain of pages ends (complete, broken, cycle)."""
    links = materialized(chains.page_links(_linked_pages(spark, sf_dir)), "links")
    return chains.chain_report(links, chains.rank_pages(links))


@query("ingest_ticks")
def q_ingest_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6, GEN-2, PRJ-1, FLT-7, SNK-5: landed pages to tick-topic
    records of one week."""
    path = landing.land(landing.page_feed(spark, sf_dir), scratch_path(spark, "pages"), "json")
    pages, _ = records.decode_pages(files.read_pages(spark, path))
    return records.ingest(pages, P.INGEST_START, P.INGEST_END)


@query("bar_records")
def q_bar_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-1: day bars in the upstream wire shape, normalised."""
    raw = bars_op.as_raw_bars(bars_op.bars(event_ticks(spark, sf_dir), 1, "day"))
    return records.normalize_bars(raw)


# ---------------------------------------------------------------- points


@query("price_points")
def q_price_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2, DEC-4, PRJ-4, AGG-4: points with last write wins."""
    pts = points.points_from_records(landing.point_feed(spark, sf_dir), P.MEASUREMENT)
    return points.upsert_points(pts)


@query("points_range")
def q_points_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3, FLT-6: point log written, one week read back with pruning."""
    path = scratch_path(spark, "points")
    pts = points.points_from_records(landing.point_feed(spark, sf_dir), P.MEASUREMENT)
    points.write_point_log(pts, path)
    return points.read_points_range(spark, path, P.RANGE_START, P.RANGE_STOP, P.MEASUREMENT)


@query("points_log_range")
def q_points_log_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3, AGG-4, FLT-6: the point table written in five runs, four of
    them merged, one week read from the files that hold it."""
    feed = landing.point_feed(spark, sf_dir)
    log = PointLog(spark, scratch_path(spark, "point-log"))
    for lo, hi in offset_slices(feed, 5):
        part = feed.where((F.col("offset") >= lo) & (F.col("offset") < hi))
        log.append(points.points_from_records(part, P.MEASUREMENT))
        log.merge()
    return log.read_range(P.RANGE_START, P.RANGE_STOP, P.MEASUREMENT)


@query("date_range")
def q_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-7: orders of 1997 by UTC date."""
    return bars_op.date_range(
        read_table(spark, sf_dir, "orders"), "o_orderdate", P.DATE_RANGE_START, P.DATE_RANGE_END
    )


# ------------------------------------------------------------------ bars


@query("bars_day")
def q_bars_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1: day bars."""
    return _plain_notional(bars_op.bars(event_ticks(spark, sf_dir), 1, "day"))


@query("bars_5min")
def q_bars_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1: 5-minute bars."""
    return _plain_notional(bars_op.bars(event_ticks(spark, sf_dir), 5, "minute"))


@query("bars_month")
def q_bars_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1: calendar-month bars."""
    return _plain_notional(bars_op.bars(event_ticks(spark, sf_dir), 1, "month"))


@query("bars_rollup")
def q_bars_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-2: day bars rolled up to Monday weeks."""
    day = bars_op.bars(event_ticks(spark, sf_dir), 1, "day")
    return _plain_notional(bars_op.bars(day, 1, "week"))


def _plain_notional(bars: DataFrame) -> DataFrame:
    # the exact decimal sum as the nearest double
    return bars.withColumn("notional", F.col("notional").cast("double"))


@query("bars_sub_cent")
def q_bars_sub_cent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1, AGG-2 on prices below a cent: day bars rolled up to weeks."""
    ticks = event_ticks(spark, sf_dir)
    small = ticks.select(
        "ticker", "timestamp", "seq", "size", (F.col("close") / F.lit(P.SUB_CENT)).alias("close")
    )
    return _plain_notional(bars_op.bars(bars_op.bars(small, 1, "day"), 1, "week"))


# --------------------------------------------------------------- routing


@query("route_fields")
def q_route_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-4, GEN-1, FLT-3, FLT-4: one routed record per snapshot field."""
    return routing.route_fields(landing.snapshot_feed(spark, sf_dir))


# ------------------------------------------------------------- streaming
#
# Each streaming key lands a feed derived from the tables below the
# shared checkpoint folder, replays it slice by slice into a file
# stream, and returns what the (exactly-once) sink holds afterwards.


class _Run:
    def __init__(self, spark: SparkSession, name: str) -> None:
        base = scratch_path(spark, name)
        self.landing = f"{base}/in"
        self.out = f"{base}/out"
        self.checkpoint = f"{base}/checkpoint"


def _alert_run(spark: SparkSession, sf_dir: str, restart: bool = False) -> DataFrame:
    run = _Run(spark, "alerts")
    feed = landing.tick_feed(spark, sf_dir)

    def build() -> DataFrame:
        ticks = jobs.decoded_ticks(files.stream_topic(spark, run.landing))
        return jobs.alert_stream(ticks, P.TARGET_PRICE, P.PRICE_CHANGE_THRESHOLD)

    if restart:
        replay_with_restart(
            feed, run.landing, lambda: jobs.start_parquet_sink(build(), run.out, run.checkpoint, available_now=True)
        )
    else:
        replay(feed, run.landing, lambda: jobs.start_parquet_sink(build(), run.out, run.checkpoint))
    return spark.read.parquet(run.out)


@query("stream_alerts")
def q_stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-3, SNK-1: both detectors on one stream."""
    return _alert_run(spark, sf_dir)


@query("stream_price_change_alerts")
def q_stream_price_change_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-2 in streaming."""
    out = _alert_run(spark, sf_dir)
    return out.where(F.col("alert_type") == PERCENTAGE_CHANGE_ALERT).select(*CHANGE_ALERT_FIELDS)


@query("stream_target_price_alerts")
def q_stream_target_price_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-1 in streaming."""
    out = _alert_run(spark, sf_dir)
    return out.where(F.col("alert_type") == TARGET_PRICE_ALERT).select(*TARGET_ALERT_FIELDS)


@query("stream_resume")
def q_stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-4: stop and restart on the checkpoint after every slice."""
    return _alert_run(spark, sf_dir, restart=True)


@query("stream_alerts_midway")
def q_stream_alerts_midway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-4: a fresh stream that starts in the middle of the history with the
    state of its first half; with the first half's alerts, those of the whole."""
    run = _Run(spark, "midway")
    ticks, feed = event_ticks(spark, sf_dir), landing.tick_feed(spark, sf_dir)
    (lo, middle), (_, hi) = offset_slices(feed, 2)
    history = ticks.where(F.col("seq") < middle)
    state = materialized(detectors.detector_state(history, P.TARGET_PRICE), "state")
    land_slice(feed, run.landing, middle, hi)
    later = jobs.alert_stream(
        jobs.decoded_ticks(files.stream_topic(spark, run.landing, None)), P.TARGET_PRICE, P.PRICE_CHANGE_THRESHOLD,
        api="transform_with_state", initial_state=state,
    )
    jobs.start_parquet_sink(later, run.out, run.checkpoint, available_now=True).awaitTermination()
    return detectors.alerts_union(
        detectors.target_price_alerts(history, P.TARGET_PRICE),
        detectors.price_change_alerts(history, P.PRICE_CHANGE_THRESHOLD),
        spark.read.parquet(run.out),
    )


@query("stream_state")
def q_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-4: what the alert stream's checkpoint holds after the whole feed."""
    run = _Run(spark, "state")
    feed = landing.tick_feed(spark, sf_dir)

    def start():
        ticks = jobs.decoded_ticks(files.stream_topic(spark, run.landing))
        alerts = jobs.alert_stream(ticks, P.TARGET_PRICE, P.PRICE_CHANGE_THRESHOLD)
        return jobs.start_parquet_sink(alerts, run.out, run.checkpoint)

    replay(feed, run.landing, start)
    return jobs.stored_state(spark, run.checkpoint)


@query("stream_messages")
def q_stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops through the alert topic: the alert application writes
    per-type alert JSON, the message application reads and decodes it."""
    ticks = _Run(spark, "alert-topic")
    msgs = _Run(spark, "messages")
    feed = landing.tick_feed(spark, sf_dir)
    replay(
        feed,
        ticks.landing,
        lambda: apps.alert_app(
            files.stream_topic(spark, ticks.landing), P.TARGET_PRICE, P.PRICE_CHANGE_THRESHOLD,
            ticks.checkpoint, out=ticks.out,
        ),
    )
    query = apps.message_app(
        files.stream_topic(spark, ticks.out), msgs.checkpoint, out=msgs.out, trigger="availableNow"
    )
    query.awaitTermination()
    return spark.read.parquet(msgs.out)


@query("stream_messages_once")
def q_stream_messages_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1, SNK-6: an alert topic that holds each record one to three times,
    the repeats in later micro-batches, gives each message once."""
    run = _Run(spark, "once")
    topic = messages.alert_records(_alerts(spark, sf_dir))
    copies = F.explode(F.sequence(F.lit(0), F.pmod(F.xxhash64("value"), F.lit(3)).cast("int"))).alias("copy")
    feed = materialized(topic.select("value", copies), "once")
    replay(
        feed.select("value", F.col("copy").cast("bigint").alias("offset")),
        run.landing,
        lambda: apps.message_app(
            files.stream_topic(spark, run.landing), run.checkpoint, out=run.out, once_within=P.ONCE_WITHIN
        ),
        slices=3,
    )
    return spark.read.parquet(run.out)


def _split_run(spark: SparkSession, sf_dir: str) -> _Run:
    """Dirty tick feed through the one-parse, two-output split sink."""
    run = _Run(spark, "split")
    feed = landing.dirty_tick_feed(spark, sf_dir)
    replay(
        feed,
        run.landing,
        lambda: jobs.start_split_sink(
            files.stream_topic(spark, run.landing), f"{run.out}/good", f"{run.out}/bad", run.checkpoint
        ),
    )
    return run


@query("stream_quarantine")
def q_stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEC-3, SNK-7 in streaming: the split sink's quarantine output."""
    run = _split_run(spark, sf_dir)
    return spark.read.parquet(f"{run.out}/bad").select("value", "reason")


@query("stream_pages")
def q_stream_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6 as a stream: response pages land as JSON files over time."""
    run = _Run(spark, "pages")
    feed = landing.page_feed(spark, sf_dir)
    replay(
        feed,
        run.landing,
        lambda: jobs.start_parquet_sink(
            records.explode_pages(records.decode_pages(files.stream_pages(spark, run.landing))[0]),
            run.out,
            run.checkpoint,
        ),
        fmt="json",
        order_col="page",
    )
    return spark.read.parquet(run.out)


@query("scan_ticks")
def q_scan_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1: tick topic (file twin) decoded by a stream."""
    run = _Run(spark, "scan")
    feed = landing.tick_feed(spark, sf_dir)

    def start():
        ticks = jobs.decoded_ticks(files.stream_topic(spark, run.landing)).drop("offset")
        return jobs.start_parquet_sink(ticks, run.out, run.checkpoint)

    replay(feed, run.landing, start)
    return spark.read.parquet(run.out)


@query("raw_tail")
def q_raw_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-5, SNK-2: raw topic records as they arrive."""
    run = _Run(spark, "tail")
    feed = landing.tick_feed(spark, sf_dir)
    replay(
        feed,
        run.landing,
        lambda: jobs.start_parquet_sink(files.stream_topic(spark, run.landing), run.out, run.checkpoint),
    )
    return spark.read.parquet(run.out)


@query("snapshot_scan")
def q_snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-7: landed snapshot text as a stream."""
    run = _Run(spark, "snapshots")
    feed = landing.snapshot_feed(spark, sf_dir)
    replay(
        feed,
        run.landing,
        lambda: jobs.start_parquet_sink(files.stream_text(spark, run.landing), run.out, run.checkpoint),
        fmt="text",
    )
    return spark.read.parquet(run.out)


@query("stream_points")
def q_stream_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3 in streaming: point log appended, upserted at read."""
    run = _Run(spark, "points")
    feed = landing.point_feed(spark, sf_dir)
    replay(
        feed,
        run.landing,
        lambda: jobs.start_parquet_sink(
            jobs.point_stream(files.stream_topic(spark, run.landing), P.MEASUREMENT),
            run.out,
            run.checkpoint,
            partition_by=("measurement", "date"),
        ),
    )
    return points.upsert_points(spark.read.parquet(run.out))


@query("stream_route")
def q_stream_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-4 in streaming: routed fields partitioned by topic."""
    run = _Run(spark, "route")
    feed = landing.snapshot_feed(spark, sf_dir)
    replay(
        feed,
        run.landing,
        lambda: jobs.start_parquet_sink(
            jobs.route_stream(files.stream_topic(spark, run.landing)),
            run.out,
            run.checkpoint,
            partition_by=("topic",),
        ),
    )
    return spark.read.parquet(run.out).select("topic", "value")


@query("stream_snapshot_route")
def q_stream_snapshot_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-7 to SNK-4: whole-file snapshot documents routed by field, one
    parse for the routed fields and the quarantine."""
    run = _Run(spark, "documents")
    landing.land_documents(landing.snapshot_documents(spark, sf_dir), run.landing)
    apps.route_app(
        files.stream_text(spark, run.landing, whole_text=True, max_files_per_trigger=None),
        run.checkpoint, out=f"{run.out}/routed", quarantine=f"{run.out}/rejected",
        trigger="availableNow", partition_by=(),
    ).awaitTermination()
    return spark.read.parquet(f"{run.out}/routed").select("topic", "value")


@query("stream_ingest")
def q_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6 to SNK-5 as an application: pages landing over time to
    tick-topic records of one week, refused bars to a quarantine."""
    run = _Run(spark, "ingest")
    replay(
        landing.page_feed(spark, sf_dir),
        run.landing,
        lambda: apps.ingest_app(
            files.stream_pages(spark, run.landing), run.checkpoint, out=f"{run.out}/good",
            start_date=P.INGEST_START, end_date=P.INGEST_END, quarantine=f"{run.out}/bad",
        ),
        fmt="json",
        order_col="page",
    )
    return spark.read.parquet(f"{run.out}/good").select("key", "value")


def _stream_bars(
    spark: SparkSession, sf_dir: str, multiplier: int, timespan: str, late: Column | None = None
) -> DataFrame:
    run = _Run(spark, "bars")
    feed = landing.tick_feed(spark, sf_dir, late)

    def start():
        ticks = jobs.decoded_ticks(files.stream_topic(spark, run.landing))
        return jobs.start_bar_sink(jobs.bar_stream(ticks, multiplier, timespan), run.out, run.checkpoint)

    replay(feed, run.landing, start)
    jobs.compact_bars(spark, run.out)
    return _plain_notional(jobs.latest_bars(spark, run.out, multiplier, timespan))


@query("stream_bars")
def q_stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-3, ST-5: 5-minute bars with the 15 s watermark."""
    return _stream_bars(spark, sf_dir, 5, "minute")


@query("stream_bars_month")
def q_stream_bars_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-3 on a calendar span: month bars from streamed day bars."""
    return _stream_bars(spark, sf_dir, 1, "month")


@query("stream_bars_month_late")
def q_stream_bars_month_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-3: month bars of rows that arrive up to 10 s late."""
    late = (F.col("seq") % F.lit(3)) * F.lit(P.LATE_MS)
    return _stream_bars(spark, sf_dir, 1, "month", late)


@query("stream_bars_closed")
def q_stream_bars_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-3, ST-5: day bars emitted once, when the watermark closes them."""
    run = _Run(spark, "closed-bars")
    replay(
        landing.tick_feed(spark, sf_dir),
        run.landing,
        lambda: apps.closing_bar_app(
            files.stream_topic(spark, run.landing), run.checkpoint, f"{run.out}/bars", f"{run.out}/late", 1, "day",
        ),
    )
    return _plain_notional(spark.read.parquet(f"{run.out}/bars").select(*bars_op.BAR_FIELDS))


@query("stream_alerts_disorder")
def q_stream_alerts_disorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-3: alerts follow arrival order (disordered times) and are the
    same for every number of slices of the topic a micro-batch takes."""
    run = _Run(spark, "disorder")
    feed = landing.tick_feed(spark, sf_dir, (F.col("seq") * F.lit(7) % F.lit(13)) * F.lit(P.DISORDER_MS))
    slices = offset_slices(feed, 4)
    out = None
    for n in P.FILES_PER_TRIGGER:  # slices a micro-batch takes, each of many files
        for i in range(0, len(slices), n):
            group = slices[i : i + n]
            land_slice(feed, f"{run.landing}-{n}", group[0][0], group[-1][1])
            ticks = jobs.decoded_ticks(files.stream_topic(spark, f"{run.landing}-{n}", None))
            alerts = jobs.alert_stream(ticks, P.TARGET_PRICE, P.PRICE_CHANGE_THRESHOLD)
            jobs.start_parquet_sink(
                alerts, f"{run.out}-{n}", f"{run.checkpoint}-{n}", available_now=True
            ).awaitTermination()
        got = spark.read.parquet(f"{run.out}-{n}").withColumn("files_per_trigger", F.lit(n))
        out = got if out is None else out.unionByName(got)
    return out
