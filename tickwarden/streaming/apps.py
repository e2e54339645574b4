"""The reference's programs as Structured Streaming applications.

Each takes a streaming DataFrame of topic records ``(value, offset)`` -
from ``sources.kafka.read_topic_stream`` or the file twin
``sources.files.stream_topic`` - and starts one query writing either to
Kafka (``kafka=(bootstrap, topic)``) or to an exactly-once parquet
folder (``out=path``).  ``trigger`` takes a processing-time interval
such as ``"60 seconds"`` (the reference checkpoints every 60 s);
``None`` runs micro-batches back to back, ``"availableNow"`` drains what
is there and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickwarden.operators import bars, messages
from tickwarden.operators import records as records_op
from tickwarden.schemas import (
    DEFAULT_MEASUREMENT,
    DEFAULT_TIMESPAN_KEY,
    PERCENTAGE_CHANGE_ALERT,
    TARGET_PRICE_ALERT,
)
from tickwarden.sources import kafka as kafka_io
from tickwarden.streaming import closing, jobs


def _one(out: str | None, kafka: tuple[str, str | None] | None) -> jobs.Target:
    if (out is None) == (kafka is None):
        raise ValueError("give exactly one of out= or kafka=")
    return out if kafka is None else kafka


def _start(
    df: DataFrame,
    checkpoint: str,
    out: str | None,
    kafka: tuple[str, str | None] | None,
    trigger: str | None,
    partition_by: tuple[str, ...] = (),
) -> StreamingQuery:
    _one(out, kafka)
    if kafka is not None:
        bootstrap, topic = kafka
        writer = (
            df.writeStream.format("kafka")
            .options(**kafka_io.sink_options(bootstrap, checkpoint, topic))
            .outputMode("append")
        )
    else:
        writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer = writer.option("path", out).outputMode("append")
    return jobs.triggered(writer, trigger).start()


def alert_app(
    records: DataFrame,
    target: float | None,
    threshold: float | None,
    checkpoint: str,
    out: str | None = None,
    kafka: tuple[str, str | None] | None = None,
    trigger: str | None = None,
    zero_policy: str = "latch",
    quarantine: jobs.Target | None = None,
    target_type: str = TARGET_PRICE_ALERT,
    change_type: str = PERCENTAGE_CHANGE_ALERT,
) -> StreamingQuery:
    """Tick topic -> both detectors -> alert topic (per-type JSON, key = ticker).

    With ``quarantine`` (a folder, or a dead-letter topic as ``(bootstrap,
    topic)``), undecodable records ``(value, reason, offset)`` go there, from
    the same scan and decode: one query, whose outputs a ledger keeps apart.
    """
    if quarantine is not None:
        return jobs.start_alert_split_sink(
            records, target, threshold, _one(out, kafka), quarantine, checkpoint, trigger, zero_policy,
            target_type, change_type,
        )
    alerts = jobs.alert_stream(
        jobs.decoded_ticks(records), target, threshold, zero_policy=zero_policy,
        target_type=target_type, change_type=change_type,
    )
    recs = messages.alert_records(alerts, target_type, change_type)
    return _start(recs, checkpoint, out, kafka, trigger)


def point_app(
    records: DataFrame,
    checkpoint: str,
    out: str,
    measurement: str = DEFAULT_MEASUREMENT,
    trigger: str | None = None,
) -> StreamingQuery:
    """Tick topic -> point log (parquet by measurement and date; upsert at read)."""
    return _start(
        jobs.point_stream(records, measurement), checkpoint, out, None, trigger, ("measurement", "date")
    )


def message_app(
    records: DataFrame,
    checkpoint: str,
    out: str | None = None,
    kafka: tuple[str, str | None] | None = None,
    trigger: str | None = None,
    quarantine: jobs.Target | None = None,
    target_type: str = TARGET_PRICE_ALERT,
    change_type: str = PERCENTAGE_CHANGE_ALERT,
    once_within: str | None = None,
) -> StreamingQuery:
    """Alert topic -> message text (key = ticker, value = message).

    With ``once_within`` (such as ``"1 day"``, longer than alerts are apart
    in time within a micro-batch), alerts that the at-least-once topic
    repeats give one message.

    With ``quarantine`` (a folder or a dead-letter topic), records that are
    no alert or of an unknown or missing type go there, from the same
    parse; folders then hold one folder per micro-batch.
    """
    if quarantine is not None:
        if once_within:
            raise ValueError("once_within= and quarantine= exclude each other")
        return jobs.start_message_split_sink(
            records, _one(out, kafka), quarantine, checkpoint, target_type, change_type, trigger
        )
    alerts = messages.alerts_from_records(records, target_type=target_type, change_type=change_type)
    if once_within:
        alerts = jobs.once(alerts, once_within)
    msgs = messages.alert_messages(alerts, target_type, change_type)
    if kafka is not None:
        msgs = messages.keyed(msgs)
    return _start(msgs, checkpoint, out, kafka, trigger)


def route_app(
    records: DataFrame,
    checkpoint: str,
    out: str | None = None,
    bootstrap: str | None = None,
    timespan: str = DEFAULT_TIMESPAN_KEY,
    trigger: str | None = None,
    quarantine: jobs.Target | None = None,
    partition_by: tuple[str, ...] = ("topic",),
) -> StreamingQuery:
    """Snapshot topic -> one record per field, routed to the topic named
    after the field (Kafka) or to ``topic=<field>`` folders (files).

    With ``quarantine`` (a folder or a dead-letter topic), each micro-batch
    is parsed once and written twice: routed fields (below ``out``, by batch
    and topic, or to the topics they name), and snapshots without the
    timespan object.
    With very many fields, ``partition_by=()`` keeps the topic a column
    instead of a folder for each.
    """
    if quarantine is not None:
        target = _one(out, (bootstrap, None) if bootstrap else None)
        return jobs.start_route_split_sink(records, target, quarantine, checkpoint, timespan, trigger, partition_by)
    routed = jobs.route_stream(records, timespan)
    kafka = (bootstrap, None) if bootstrap else None
    return _start(routed, checkpoint, out, kafka, trigger, () if kafka else partition_by)


def ingest_app(
    pages: DataFrame,
    checkpoint: str,
    out: str | None = None,
    kafka: tuple[str, str | None] | None = None,
    multiplier: int = 1,
    timespan: str = "day",
    start_date: str | None = None,
    end_date: str | None = None,
    trigger: str | None = None,
    quarantine: jobs.Target | None = None,
) -> StreamingQuery:
    """History pages (``sources.files.stream_pages``) -> tick topic.

    The request's parameters are checked; bars outside the dates are left
    out.  With ``quarantine`` (a folder or a dead-letter topic), text that
    is no page and bars that lack a field go there, from the same parse.
    """
    bars.validate_bar_params(multiplier, timespan, start_date, end_date)
    if quarantine is not None:
        return jobs.start_ingest_split_sink(
            pages, _one(out, kafka), quarantine, checkpoint, start_date, end_date, trigger
        )
    good, _ = records_op.decode_pages(pages)
    return _start(records_op.ingest(good, start_date, end_date), checkpoint, out, kafka, trigger)


def bar_app(
    records: DataFrame,
    checkpoint: str,
    out: str,
    multiplier: int = 5,
    timespan: str = "minute",
    trigger: str | None = None,
    compact_every: int = 0,
) -> StreamingQuery:
    """Tick topic -> bar folders (read with ``jobs.latest_bars``), merged
    every ``compact_every`` micro-batches."""
    ticks = jobs.decoded_ticks(records)
    bars_out = jobs.bar_stream(ticks, multiplier, timespan)
    return jobs.start_bar_sink(bars_out, out, checkpoint, trigger, compact_every)


def closing_bar_app(
    records: DataFrame,
    checkpoint: str,
    out: str,
    late: jobs.Target,
    multiplier: int = 5,
    timespan: str = "minute",
    delay: str = jobs.DEFAULT_WATERMARK,
    trigger: str | None = None,
) -> StreamingQuery:
    """Tick topic -> bars, each written once when the watermark closes it, and
    the ticks that come too late for theirs (a folder, or a topic of tick
    text); one folder per micro-batch."""
    tagged = closing.closing_bars(jobs.decoded_ticks(records), multiplier, timespan, delay)

    def too_late(batch: DataFrame) -> DataFrame:
        rows = closing.late_rows(batch)
        if isinstance(late, str):
            return rows
        return rows.select(F.col("ticker").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))

    return jobs.start_split_outputs(
        tagged, lambda batch: batch, [(closing.closed_bars, out, ()), (too_late, late, ())], checkpoint, trigger
    )


def tail_app(
    records: DataFrame, checkpoint: str, out: str | None = None, trigger: str | None = None
) -> StreamingQuery:
    """Any topic as it arrives, undecoded: to a folder, or (for a look at
    it) to the console."""
    if out is None:
        return jobs.start_debug_sink(records, trigger=trigger)
    return _start(records, checkpoint, out, None, trigger)
