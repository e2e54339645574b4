"""Structured Streaming builders: alerts, points, routing, bars, and sinks.

Every builder takes a streaming DataFrame of topic records
``(value, offset)`` (a Kafka source or its file twin) and returns a
streaming DataFrame; ``start_*`` helpers attach a sink and a checkpoint.
The file sinks are exactly-once (their commit log lives next to the
data); the Kafka sink is at-least-once and alerts carry ``ticker``,
``timestamp`` and ``alert_type`` so consumers can drop repeats.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tickwarden.functions.exprs import ms_to_instant
from tickwarden.operators import bars as bars_op
from tickwarden.operators import decode, messages, points, routing, schedule
from tickwarden.operators import records as records_op
from tickwarden.schemas import (
    ALERT,
    DEFAULT_MEASUREMENT,
    DEFAULT_TIMESPAN_KEY,
    PAGE,
    PERCENTAGE_CHANGE_ALERT,
    TARGET_PRICE_ALERT,
)
from tickwarden.session import ship_package, use_rocksdb_state
from tickwarden.sources import kafka
from tickwarden.streaming.processor import (
    HELD_SCHEMA,
    NULL_INT,
    SHARD_STATE_SCHEMA,
    AlertLogic,
    AlertProcessor,
    shard_state_function,
    tagged_state_function,
)

# The reference attaches a 15 s bounded-out-of-orderness watermark.
DEFAULT_WATERMARK = "15 seconds"
# spans without a fixed length
CALENDAR_SPANS = ("month", "quarter", "year")
# the run folder of merged bar versions
COMPACTED = "compacted"
# what a merge replaced, removed by the merge after it
REPLACED = "_replaced"
# tasks that write the points of one hour of a micro-batch
WRITERS = 8
# Tickers share a Python call and a state value by the hash of their name.  A
# checkpoint is bound to this number.
SHARDS = 1024
# A folder, or a Kafka topic as (bootstrap servers, topic).
Target = str | tuple[str, str]


def decoded_ticks(records: DataFrame) -> DataFrame:
    """DEC-1: good tick rows of a topic stream (bad rows: ``quarantined``),
    with their arrival columns."""
    good, _ = decode.decode(records, keep=arrival_columns(records))
    return good


def arrival_columns(df: DataFrame) -> tuple[str, ...]:
    """The columns that give a topic's arrival order.  A ticker's records
    share one partition, so partition and offset order them."""
    return tuple(c for c in ("partition", "offset") if c in df.columns)


def quarantined(records: DataFrame) -> DataFrame:
    """DEC-3 / SNK-7: ``(value, reason, offset)`` of undecodable records."""
    _, bad = decode.decode(records, keep=("offset",))
    return bad


def alert_stream(
    ticks: DataFrame,
    target: float | None,
    threshold: float | None,
    order_by: Sequence[str] | None = None,
    zero_policy: str = "latch",
    api: str = "pandas_with_state",
    target_type: str = TARGET_PRICE_ALERT,
    change_type: str = PERCENTAGE_CHANGE_ALERT,
    initial_state: DataFrame | None = None,
) -> DataFrame:
    """ST-1..3: both detectors over one keyed stream, append mode.

    Detectors follow arrival order, across micro-batches and (by the
    topic's partition and offset, unless ``order_by`` is given) inside
    one, so the micro-batch borders never show in the alerts.  The
    watermark is not applied: the
    reference never drops late rows from the detectors.
    ``zero_policy="skip"`` drops zero closes before the shuffle, as the
    batch detector does.  ``api`` picks ``applyInPandasWithState``
    (default) or ``transformWithStateInPandas`` (``"transform_with_state"``).
    ``initial_state`` (``detectors.detector_state`` of the history before the
    stream; the second API only) lets a fresh stream go on where it ended.
    """
    if initial_state is not None and api != "transform_with_state":
        raise ValueError("initial_state needs api='transform_with_state'")
    if zero_policy not in ("latch", "skip"):
        raise ValueError("zero_policy must be 'latch' or 'skip'")
    spark = ticks.sparkSession
    use_rocksdb_state(spark)
    ship_package(spark)
    order_by = list(order_by or arrival_columns(ticks) or ("timestamp",))
    cols = list(dict.fromkeys(["ticker", "timestamp", "datetime", "close", *order_by]))
    # null closes never change either detector's state: drop them here,
    # where null and NaN are still distinct (pandas would merge them)
    keep = F.col("close").isNotNull()
    if zero_policy == "skip":
        keep = keep & (F.col("close") != 0)
    rows = ticks.where(keep).select(*cols)
    logic = AlertLogic(target, threshold, order_by, target_type, change_type)
    if api == "pandas_with_state":
        return rows.select(shard().alias("shard"), *whole_integers(rows)).groupBy("shard").applyInPandasWithState(
            shard_state_function(logic), ALERT, SHARD_STATE_SCHEMA, "append", "NoTimeout"
        )
    if api == "transform_with_state":
        return rows.groupBy("ticker").transformWithStateInPandas(
            statefulProcessor=AlertProcessor(logic),
            outputStructType=ALERT,
            outputMode="Append",
            timeMode="None",
            initialState=None if initial_state is None else initial_state.groupBy("ticker"),
        )
    raise ValueError("api must be 'pandas_with_state' or 'transform_with_state'")


def shard() -> Column:
    return F.pmod(F.xxhash64("ticker"), F.lit(SHARDS)).cast("int")


def whole_integers(rows: DataFrame) -> list[Column]:
    """The columns, integers without nulls: one null would make pandas turn a
    shard's whole column into floating numbers."""
    integer = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return [
        F.coalesce(F.col(f.name).cast("bigint"), F.lit(NULL_INT)).alias(f.name) if isinstance(f.dataType, integer)
        else F.col(f.name)
        for f in rows.schema.fields
    ]


def once(alerts: DataFrame, within: str) -> DataFrame:
    """SNK-1's at-least-once topic read exactly once: alerts equal in all
    fields count once if they come within ``within`` of each other's time.
    Those without a time (no watermark can retire them) are kept in state for
    good."""
    at = F.timestamp_millis(schedule.alert_time())
    fields = [f.name for f in ALERT.fields]
    timed = alerts.withColumn("event_time", at)
    first = timed.where(F.col("event_time").isNotNull()).withWatermark("event_time", within)
    untimed = timed.where(F.col("event_time").isNull()).dropDuplicates(fields)
    return first.dropDuplicatesWithinWatermark(fields).select(*fields).unionByName(untimed.select(*fields))


def stored_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """ST-4: ``(ticker, latched, last_close)`` as an alert stream's checkpoint
    holds them now (either API), by the state data source."""
    reader = spark.read.format("statestore")
    try:
        held = reader.option("stateVarName", "detectors").load(checkpoint)
        state = "value"
    except Exception:  # no named variables: applyInPandasWithState
        held = spark.read.format("statestore").load(checkpoint)
        text = F.from_json("value.groupState.held", HELD_SCHEMA)
        each = F.inline(F.arrays_zip(text["tickers"], text["latched"], text["last_close"]))
        return held.select(each.alias("ticker", "latched", "last_close"))
    return held.select("key.ticker", F.col(f"{state}.latched").alias("latched"), F.col(f"{state}.last_close").alias("last_close"))


# records that give no tick spread over so many keys
REJECTED_PARTS = 64
TAGGED = T.StructType(
    [*ALERT.fields, T.StructField("value", T.StringType()), T.StructField("reason", T.StringType()),
     T.StructField("offset", T.LongType())]
)


def tagged_alert_stream(
    records: DataFrame,
    target: float | None,
    threshold: float | None,
    zero_policy: str = "latch",
    target_type: str = TARGET_PRICE_ALERT,
    change_type: str = PERCENTAGE_CHANGE_ALERT,
) -> DataFrame:
    """KEY-2, DEC-3: one scan and one decode for alerts and rejected records.

    Rows are alerts (``reason`` null) or records that gave no tick
    (``value``, ``reason``, ``offset``).  Rejected records pass the
    detectors' shuffle under keys of their own and leave no state.
    """
    if zero_policy not in ("latch", "skip"):
        raise ValueError("zero_policy must be 'latch' or 'skip'")
    spark = records.sparkSession
    use_rocksdb_state(spark)
    ship_package(spark)
    arrival = arrival_columns(records)
    parsed = decode.parse(records)
    bad, close = F.col("reason").isNotNull(), F.col("rec.close")
    usable = close.isNotNull() if zero_policy == "latch" else close.isNotNull() & (close != 0)
    own_part = F.pmod(F.xxhash64("value", *arrival), F.lit(REJECTED_PARTS)).cast("int")
    ticks = parsed.where(bad | usable).withColumn("ticker", F.when(~bad, F.col("rec.ticker")))
    rows = ticks.select(
        F.when(~bad, shard()).alias("shard"),
        "ticker",
        F.when(bad, own_part).otherwise(F.lit(-1)).alias("part"),
        *[F.col(f"rec.{c}").alias(c) for c in ("timestamp", "datetime", "close")],
        F.when(bad, F.col("value").cast("string")).alias("value"),
        "reason",
        *arrival,
    )
    logic = AlertLogic(target, threshold, list(arrival or ("timestamp",)), target_type, change_type)
    if "offset" not in arrival:
        rows = rows.withColumn("offset", F.lit(None).cast("bigint"))
    rows = rows.select("shard", "part", *whole_integers(rows.drop("shard", "part")))
    return rows.groupBy("shard", "part").applyInPandasWithState(
        tagged_state_function(logic), TAGGED, SHARD_STATE_SCHEMA, "append", "NoTimeout"
    )


def start_alert_split_sink(
    records: DataFrame,
    target: float | None,
    threshold: float | None,
    out: Target,
    quarantine: Target,
    checkpoint: str,
    trigger: str | None = None,
    zero_policy: str = "latch",
    target_type: str = TARGET_PRICE_ALERT,
    change_type: str = PERCENTAGE_CHANGE_ALERT,
) -> StreamingQuery:
    """ST-3 + SNK-1 + SNK-7 in one query: alert records, rejected records."""
    tagged = tagged_alert_stream(records, target, threshold, zero_policy, target_type, change_type)

    def alerts(batch: DataFrame) -> DataFrame:
        found = batch.where(F.col("reason").isNull()).select(*[f.name for f in ALERT.fields])
        return messages.alert_records(found, target_type, change_type)

    def rejected(batch: DataFrame) -> DataFrame:
        return batch.where(F.col("reason").isNotNull()).select("value", "reason", "offset")

    return start_split_outputs(
        tagged, lambda batch: batch, [(alerts, out, ()), dead_letters(rejected, quarantine)], checkpoint, trigger, flat=True
    )


def point_stream(records: DataFrame, measurement: str = DEFAULT_MEASUREMENT) -> DataFrame:
    """SRC-2 + DEC-4 + PRJ-4: points to append to the point log.

    Each micro-batch (bounded by the trigger) is hash-partitioned by
    measurement, date, hour and a share of the tickers, so at most
    ``24 x WRITERS`` tasks write a date folder instead of every task
    writing a small file into every folder, and a live feed, whose batch
    lies within one hour, spreads over ``WRITERS`` tasks.
    """
    share = F.pmod(F.xxhash64("ticker"), F.lit(WRITERS))
    return (
        points.points_from_records(records, measurement)
        .withColumn("date", F.col("time").cast("date"))
        .repartition("measurement", "date", F.hour("time"), share)
    )


def route_stream(records: DataFrame, timespan: str = DEFAULT_TIMESPAN_KEY) -> DataFrame:
    """SRC-4 + GEN-1: routed ``(topic, value)`` records."""
    return routing.route_fields(records, timespan)


def bar_stream(
    ticks: DataFrame,
    multiplier: int = 5,
    timespan: str = "minute",
    delay: str = DEFAULT_WATERMARK,
) -> DataFrame:
    """AGG-3: streaming bars of ``multiplier x timespan`` with a watermark.

    Emitted in ``update`` mode: every micro-batch re-emits the bars it
    changed, and the latest emission of a bar is its value
    (``latest_bars``).  Fixed spans use ``window()`` on the event time
    (weeks start on Monday).  Calendar spans (month, quarter, year) have
    no ``window()``: the stream keeps day bars, whose windows carry the
    watermark, and ``latest_bars`` rolls them up to the calendar bars
    when reading.  Rows later than the watermark are dropped - the
    documented streaming trade-off.
    """
    bars_op.validate_bar_params(multiplier, timespan)
    rows = ticks.withColumn("event_time", ms_to_instant(F.col("timestamp")))
    inputs = bars_op.bar_inputs(rows, order_by=("timestamp", "offset"))
    fixed = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400}
    seconds = fixed[timespan] * multiplier if timespan in fixed else fixed["day"]
    start = "4 days" if timespan == "week" else None  # 1970-01-05 was a Monday
    w = F.window("event_time", f"{seconds} seconds", startTime=start)
    agg = (
        inputs.withWatermark("event_time", delay)
        .groupBy("ticker", w.alias("w"))
        .agg(*bars_op.bar_aggregates())
        .withColumn("bucket", F.unix_millis(F.col("w.start")))
    )
    return bars_op.bar_output(agg)


def latest_bars(
    spark: SparkSession, path: str, multiplier: int = 1, timespan: str | None = None
) -> DataFrame:
    """Read bars written per micro-batch and keep each bar's last version,
    by the time of its emission.  For a calendar span give ``multiplier``
    and ``timespan``: the day bars are rolled up.
    """
    last = _last_versions(spark.read.parquet(path)).drop("emitted_at")
    return bars_op.bars(last, multiplier, timespan) if timespan in CALENDAR_SPANS else last


def _last_versions(emitted: DataFrame) -> DataFrame:
    """A bar only gains trades, so the version with most trades is the last,
    whatever the writers' clocks say; the time decides among equal ones."""
    cols = [c for c in emitted.columns if c not in ("ticker", "timestamp", "run", "batch_id")]
    last = emitted.groupBy("ticker", "timestamp").agg(
        F.max_by(F.struct(*cols), F.struct("number_of_trades", "emitted_at", "batch_id")).alias("b")
    )
    return last.select("ticker", "timestamp", *[F.col(f"b.{c}").alias(c) for c in cols])


def compact_bars(spark: SparkSession, path: str, grace: bool = False) -> int:
    """Replace the folders of finished micro-batches by one that holds the
    last version of each of their bars; returns how many it replaced.

    Each run's newest folder stays, since a replay may write it again, so
    this may run beside the stream.  The new folder is complete before an
    old one goes.  With ``grace`` the folders that a merge has replaced are
    removed by the next merge only, so a reader that has listed them still
    finds them; until then some bars are there twice, with the same result.
    A merge that broke off is made good by the next one, whatever step it
    had reached.  The driver handles folder names only.
    """
    ledger = Ledger(spark, f"{path}/{REPLACED}")
    replaced = ledger.names()  # "<run>,<batch>" of folders merged before
    emitted = spark.read.parquet(path)
    folders = [f"{f.run},{f.batch_id}" for f in emitted.select("run", "batch_id").distinct().collect()]
    newest: dict[str, int] = {}
    for run, batch in (f.split(",") for f in folders):
        newest[run] = max(newest.get(run, -1), int(batch))
    gone = set(replaced)
    merged = [f for f in folders if f.startswith(f"{COMPACTED},") and f not in gone]
    finished = [f for f in folders if not f.startswith(f"{COMPACTED},") and f not in gone
                and int(f.split(",")[1]) < newest[f.split(",")[0]]]
    if len(merged) + len(finished) < 2:
        return 0
    # finished means below its run's newest: a condition per run, not per folder
    below = F.col("run") == COMPACTED
    for run, batch in newest.items():
        if run != COMPACTED:
            below = below | ((F.col("run") == run) & (F.col("batch_id") < batch))
    _last_versions(emitted.where(below)).write.mode("overwrite").parquet(
        f"{path}/run={COMPACTED}/batch_id={newest.get(COMPACTED, -1) + 1}"
    )
    for name in [*merged, *finished]:
        ledger.add(name)
    folder = Ledger(spark, path)
    for name in replaced if grace else ledger.names():
        run, batch = name.split(",")
        folder.drop([f"run={run}/batch_id={batch}"])
        ledger.drop([name])
    return len(merged) + len(finished)


class Ledger:
    """Names of finished steps: empty files in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.folder = self._path(folder)
        self.store = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def holds(self, name: str) -> bool:
        return self.store.exists(self._path(self.folder, name))

    def add(self, name: str) -> None:
        self.store.create(self._path(self.folder, name), True).close()

    def drop(self, names: Sequence[str]) -> None:
        for name in names:
            self.store.delete(self._path(self.folder, name), True)

    def names(self) -> list[str]:
        if not self.store.exists(self.folder):
            return []
        return sorted(f.getPath().getName() for f in self.store.listStatus(self.folder))


def batch_folder(path: str, checkpoint: str, batch_id: int) -> str:
    """The folder of one micro-batch.  Batches count from 0 again on a new
    checkpoint, so each checkpoint has a folder of its own."""
    return f"{path}/run=r{zlib.crc32(checkpoint.encode()):08x}/batch_id={batch_id}"


def batch_name(checkpoint: str, batch_id: int) -> str:
    return f"r{zlib.crc32(checkpoint.encode()):08x}-{batch_id}"


def write_flat(rows: DataFrame, folder: str, name: str) -> None:
    """A micro-batch's files, written aside and moved into the folder under the
    batch's name.  Files that an earlier attempt of the batch has moved are
    replaced."""
    spark, aside = rows.sparkSession, f"{folder}/_{name}"
    rows.write.mode("overwrite").parquet(aside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in store.globStatus(path(folder, f"{name}-part-*")):
        store.delete(old.getPath(), False)
    for new in store.globStatus(path(aside, "part-*")):
        store.rename(new.getPath(), path(folder, f"{name}-{new.getPath().getName()}"))
    store.delete(path(aside), True)


def triggered(writer: DataStreamWriter, trigger: str | None) -> DataStreamWriter:
    """``trigger``: ``"availableNow"``, an interval such as ``"60 seconds"``,
    or None for micro-batches back to back."""
    if trigger == "availableNow":
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=trigger) if trigger else writer


def start_bar_sink(
    bars: DataFrame, path: str, checkpoint: str, trigger: str | None = None, compact_every: int = 0
) -> StreamingQuery:
    """Each micro-batch overwrites its own folder, so a batch replayed
    after a failure replaces, never duplicates, its rows.  After every
    ``compact_every`` batches (0: never) the folders are merged
    (``compact_bars``)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("emitted_at", F.current_timestamp()).write.mode("overwrite").parquet(
            batch_folder(path, checkpoint, batch_id)
        )
        if compact_every and batch_id % compact_every == compact_every - 1:
            compact_bars(batch.sparkSession, path, grace=True)

    writer = (
        bars.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    return triggered(writer, trigger).start()


def start_parquet_sink(
    df: DataFrame,
    path: str,
    checkpoint: str,
    partition_by: Sequence[str] = (),
    available_now: bool = False,
) -> StreamingQuery:
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start(path)


def start_split_outputs(
    records: DataFrame,
    parse: Callable[[DataFrame], DataFrame],
    outputs: Sequence[tuple[Callable[[DataFrame], DataFrame], Target, Sequence[str]]],
    checkpoint: str,
    trigger: str | None = None,
    flat: bool = False,
) -> StreamingQuery:
    """One parse per micro-batch, several outputs ``(rows, target,
    partition columns)``; folders hold one folder per micro-batch, or with
    ``flat`` its files side by side.

    The parsed batch is persisted (one micro-batch, bounded by the
    trigger) while the outputs are written.  A ledger beside the checkpoint
    names the outputs that a batch has finished: when the batch runs again
    after a failure, those are left alone.  A folder that was being written
    is overwritten, so its rows never double; a topic that was being
    written may get them again (at least once).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        ledger = Ledger(batch.sparkSession, f"{checkpoint}-ledger")
        open_outputs = [(i, o) for i, o in enumerate(outputs) if not ledger.holds(f"{batch_id}-{i}")]
        if not open_outputs:
            return
        parsed = parse(batch).persist()
        try:
            for i, (rows, target, partition_by) in open_outputs:
                out = rows(parsed)
                if isinstance(target, str) and flat:
                    write_flat(out, target, batch_name(checkpoint, batch_id))
                elif isinstance(target, str):
                    out.write.mode("overwrite").partitionBy(*partition_by).parquet(
                        batch_folder(target, checkpoint, batch_id)
                    )
                else:
                    kafka.write_topic(out, *target)
                ledger.add(f"{batch_id}-{i}")
        finally:
            parsed.unpersist()
        ledger.drop([f"{batch_id - 2}-{i}" for i in range(len(outputs))])

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return triggered(writer, trigger).start()


def dead_letters(rows: Callable[[DataFrame], DataFrame], target: Target):
    """An output of ``(value, reason)`` rows: a folder takes them as they
    are, a topic takes the text with the reason as key."""
    if isinstance(target, str):
        return rows, target, ()
    return lambda parsed: kafka.dead_letter_records(rows(parsed)), target, ()


def start_split_sink(
    records: DataFrame, good: str, bad: Target, checkpoint: str, trigger: str | None = None
) -> StreamingQuery:
    """DEC-3 + SNK-7: good ticks and quarantine rows."""
    return start_split_outputs(
        records,
        decode.parse,
        [
            (lambda parsed: decode.good_rows(parsed, keep=("offset",)), good, ()),
            dead_letters(lambda parsed: decode.bad_rows(parsed, keep=("offset",)), bad),
        ],
        checkpoint,
        trigger,
    )


def start_route_split_sink(
    records: DataFrame,
    routed: Target,
    rejected: Target,
    checkpoint: str,
    timespan: str = DEFAULT_TIMESPAN_KEY,
    trigger: str | None = None,
    partition_by: Sequence[str] = ("topic",),
) -> StreamingQuery:
    """FLT-4 + SNK-4 + DEC-3: routed fields and rejected snapshots."""
    return start_split_outputs(
        records,
        lambda batch: routing.parse_snapshots(batch, timespan),
        [(routing.routed, routed, partition_by), dead_letters(routing.rejected, rejected)],
        checkpoint,
        trigger,
    )


def start_message_split_sink(
    records: DataFrame,
    out: Target,
    quarantine: Target,
    checkpoint: str,
    target_type: str = TARGET_PRICE_ALERT,
    change_type: str = PERCENTAGE_CHANGE_ALERT,
    trigger: str | None = None,
) -> StreamingQuery:
    """SNK-6 + SNK-7: messages and undeliverable alert records."""

    def texts(parsed: DataFrame) -> DataFrame:
        alerts = decode.good_rows(parsed, ALERT)
        return messages.alert_messages(alerts, target_type, change_type)

    return start_split_outputs(
        records,
        lambda batch: messages.parse_records(batch, target_type, change_type),
        [
            (texts, out, ()) if isinstance(out, str) else (lambda p: messages.keyed(texts(p)), out, ()),
            dead_letters(decode.bad_rows, quarantine),
        ],
        checkpoint,
        trigger,
    )


def start_ingest_split_sink(
    pages: DataFrame,
    out: Target,
    quarantine: Target,
    checkpoint: str,
    start_date: str | None = None,
    end_date: str | None = None,
    trigger: str | None = None,
) -> StreamingQuery:
    """SRC-6 + SNK-5 + SNK-7: tick records, and the text that is no page
    together with the bars that lack a field."""

    def refused(parsed: DataFrame) -> DataFrame:
        bars = records_op.incomplete_bars(decode.good_rows(parsed, PAGE))
        return decode.bad_rows(parsed).unionByName(bars)

    return start_split_outputs(
        pages,
        lambda batch: decode.parse(batch, PAGE),
        [
            (lambda p: records_op.ingest(decode.good_rows(p, PAGE), start_date, end_date), out, ()),
            dead_letters(refused, quarantine),
        ],
        checkpoint,
        trigger,
    )


def start_debug_sink(
    df: DataFrame, kind: str = "console", name: str | None = None, trigger: str | None = None
) -> StreamingQuery:
    """SNK-2: print (``console``) or keep in driver memory (``memory``).

    Both bring every row to the driver: for inspecting small streams
    only, never for a production job.
    """
    writer = df.writeStream.format(kind).outputMode("append")
    if kind == "memory":
        writer = writer.queryName(name or "tickwarden_debug")
    return triggered(writer, trigger).start()
