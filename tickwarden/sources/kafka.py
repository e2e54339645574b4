"""Kafka source and sinks (Structured Streaming's built-in connector).

The connector jar is not part of every Spark image; nothing else in the
package needs it, and the file twins in ``sources.files`` carry the same
``(value, offset)`` contract.  Offsets live in the query checkpoint, so a
restarted query resumes where its last committed micro-batch ended
(the reference's "committed offset, else earliest").
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_MAX_OFFSETS_PER_TRIGGER = 1_000_000


def source_options(
    bootstrap: str,
    topic: str,
    starting_offsets: str = "earliest",
    max_offsets_per_trigger: int | None = DEFAULT_MAX_OFFSETS_PER_TRIGGER,
    extra: dict[str, str] | None = None,
) -> dict[str, str]:
    """Reader options: read committed data only, start at the earliest
    offset when the checkpoint has none."""
    opts = {
        "kafka.bootstrap.servers": bootstrap,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
        "kafka.isolation.level": "read_committed",
    }
    if max_offsets_per_trigger:
        # bounds one micro-batch, and so what one key brings to the processor
        opts["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    opts.update(extra or {})
    return opts


def read_topic_stream(spark: SparkSession, bootstrap: str, topic: str, **kwargs) -> DataFrame:
    """SRC-1..5: ``(value STRING, offset, partition, record_time, topic, key)`` rows."""
    raw = spark.readStream.format("kafka").options(**source_options(bootstrap, topic, **kwargs)).load()
    return raw.select(
        F.col("value").cast("string").alias("value"),
        "offset",
        "partition",
        F.col("timestamp").alias("record_time"),
        "topic",
        F.col("key").cast("string").alias("key"),
    )


def sink_options(bootstrap: str, checkpoint: str, topic: str | None = None) -> dict[str, str]:
    """Writer options; without ``topic`` each row's ``topic`` column
    routes it (SNK-4's one topic per field)."""
    opts = {"kafka.bootstrap.servers": bootstrap, "checkpointLocation": checkpoint, "kafka.acks": "all"}
    if topic:
        opts["topic"] = topic
    return opts


def write_topic(rows: DataFrame, bootstrap: str, topic: str | None) -> None:
    """One micro-batch's ``(key, value)`` rows to a topic, at least once;
    without ``topic`` each row's ``topic`` column routes it."""
    rows.write.format("kafka").options(**batch_sink_options(bootstrap, topic)).save()


def batch_sink_options(bootstrap: str, topic: str | None) -> dict[str, str]:
    opts = {"kafka.bootstrap.servers": bootstrap, "kafka.acks": "all"}
    return {**opts, "topic": topic} if topic else opts


def dead_letter_records(rejected: DataFrame) -> DataFrame:
    """SNK-7: ``(value, reason)`` rows as ``(key, value)`` of a dead-letter
    topic: the record's own text, its reason as key."""
    return rejected.select(F.col("reason").alias("key"), "value")
