"""Sensor snapshot routing: one ``(topic, value)`` record per field.

A snapshot is a JSON object whose ``timespan`` key (default
``current``) holds a field -> value object.  Every field except
``time`` and ``interval`` becomes a record routed to the topic named
after the field; the value is kept as text.  Snapshots without the
timespan key go to the quarantine.  Both outputs come from one parsed
frame; persist it to parse each snapshot once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwarden.operators.decode import CORRUPT
from tickwarden.schemas import DEFAULT_TIMESPAN_KEY, IGNORED_FIELDS


def parse_snapshots(
    snapshots: DataFrame, timespan: str = DEFAULT_TIMESPAN_KEY, value_col: str = "value"
) -> DataFrame:
    """Each snapshot's text, its timespan object as a map (values keep
    their JSON text) and whether the text is a JSON object at all."""
    schema = T.StructType(
        [
            T.StructField(timespan, T.MapType(T.StringType(), T.StringType())),
            T.StructField(CORRUPT, T.StringType()),
        ]
    )
    text = F.col(value_col).cast("string")
    rec = F.from_json(text, schema, {"columnNameOfCorruptRecord": CORRUPT})
    # a generator output, so the parse is not inlined into every field read
    parsed = snapshots.select(text.alias("_text"), F.explode(F.array(rec)).alias("_rec"))
    return parsed.select(
        "_text",
        F.col("_rec").getField(timespan).alias("_fields"),
        (F.col("_rec").isNull() | F.col("_rec").getField(CORRUPT).isNotNull()).alias("_malformed"),
    )


def routed(parsed: DataFrame, ignore: tuple[str, ...] = IGNORED_FIELDS) -> DataFrame:
    """``(topic, value)`` of every field of the parsed snapshots."""
    # explode drops snapshots whose map is null (no timespan object)
    kv = parsed.select(F.explode("_fields").alias("topic", "value"))
    return kv.where(~F.col("topic").isin(*ignore)).select(
        "topic", F.coalesce(F.col("value"), F.lit("None")).alias("value")
    )


def rejected(parsed: DataFrame) -> DataFrame:
    """``(value, reason)`` of the parsed snapshots without the timespan
    object: ``malformed`` (no JSON object) or ``missing_timespan``."""
    return parsed.where(F.col("_fields").isNull()).select(
        F.col("_text").alias("value"),
        F.when(F.col("_malformed"), F.lit("malformed")).otherwise(F.lit("missing_timespan")).alias("reason"),
    )


def route_fields(
    snapshots: DataFrame,
    timespan: str = DEFAULT_TIMESPAN_KEY,
    value_col: str = "value",
    ignore: tuple[str, ...] = IGNORED_FIELDS,
) -> DataFrame:
    """GEN-1 + FLT-3 + FLT-4: ``(topic, value)`` rows.

    Values are JSON text of the field (numbers as written, ``true``,
    ``[1.2,3]``); a JSON null becomes the text ``None`` as in the
    reference's ``str(None)``.
    """
    return routed(parse_snapshots(snapshots, timespan, value_col), ignore)


def rejected_snapshots(
    snapshots: DataFrame, timespan: str = DEFAULT_TIMESPAN_KEY, value_col: str = "value"
) -> DataFrame:
    """Snapshots without the timespan object: ``(value, reason)``."""
    return rejected(parse_snapshots(snapshots, timespan, value_col))
