"""Send times of messages on a channel that takes one per interval (SNK-6).

The reference waits 1.2 s after a message before it sends the next.  A
message that arrives at t is sent at ``max(t, previous send + spacing)``.
With messages numbered 1, 2, ... that is ``spacing * i + max over j <= i of
(t_j - spacing * j)``: a running maximum, which has no need to go message
by message.

All messages may belong to one channel.  Rows are therefore sorted by range
over (channel, arrival); a task numbers its own rows and takes their running
maximum, and one row per (channel, task), its number of messages and its
maximum, carries over to the tasks behind it.  The sorted rows are written
to the shared folder, so the tasks' shares are the same for both steps.

Order: arrival time, then the other columns; rows equal in all of them are
interchangeable.  A message without a time has no place on the channel: its
``send_ms`` is null and it delays no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwarden.functions.exprs import ntz_to_ms
from tickwarden.operators.points import parse_point_time
from tickwarden.session import materialized

SPACING_MS = 1_200


def alert_time(timestamp: Column | str = "timestamp", datetime: Column | str = "datetime") -> Column:
    """An alert's time in epoch ms: its timestamp, else its ISO text."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return F.coalesce(as_column(timestamp), ntz_to_ms(parse_point_time(as_column(datetime))))


def send_schedule(
    messages: DataFrame, at: str = "at", channel: str | None = None, spacing_ms: int = SPACING_MS
) -> DataFrame:
    """``messages`` with ``send_ms``, when each goes out."""
    if spacing_ms < 0:
        raise ValueError("spacing_ms must not be negative")
    names = messages.columns
    rows = messages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    group = F.col(f"_row.`{channel}`") if channel else F.lit("")
    order = [F.col(f"_row.`{at}`"), *[F.col(f"_row.`{c}`") for c in names if c not in (at, channel)]]
    keyed = rows.select("_row", group.alias("_channel"), F.col(f"_row.`{at}`").alias("_at"))
    untimed = keyed.where(F.col("_at").isNull()).select("_row.*", F.lit(None).cast("bigint").alias("send_ms"))
    keyed = keyed.where(F.col("_at").isNotNull())
    placed = materialized(
        keyed.repartitionByRange("_channel", *order).withColumn("_part", F.spark_partition_id()), "schedule"
    )
    own = Window.partitionBy("_channel", "_part").orderBy(*order)
    step = F.lit(spacing_ms)
    numbered = placed.withColumn("_i", F.row_number().over(own)).withColumn("_slack", F.col("_at") - step * F.col("_i"))
    inside = numbered.withColumn("_best", F.max("_slack").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy("_channel", "_part").agg(F.count("*").alias("_n"), F.max("_slack").alias("_most"))
    earlier = Window.partitionBy("_channel").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counted = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    carry = counted.select(
        F.col("_channel").alias("_c"), F.col("_part").alias("_p"), "_before",
        F.max(F.col("_most") - step * F.col("_before")).over(earlier).alias("_carried"),
    )
    joined = inside.join(carry, F.col("_channel").eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p")))
    best = F.greatest(F.col("_best") - step * F.col("_before"), "_carried")
    send = best + step * (F.col("_before") + F.col("_i"))
    return joined.select("_row.*", send.cast("bigint").alias("send_ms")).unionByName(untimed)
