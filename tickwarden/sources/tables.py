"""Parquet tables and the tick views derived from them.

The fixture tables are read with Spark's parquet scan (column pruning
and filter push-down happen there).  ``events`` becomes a tick stream:
one trade per event with ``ticker = user_id``, ``close = value`` and the
traded size ``k`` from ``props``; ``orders`` becomes a second keyed
series (customer, order date, total price).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwarden.functions.exprs import iso_datetime, ntz_to_ms


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_ticks(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``events`` as tick records plus ``seq`` (event id) and ``size``.

    With ``spread`` over all tasks: the table lies in event order, so a range
    of it would otherwise be worked on by the few tasks that read it."""
    ev = read_table(spark, sf_dir, "events")
    if spread:
        ev = ev.repartition(F.xxhash64("event_id"))
    size = F.get_json_object("props", "$.k").cast("bigint")
    # epoch ms in its own projection: referenced twice below, Catalyst
    # keeps it computed once instead of inlining it
    ev = ev.select("*", ntz_to_ms(F.col("ts")).alias("_ms"), size.alias("_size"))
    size = F.col("_size")
    return ev.select(
        F.col("user_id").cast("string").alias("ticker"),
        F.col("_ms").alias("timestamp"),
        iso_datetime(F.col("_ms")).alias("datetime"),
        F.col("value").alias("open"),
        F.col("value").alias("close"),
        F.col("value").alias("high"),
        F.col("value").alias("low"),
        size.cast("double").alias("volume"),
        F.col("value").alias("vwap"),
        F.lit(1).cast("bigint").alias("number_of_trades"),
        F.col("event_id").alias("seq"),
        size.alias("size"),
        F.col("event_type"),
    )


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a keyed price series: customer, order date, total price.

    Order dates tie within a customer, so ``seq = o_orderkey`` breaks ties.
    """
    o = read_table(spark, sf_dir, "orders")
    o = o.select("*", ntz_to_ms(F.col("o_orderdate")).alias("_ms"))
    return o.select(
        F.col("o_custkey").cast("string").alias("ticker"),
        F.col("_ms").alias("timestamp"),
        iso_datetime(F.col("_ms")).alias("datetime"),
        F.col("o_totalprice").alias("close"),
        F.col("o_orderkey").alias("seq"),
    )
