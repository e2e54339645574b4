"""Record projections: bar normalisation, JSON encoding, page unnesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwarden.functions.exprs import iso_datetime, ms_to_ntz
from tickwarden.operators import decode
from tickwarden.operators.bars import date_range
from tickwarden.schemas import PAGE, RAW_BAR, TICK_FIELDS


def normalize_bars(raw: DataFrame, ticker: Column | str = "ticker") -> DataFrame:
    """PRJ-1/PRJ-2: raw ``v, vw, o, c, h, l, t, n`` bars to tick records.

    Null fields stay null (a bar without volume has no ``vwap``); only a
    bar without a time is dropped.  ``datetime`` is the ISO text of ``t``.
    Bars that lack a field are dropped where pages are unnested.
    """
    tick_col = F.col(ticker) if isinstance(ticker, str) else ticker
    return raw.where(F.col("t").isNotNull()).select(
        tick_col.cast("string").alias("ticker"),
        F.col("t").alias("timestamp"),
        iso_datetime(F.col("t")).alias("datetime"),
        F.col("o").alias("open"),
        F.col("c").alias("close"),
        F.col("h").alias("high"),
        F.col("l").alias("low"),
        F.col("v").alias("volume"),
        F.col("vw").alias("vwap"),
        F.col("n").alias("number_of_trades"),
    )


def decode_pages(records: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """``(pages, rejected)``: pages read from their text, and ``(value,
    reason)`` of text that is no page (cut off, no ticker)."""
    return decode.decode(records, PAGE, value_col)


def _number(bar: Column, field: T.StructField) -> Column:
    value = bar[field.name].try_cast("double")
    # counts and times may come as 5.0
    return value.try_cast("bigint") if isinstance(field.dataType, T.LongType) else value


def _usable(bar: Column) -> Column:
    """All eight fields present, each null or a number."""
    ok = bar.isNotNull()
    for f in RAW_BAR.fields:
        ok = ok & F.map_contains_key(bar, F.lit(f.name)) & (
            bar[f.name].isNull() | _number(bar, f).isNotNull()
        )
    return F.coalesce(ok, F.lit(False))


def explode_pages(pages: DataFrame) -> DataFrame:
    """GEN-2: one row per element of ``results``, with the page's ticker.

    A bar that lacks a field (the reference's ``KeyError`` path) or holds
    text that is no number is left out; see ``incomplete_bars``."""
    bars = pages.select("ticker", F.explode("results").alias("bar")).where(_usable(F.col("bar")))
    return bars.select("ticker", *[_number(F.col("bar"), f).alias(f.name) for f in RAW_BAR.fields])


def incomplete_bars(pages: DataFrame) -> DataFrame:
    """The bars ``explode_pages`` leaves out: ``(value, reason)``."""
    bars = pages.select("ticker", F.explode("results").alias("bar")).where(~_usable(F.col("bar")))
    text = F.to_json(F.struct("ticker", "bar"), {"ignoreNullFields": "false"})
    return bars.select(text.alias("value"), F.lit("incomplete_bar").alias("reason"))


def ingest(
    pages: DataFrame, start_date: str | None = None, end_date: str | None = None
) -> DataFrame:
    """SRC-6 to SNK-5: decoded pages to tick-topic records ``(key, value)``
    of the bars whose UTC date is in the range (no dates: every bar)."""
    ticks = normalize_bars(explode_pages(pages))
    if start_date or end_date:
        at = ticks.withColumn("_at", ms_to_ntz(F.col("timestamp")))
        ticks = date_range(at, "_at", start_date, end_date).drop("_at")
    return tick_records(ticks)


def record_json(df: DataFrame, fields: list[str] | None = None) -> Column:
    """PRJ-3: the record as JSON text, fixed key order, nulls kept."""
    cols = fields or [c for c in TICK_FIELDS if c in df.columns]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def tick_records(ticks: DataFrame) -> DataFrame:
    """SNK-5 shape: ``key`` = ticker (so one ticker stays in one Kafka
    partition, in order), ``value`` = the JSON text."""
    return ticks.select(F.col("ticker").alias("key"), record_json(ticks).alias("value"))
