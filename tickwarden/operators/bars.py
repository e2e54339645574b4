"""OHLCV bars: build from ticks, roll up to coarser bars, parameter checks.

One aggregation serves both: a trade tick is a one-trade bar (open =
close = high = low = vwap = price), so ``bars(rows, m, span)`` works on
ticks and on bars alike.  Per ticker and bucket of ``m x span``: open of
the first row, close of the last (by ``order_by``), max high, min low,
summed volume and trade count, volume-weighted average price.

The weighted sum (``notional``) is a decimal: prices count to
``PRICE_SCALE`` and volumes to ``VOLUME_SCALE`` decimals (rounded half
up beyond), so sums are exact and independent of the order rows are
added in, and rolling day bars up to weeks gives exactly the week bars
built from ticks.  Prices below 10^19, volumes below 10^18 and weighted
sums below 10^28 have room.  Volume 0 weighs nothing whatever the price.
A bar holding a row whose price or volume is null, NaN, infinite or out of
that range has a null ``notional`` and ``vwap`` (and so has a roll-up of
it); its other
columns are built from the values as they are (NaN counts as the
largest price, as in Spark's ordering).

Grouping is a hash aggregation with partial (map-side) aggregation, so
a hot ticker is combined per input partition before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwarden.functions.exprs import bucket_start_ms, iso_datetime, order_key
from tickwarden.schemas import (
    DATE_FORMAT_ERROR,
    MULTIPLIER_ERROR,
    TICK_FIELDS,
    TIMESPAN_ERROR,
    TIMESPANS,
)

BAR_FIELDS = TICK_FIELDS + ["notional"]
# decimals kept of a price and of a volume in the weighted sum
PRICE_SCALE, VOLUME_SCALE = 6, 4
NOTIONAL = f"decimal(38,{PRICE_SCALE + VOLUME_SCALE})"


def validate_bar_params(
    multiplier: int, timespan: str, start_date: str | None = None, end_date: str | None = None
) -> None:
    """FLT-8: the reference's parameter checks, with its messages."""
    if multiplier < 1:
        raise ValueError(MULTIPLIER_ERROR)
    if timespan not in TIMESPANS:
        raise ValueError(TIMESPAN_ERROR)
    try:
        for d in (start_date, end_date):
            if d is not None:
                datetime.strptime(d, "%Y-%m-%d")
    except ValueError:
        raise ValueError(DATE_FORMAT_ERROR) from None


def date_range(
    df: DataFrame, ts_col: str, start_date: str | None = None, end_date: str | None = None
) -> DataFrame:
    """FLT-7: rows whose UTC date is in ``[start_date, end_date]``.

    Unset or empty bounds default to two years back and today (computed
    by Spark with ``add_months``, which handles 29 February).
    """
    start_date = start_date or None
    end_date = end_date or None
    validate_bar_params(1, "day", start_date, end_date)
    start = F.lit(start_date).cast("date") if start_date else F.add_months(F.current_date(), -24)
    end = F.lit(end_date).cast("date") if end_date else F.current_date()
    day = _to_date(F.col(ts_col))
    return df.where((day >= start) & (day <= end))


def _to_date(col: Column) -> Column:
    # TIMESTAMP_NTZ to DATE is time-zone free
    return col.cast("date")


def weighted(price: Column, volume: Column) -> Column:
    """The exact product of a price and a volume (of their kept decimals), as
    ``NOTIONAL``; null from 10^28 up.

    Up to 18 digits each, one decimal product has room.  Larger ones are
    split into a whole part and a fraction; each of the four products is
    exact, and so is their sum.
    """
    narrow = price.try_cast(f"decimal(18,{PRICE_SCALE})") * volume.try_cast(f"decimal(18,{VOLUME_SCALE})")
    p, v = price.try_cast(f"decimal(25,{PRICE_SCALE})"), volume.try_cast(f"decimal(22,{VOLUME_SCALE})")
    p_whole, v_whole = F.floor(p).try_cast("decimal(19,0)"), F.floor(v).try_cast("decimal(18,0)")
    p_rest = (p - p_whole).try_cast(f"decimal({PRICE_SCALE + 1},{PRICE_SCALE})")
    v_rest = (v - v_whole).try_cast(f"decimal({VOLUME_SCALE + 1},{VOLUME_SCALE})")
    wide = None
    for a, b in ((p_whole, v_whole), (p_whole, v_rest), (p_rest, v_whole), (p_rest, v_rest)):
        part = (a * b).try_cast(NOTIONAL)
        wide = part if wide is None else F.try_add(wide, part).try_cast(NOTIONAL)
    return F.coalesce(narrow.try_cast(NOTIONAL), wide)


def bar_inputs(rows: DataFrame, order_by: Sequence[str] | None = None, key: str = "ticker") -> DataFrame:
    """Per-row inputs of the bar aggregates (ticks or bars alike)."""
    order = list(order_by) if order_by else (
        ["timestamp", "seq"] if "seq" in rows.columns else ["timestamp"]
    )
    cols = set(rows.columns)
    price = F.col("close")
    opn = F.col("open") if "open" in cols else price
    high = F.col("high") if "high" in cols else price
    low = F.col("low") if "low" in cols else price
    vwap = F.col("vwap") if "vwap" in cols else price
    volume = F.col("volume") if "volume" in cols else F.col("size").cast("double")
    trades = F.col("number_of_trades") if "number_of_trades" in cols else F.lit(1).cast("bigint")
    notional = (
        F.col("notional")
        if "notional" in cols
        else F.when(volume == 0, F.lit(0).cast(NOTIONAL)).otherwise(weighted(vwap, volume))
    ).cast(NOTIONAL)
    extra = [c for c in ("event_time",) if c in cols]
    return rows.select(
        F.col(key).alias("ticker"),
        F.col("timestamp"),
        *extra,
        order_key(rows, order).alias("_ord"),
        opn.alias("_open"),
        price.alias("_close"),
        high.alias("_high"),
        low.alias("_low"),
        volume.alias("_volume"),
        trades.alias("_trades"),
        notional.alias("_notional"),
    )


def bar_aggregates() -> list[Column]:
    return [
        F.min_by("_open", "_ord").alias("open"),
        F.max_by("_close", "_ord").alias("close"),
        F.max("_high").alias("high"),
        F.min("_low").alias("low"),
        F.sum("_volume").alias("volume"),
        F.sum("_trades").alias("number_of_trades"),
        F.try_sum("_notional").alias("notional"),
        F.max(F.col("_notional").isNull()).alias("_unweighted"),
    ]


def bar_output(agg: DataFrame) -> DataFrame:
    """Aggregated ``(ticker, bucket, ...)`` rows to the bar record shape."""
    notional = F.when(~F.col("_unweighted"), F.col("notional"))
    return agg.select(
        "ticker",
        F.col("bucket").alias("timestamp"),
        iso_datetime(F.col("bucket")).alias("datetime"),
        "open",
        "close",
        "high",
        "low",
        "volume",
        F.try_divide(notional.cast("double"), F.col("volume")).alias("vwap"),
        "number_of_trades",
        notional.alias("notional"),
    )


def bars(
    rows: DataFrame,
    multiplier: int = 1,
    timespan: str = "day",
    *,
    key: str = "ticker",
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """AGG-1 / AGG-2: bars of ``multiplier x timespan`` per key."""
    validate_bar_params(multiplier, timespan)
    inputs = bar_inputs(rows, order_by, key).withColumn(
        "bucket", bucket_start_ms(F.col("timestamp"), multiplier, timespan)
    )
    return bar_output(inputs.groupBy("ticker", "bucket").agg(*bar_aggregates()))


def as_raw_bars(bar_rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Bars in the upstream wire shape ``ticker, v, vw, o, c, h, l, t, n``."""
    return bar_rows.select(
        "ticker",
        *keep,
        F.col("volume").alias("v"),
        F.col("vwap").alias("vw"),
        F.col("open").alias("o"),
        F.col("close").alias("c"),
        F.col("high").alias("h"),
        F.col("low").alias("l"),
        F.col("timestamp").alias("t"),
        F.col("number_of_trades").alias("n"),
    )
