"""AGG-3: bars that are emitted once, when the watermark closes them.

``jobs.bar_stream`` re-emits a bar with every change.  Here a bar is held
in state until the watermark passes its end; an event-time timer then
emits it, once, and drops its state.  Rows that arrive after their bar
has closed are no longer lost: they come out as rows of their own kind.

Rows come by *shard* (a hash of the ticker) and bucket: a Python call, a
state value and a timer for each of these, not for each ticker's bar, whose
round trips to the state store cost far more than its few rows.  The state
value holds the shard's open bars of one bucket (order keys of the first and
last row, open, close, high, low, volume, trades, the weighted sum as
decimal text) as an Arrow table, rewritten when rows come for any of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal, localcontext

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickwarden.functions.exprs import MS_PER_DAY, MS_PER_HOUR, MS_PER_MINUTE, MS_PER_SECOND, MS_PER_WEEK
from tickwarden.functions.exprs import WEEK_OFFSET_MS, iso_datetime, ms_to_instant
from tickwarden.operators.bars import BAR_FIELDS, NOTIONAL, validate_bar_params, weighted
from tickwarden.session import ship_package, use_rocksdb_state

WIDTHS = {"second": MS_PER_SECOND, "minute": MS_PER_MINUTE, "hour": MS_PER_HOUR, "day": MS_PER_DAY, "week": MS_PER_WEEK}
CLOSED, LATE = "closed", "late"
# tickers share calls and state by the hash of their name; a checkpoint is bound to this number
SHARDS = 128
STATE = "bars binary"
ENTRY = pa.schema([
    ("ticker", pa.string()), ("first_ms", pa.int64()), ("first_at", pa.int64()), ("open", pa.float64()),
    ("last_ms", pa.int64()), ("last_at", pa.int64()), ("close", pa.float64()), ("high", pa.float64()), ("low", pa.float64()),
    ("volume", pa.float64()), ("trades", pa.int64()), ("notional", pa.string()),
])
OUTPUT = ("kind string, ticker string, timestamp bigint, open double, close double, high double, low double, "
          "volume double, number_of_trades bigint, notional string, arrived bigint")
_EXACT = Context(prec=60, rounding=ROUND_HALF_UP)
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]


def _sums(weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Exact sums of decimals from each start to the next; null if one is."""
    null = np.array([w is None for w in weights], dtype=bool)
    with localcontext(_EXACT):
        sums = np.add.reduceat(np.where(null, Decimal(0), weights), starts)
    return np.where(np.logical_or.reduceat(null, starts), None, sums)


def _starts(code: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))


def row_bars(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of one bucket as bars (``ENTRY``), one per ticker."""
    code, tickers = pd.factorize(rows["ticker"].to_numpy(dtype=object))
    ms, at = rows["timestamp"].to_numpy(np.int64), rows["offset"].to_numpy(np.int64)
    order = np.lexsort((at, ms, code))
    first = _starts(code[order])
    last = np.concatenate((first[1:], [len(order)])) - 1
    ms, at = ms[order], at[order]
    closes, volumes = rows["close"].to_numpy(float)[order], rows["volume"].to_numpy(float)[order]
    return pd.DataFrame({
        "ticker": tickers, "first_ms": ms[first], "first_at": at[first], "open": closes[first],
        "last_ms": ms[last], "last_at": at[last], "close": closes[last], "high": np.maximum.reduceat(closes, first),
        "low": np.minimum.reduceat(closes, first), "volume": np.add.reduceat(volumes, first), "trades": last - first + 1,
        "notional": _sums(rows["weight"].to_numpy(dtype=object)[order], first),
    })


def merged_bars(held: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """Bars of earlier and of new rows as one per ticker; of equal order keys
    the earlier one opens and the later one closes."""
    both = pd.concat([held, new], ignore_index=True)
    code, tickers = pd.factorize(both["ticker"].to_numpy(dtype=object))
    opening = np.lexsort((both["first_at"], both["first_ms"], code))
    closing = np.lexsort((both["last_at"], both["last_ms"], code))
    first = _starts(code[opening])
    ends = np.concatenate((first[1:], [len(code)])) - 1
    opens, closes = both.iloc[opening[first]], both.iloc[closing[ends]]
    own = both.iloc[opening]
    return pd.DataFrame({
        "ticker": tickers,
        **{c: opens[c].to_numpy() for c in ("first_ms", "first_at", "open")},
        **{c: closes[c].to_numpy() for c in ("last_ms", "last_at", "close")},
        "high": np.maximum.reduceat(own["high"].to_numpy(), first), "low": np.minimum.reduceat(own["low"].to_numpy(), first),
        "volume": np.add.reduceat(own["volume"].to_numpy(), first), "trades": np.add.reduceat(own["trades"].to_numpy(), first),
        "notional": _sums(own["notional"].to_numpy(dtype=object), first),
    })


def packed(bars: pd.DataFrame) -> bytes:
    text = bars.assign(notional=[None if n is None else format(n, "f") for n in bars["notional"]])
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(text, schema=ENTRY, preserve_index=False)
    with pa.ipc.new_stream(sink, ENTRY) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(state: bytes) -> pd.DataFrame:
    bars = pa.ipc.open_stream(pa.py_buffer(bytes(state))).read_all().to_pandas()
    return bars.assign(notional=pd.Series([None if n is None else Decimal(n) for n in bars["notional"]], dtype=object))


class ClosingBars(StatefulProcessor):
    """Rows of a shard and bucket into open bars; closed bars and late rows out."""

    def __init__(self, width: int) -> None:
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        end = key[1] + self.width
        parts = list(rows)
        if end <= timerValues.getCurrentWatermarkInMs():
            for part in parts:
                yield pd.DataFrame({
                    "kind": LATE, "ticker": part["ticker"], "timestamp": part["timestamp"], "open": part["close"],
                    "close": part["close"], "high": part["close"], "low": part["close"], "volume": part["volume"],
                    "number_of_trades": 1, "notional": None, "arrived": part["offset"],
                }, columns=_NAMES)
            return
        bars = row_bars(pd.concat(parts, ignore_index=True))
        held = self.open.get()
        if held is None:
            self.handle.registerTimer(end)
        else:
            bars = merged_bars(unpacked(held[0]), bars)
        self.open.update((packed(bars),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.open.get()
        if held is None:
            return
        self.open.clear()
        bars = pa.ipc.open_stream(pa.py_buffer(bytes(held[0]))).read_all().to_pandas()
        yield bars.rename(columns={"trades": "number_of_trades"}).assign(
            kind=CLOSED, timestamp=key[1], arrived=pd.array([None] * len(bars), dtype="Int64")
        )[_NAMES]

    def close(self) -> None:
        pass


def closing_bars(ticks: DataFrame, multiplier: int = 5, timespan: str = "minute", delay: str = "15 seconds") -> DataFrame:
    """Tagged rows (``kind``): closed bars, and rows too late for theirs."""
    validate_bar_params(multiplier, timespan)
    if timespan not in WIDTHS:
        raise ValueError("closing bars need a fixed span; roll day bars up to calendar bars")
    spark = ticks.sparkSession
    use_rocksdb_state(spark)
    ship_package(spark)
    offset, width = WEEK_OFFSET_MS if timespan == "week" else 0, WIDTHS[timespan] * multiplier
    rows = ticks.where("ticker is not null and timestamp is not null and close is not null and volume is not null")
    timed = rows.withColumn("event_time", ms_to_instant(F.col("timestamp"))).withWatermark("event_time", delay)
    at, price, volume = F.col("timestamp"), F.col("close"), F.col("volume")
    # without the time column the engine passes late rows on instead of dropping them
    keyed = timed.select(
        F.pmod(F.xxhash64("ticker"), F.lit(SHARDS)).cast("int").alias("shard"),
        (at - F.pmod(at - F.lit(offset), F.lit(width))).alias("bucket"),
        "ticker", "timestamp", "close", "volume", "offset",
        F.when(volume == 0, F.lit(0).cast(NOTIONAL)).otherwise(weighted(price, volume)).alias("weight"),
    )
    return keyed.groupBy("shard", "bucket").transformWithStateInPandas(
        statefulProcessor=ClosingBars(width), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime",
    )


def closed_bars(tagged: DataFrame) -> DataFrame:
    """The closed bars in the shape of ``bars.bars``."""
    notional = F.col("notional").cast(NOTIONAL)
    return tagged.where(F.col("kind") == CLOSED).select(
        "ticker", "timestamp", iso_datetime(F.col("timestamp")).alias("datetime"), "open", "close", "high", "low", "volume",
        F.try_divide(notional.cast("double"), F.col("volume")).alias("vwap"), "number_of_trades", notional.alias("notional"),
    ).select(*BAR_FIELDS)


def late_rows(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.col("kind") == LATE).select(
        "ticker", "timestamp", "close", "volume", F.col("arrived").alias("offset")
    )
