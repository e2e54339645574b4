"""Batch forms of the two keyed stateful detectors and the alert union.

* ``target_price_alerts`` (one-shot latch): the first row of a ticker
  whose close reaches the target emits one alert, never again.
* ``price_change_alerts`` (previous-value detector): every usable close
  is compared with the previous usable close of its ticker; an alert is
  emitted when ``abs(round(pct, 2)) >= threshold``.  After a close of 0
  the division fails in the reference and its state never moves again,
  so that ticker never alerts again ("zero latch").

Order is explicit (``order_by``), never arrival order of a shuffle.

Rows of a key follow one total order: the order columns, then close,
time and ISO text, nulls first; rows equal in all of them are
interchangeable.

Skew: a single ticker may hold a large share of all rows.  Tickers up
to ``task_rows`` rows are windowed whole.  Beyond that a ticker is cut at
quantiles of the total order into chunks of about ``task_rows`` rows, and
rows are windowed by ``(ticker, chunk)``: one shuffle and one sort of the
input, and as many tasks for a hot ticker as it has chunks, however
unevenly its rows lie in time and whatever the order columns' types.  The
value that crosses a chunk border (the last close of the previous chunk,
and whether a zero was seen before) comes from one summary row per chunk,
a grouped aggregation with map-side combine; it is joined to the chunks'
first rows and to the rows that already pass the threshold only.  Where
the borders lie never changes the alerts.  The target latch is a grouped
``min_by`` with partial (map-side) aggregation, skew-safe as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwarden.functions.exprs import order_key, pct_change, round2
from tickwarden.schemas import (
    ALERT,
    CHANGE_ALERT_FIELDS,
    PERCENTAGE_CHANGE_ALERT,
    TARGET_ALERT_FIELDS,
    TARGET_PRICE_ALERT,
)
from tickwarden.session import materialized

# rows of one ticker that one task may window whole
DEFAULT_TASK_ROWS = 1_000_000
# rows looked at per chunk to place the borders
BORDER_ROWS = 64


def _order(df: DataFrame, order_by: Sequence[str] | None) -> list[str]:
    if order_by:
        return list(order_by)
    return ["timestamp", "seq"] if "seq" in df.columns else ["timestamp"]


def target_price_alerts(
    ticks: DataFrame,
    target: float,
    *,
    key: str = "ticker",
    order_by: Sequence[str] | None = None,
    alert_type: str = TARGET_PRICE_ALERT,
) -> DataFrame:
    """ST-1: first row per key with ``close >= target`` (inclusive).

    NaN never qualifies (Python comparisons with NaN are false, Spark
    sorts NaN above everything), null closes are skipped.
    """
    order = _order(ticks, order_by)
    close = F.col("close")
    hits = ticks.where(close.isNotNull() & ~F.isnan(close) & (close >= F.lit(float(target))))
    first = hits.groupBy(key).agg(
        F.min_by(F.struct("datetime", "close"), order_key(hits, order)).alias("hit")
    )
    return first.select(
        F.col(key).alias("ticker"),
        F.col("hit.datetime").alias("datetime"),
        F.lit(float(target)).alias("target_price"),
        F.col("hit.close").alias("current_price"),
        F.lit(alert_type).alias("alert_type"),
    ).select(*TARGET_ALERT_FIELDS)


def price_change_alerts(
    ticks: DataFrame,
    threshold: float,
    *,
    key: str = "ticker",
    order_by: Sequence[str] | None = None,
    chunk_ms: int | None = None,
    task_rows: int = DEFAULT_TASK_ROWS,
    zero_policy: str = "latch",
    alert_type: str = PERCENTAGE_CHANGE_ALERT,
) -> DataFrame:
    """ST-2: compare each usable close with the previous one of its key.

    ``zero_policy="latch"`` (default, as the reference): after the first
    close of 0 a key never alerts again.  ``"skip"``: closes of 0 are not
    usable (dropped like nulls).

    ``chunk_ms`` cuts chunks of a fixed width of an integral leading order
    column instead of quantiles.
    """
    if zero_policy not in ("latch", "skip"):
        raise ValueError("zero_policy must be 'latch' or 'skip'")
    if chunk_ms is not None and chunk_ms <= 0:
        raise ValueError("chunk_ms must be positive")
    order = _order(ticks, order_by)
    close = F.col("close")
    usable = ticks.where(close.isNotNull())
    if zero_policy == "skip":
        usable = usable.where(close != 0)
    rows = detector_rows(usable, key, order)
    if chunk_ms is not None and _integral(usable, order[0]):
        rows = fixed_chunks(rows, order[0], chunk_ms)
    elif chunk_ms is None:
        rows = even_chunks(rows, order, task_rows)
    if "_chunk" not in rows.columns:  # every key in one window
        scored = window_stage(rows, ["_k"], order).select(
            "*", F.col("_prev_in").alias("_prev"), F.col("_zero_in").alias("_stuck")
        )
    else:
        carry = chunk_carry(rows, order)
        kept = window_stage(rows, ["_k", "_chunk"], order)
        passes = _passes(F.col("close"), F.col("_prev_in"), threshold) & ~F.col("_zero_in")
        carry = carry.withColumnRenamed("_k", "_carry_k").withColumnRenamed("_chunk", "_carry_chunk")
        # null is a key like any other, as in the windows
        same = F.col("_k").eqNullSafe(F.col("_carry_k")) & (F.col("_chunk") == F.col("_carry_chunk"))
        scored = (
            kept.where(F.col("_first") | passes)
            .join(carry, same)
            .select(
                "*",
                F.when(F.col("_first"), F.col("_prev_chunk")).otherwise(F.col("_prev_in")).alias("_prev"),
                (F.col("_zero_before") | F.col("_zero_in")).alias("_stuck"),
            )
        )
    return scored.where(_passes(F.col("close"), F.col("_prev"), threshold) & ~F.col("_stuck")).select(
        F.col("_k").alias("ticker"),
        "datetime",
        "timestamp",
        F.col("_prev").alias("previous_price"),
        F.col("close").alias("current_price"),
        round2(pct_change(F.col("close"), F.col("_prev"))).alias("price_change_percentage"),
        F.lit(alert_type).alias("alert_type"),
    ).select(*CHANGE_ALERT_FIELDS)


def _passes(close: Column, prev: Column, threshold: float) -> Column:
    pct = round2(pct_change(close, prev))
    ok = prev.isNotNull() & pct.isNotNull() & ~F.isnan(pct) & (F.abs(pct) >= F.lit(float(threshold)))
    return F.coalesce(ok, F.lit(False))


def _integral(df: DataFrame, col: str) -> bool:
    return dict(df.dtypes)[col] in ("tinyint", "smallint", "int", "bigint")


def total_order(order: Sequence[str]) -> list[str]:
    """The order columns, then what else tells two rows apart."""
    return list(dict.fromkeys([*order, "close", "timestamp", "datetime"]))


def detector_rows(usable: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The detector's columns: the key as ``_k``, order columns, close."""
    return usable.select(
        F.col(key).alias("_k"),
        *[F.col(c) for c in total_order(order)],
        (F.col("close") == 0).alias("_zero"),
    )


def fixed_chunks(rows: DataFrame, leading: str, chunk_ms: int) -> DataFrame:
    """Chunks of a fixed width of the leading order column; rows without a
    leading value come first, in a chunk of their own."""
    chunk = F.floor(F.col(leading) / F.lit(chunk_ms))
    return rows.withColumn("_chunk", F.coalesce(chunk, F.lit(-(1 << 62)).cast("bigint")))


def even_chunks(rows: DataFrame, order: Sequence[str], task_rows: int) -> DataFrame:
    """Chunks of about ``task_rows`` rows of every key that has more; the
    rows as they are when no key has.

    A border is a quantile of the key's rows in the total order, taken from
    the rows that a hash of their content picks (about ``BORDER_ROWS`` a
    chunk; every row stays, the picked ones only place borders).  The
    borders, one row per hot key, are written to the shared folder, so that
    every reader cuts at the same places.  A row finds its chunk by binary
    search.
    """
    per_key = rows.groupBy("_k").agg(F.count("*").alias("_n"))
    most = per_key.agg(F.max("_n")).first()[0] or 0
    if most <= task_rows:
        return rows
    total = total_order(order)
    hot = per_key.where(F.col("_n") > task_rows).select(
        F.col("_k").alias("_hot"), F.ceil(F.col("_n") / F.lit(float(task_rows))).alias("_chunks")
    )
    picked = rows.where(F.pmod(F.xxhash64(*total), F.lit(max(1, task_rows // BORDER_ROWS))) == 0)
    by_key = Window.partitionBy("_k")
    place = F.row_number().over(by_key.orderBy(*total)) * F.col("_chunks") / F.count("*").over(by_key)
    # the first row of every further share of the key's picked rows
    ranked = picked.join(hot, F.col("_k").eqNullSafe(F.col("_hot"))).select(
        "_hot", F.struct(*total).alias("_at"), F.floor(place).alias("_share")
    )
    borders = (
        ranked.where("_share > 0").groupBy("_hot", "_share").agg(F.min("_at").alias("_at"))
        .groupBy("_hot").agg(F.array_sort(F.collect_list("_at")).alias("_borders"))
    )
    kept = materialized(borders, "chunk-borders")
    steps = (-(-most // task_rows)).bit_length() + 1
    chunk = F.coalesce(borders_passed(F.col("_borders"), F.struct(*total), steps), F.lit(0))
    return (
        rows.join(kept, F.col("_k").eqNullSafe(F.col("_hot")), "left")
        .withColumn("_chunk", chunk.cast("bigint")).drop("_hot", "_borders")
    )


def borders_passed(borders: Column, row: Column, steps: int) -> Column:
    """How many of the sorted borders are not after the row (null borders:
    null), by ``steps`` halvings."""

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / F.lit(2)).cast("int")
        passed = F.get(borders, middle) <= row
        open_ = acc["lo"] < acc["hi"]
        return F.struct(
            F.when(open_ & passed, middle + 1).otherwise(acc["lo"]).alias("lo"),
            F.when(open_ & ~passed, middle).otherwise(acc["hi"]).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("lo"), F.size(borders).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda acc: acc["lo"])
    return F.when(borders.isNotNull(), found)


def window_stage(rows: DataFrame, parts: list[str], order: Sequence[str]) -> DataFrame:
    """The one pass over all rows: previous close in the window, whether a
    zero came before, and the first row's mark."""
    w = Window.partitionBy(*parts).orderBy(*total_order(order))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "*",
        F.lag("close").over(w).alias("_prev_in"),
        F.coalesce(F.max("_zero").over(before), F.lit(False)).alias("_zero_in"),
        F.lag(F.lit(1)).over(w).isNull().alias("_first"),
    )


def chunk_carry(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per ``(key, chunk)``: the last close of the previous non-empty chunk
    and whether a zero came before the chunk.  One row per chunk leaves
    the map-side combine."""
    ends = rows.groupBy("_k", "_chunk").agg(
        F.max(F.struct(*total_order(order))).alias("_last"), F.max("_zero").alias("_any_zero")
    )
    w = Window.partitionBy("_k").orderBy("_chunk")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(
        "_k",
        "_chunk",
        F.lag("_last.close").over(w).alias("_prev_chunk"),
        F.coalesce(F.max("_any_zero").over(before), F.lit(False)).alias("_zero_before"),
    )


def detector_state(
    ticks: DataFrame,
    target: float | None,
    *,
    key: str = "ticker",
    order_by: Sequence[str] | None = None,
    zero_policy: str = "latch",
) -> DataFrame:
    """ST-4: ``(ticker, latched, last_close)`` after a history, as the stream
    would hold it: whether the target was reached, and the last usable close
    (0 for good after a close of 0).  One grouped aggregation; keys without a
    usable close have no state."""
    order = _order(ticks, order_by)
    close = F.col("close")
    usable = ticks.where(close.isNotNull())
    if zero_policy == "skip":
        usable = usable.where(close != 0)
    reached = F.lit(False) if target is None else ~F.isnan(close) & (close >= F.lit(float(target)))
    rows = detector_rows(usable, key, order).withColumn("_hit", reached)
    ends = rows.groupBy("_k").agg(
        F.max("_hit").alias("latched"), F.max("_zero").alias("_any_zero"), F.max(F.struct(*total_order(order))).alias("_last")
    )
    return ends.select(
        F.col("_k").alias("ticker"), "latched",
        F.when(F.col("_any_zero"), F.lit(0.0)).otherwise(F.col("_last.close")).alias("last_close"),
    )


def alerts_union(*alerts: DataFrame) -> DataFrame:
    """SET-1: both alert shapes in one table (UNION ALL by name)."""
    out = None
    for df in alerts:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    cols = []
    for field in ALERT.fields:
        if field.name in out.columns:
            cols.append(F.col(field.name).cast(field.dataType))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    return out.select(*cols)
