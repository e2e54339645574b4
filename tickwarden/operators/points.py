"""Time-series points: projection, upsert (last write wins), range reads.

The reference writes one point per tick to a time-series store, which
overwrites a point with the same measurement, tag set and time.  Here
points are appended to a parquet log partitioned by ``measurement`` and
``date``; the upsert is resolved at read time (``max_by`` on the
arrival order), and a range read prunes date partitions first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwarden.functions.exprs import round2
from tickwarden.schemas import DEFAULT_MEASUREMENT

POINT_FIELDS = ["measurement", "time", "ticker", "price"]


def parse_point_time(text: Column) -> Column:
    """ISO text to a UTC ``TIMESTAMP_NTZ``.

    Text with ``Z`` or an offset (``+05``, ``+0530``, ``+05:30``) is an
    instant (converted to UTC); text without a zone is UTC already.
    Anything else, named zones included, gives null.
    """
    date, clock = "[0-9]{4}-[0-9]{2}-[0-9]{2}", "[0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?"
    text = F.trim(text)
    has_zone = text.rlike(f"^{date}[T ]{clock}(Z|[+-][0-9]{{2}}(:?[0-9]{{2}})?)$")
    # the cast wants seconds before a zone, and hours and minutes in an offset
    seconds = F.regexp_replace(text, "([T ][0-9]{2}:[0-9]{2})(Z|[+-])", "$1:00$2")
    hours_only = F.regexp_replace(seconds, r"(:[0-9.]+[+-][0-9]{2})$", "$1:00")
    instant = F.regexp_replace(hours_only, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2").try_cast("timestamp")
    micros = F.unix_micros(instant)
    as_utc = F.timestamp_add("MICROSECOND", micros, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return F.when(has_zone, as_utc).when(
        text.rlike(f"^{date}([T ]{clock})?$"), text.try_cast("timestamp_ntz")
    )


def points_from_records(
    records: DataFrame,
    measurement: str = DEFAULT_MEASUREMENT,
    value_col: str = "value",
    order_col: str = "offset",
) -> DataFrame:
    """SRC-2/DEC-4/PRJ-4: JSON tick text to ``(measurement, time, ticker,
    price, offset)``, with the record's ``record_time`` and ``partition``
    where the source has them (offsets of several partitions do not
    compare).

    ``close`` may be a number or numeric text; records whose close does
    not convert, or whose ticker or time is missing, are dropped.  NaN
    and infinite prices are dropped too (the store rejects them).
    """
    source = [c for c in ("record_time", "partition") if c in records.columns]
    # json_tuple parses each record once (numbers come back as their text)
    rec = records.select(
        F.json_tuple(F.col(value_col).cast("string"), "ticker", "datetime", "close").alias(
            "ticker", "datetime", "close"
        ),
        F.col(order_col).alias("offset"),
        *source,
    )
    price = round2(F.trim(F.col("close")).try_cast("double"))
    pts = rec.select(
        F.lit(measurement).alias("measurement"),
        parse_point_time(F.col("datetime")).alias("time"),
        F.col("ticker"),
        price.alias("price"),
        "offset",
        *source,
    )
    p = F.col("price")
    return pts.where(
        F.col("ticker").isNotNull()
        & F.col("time").isNotNull()
        & p.isNotNull()
        & ~F.isnan(p)
        & (F.abs(p) != F.lit(float("inf")))
    )


def upsert_points(points: DataFrame, order_col: str = "offset") -> DataFrame:
    """AGG-4: last write wins per (measurement, ticker, time).

    Writes are ordered by the time their source recorded them, then by
    partition and offset; a source without the first two has one offset
    sequence.  A point without an arrival order counts as the oldest
    write (it is never dropped, as ``max_by`` would drop a null ordering).
    """
    source = [c for c in ("record_time", "partition") if c in points.columns]
    arrival = F.coalesce(F.col(order_col).cast("bigint"), F.lit(-(2**63)))
    if source:
        arrival = F.struct(*source, arrival)
    return points.groupBy("measurement", "ticker", "time").agg(
        F.max_by("price", arrival).alias("price")
    ).select(*POINT_FIELDS)


def write_point_log(points: DataFrame, path: str, mode: str = "append") -> None:
    """SNK-3: append points, partitioned by measurement and UTC date.

    Range partitioning on ``(measurement, date, ticker, time)`` first: each
    task then covers a narrow key range and writes to one or two date
    folders (not one small file per task in every folder), and the sampled
    range bounds split a hot date, or one ticker's hot day, over several
    tasks.
    """
    (
        points.withColumn("date", F.col("time").cast("date"))
        .repartitionByRange("measurement", "date", "ticker", "time")
        .write.mode(mode)
        .partitionBy("measurement", "date")
        .parquet(path)
    )


def range_bounds(start: str | None, stop: str | None) -> tuple[Column, Column]:
    """The bounds as UTC wall-clock times; by default from two years ago until
    now."""
    now = F.expr("convert_timezone(current_timezone(), 'UTC', localtimestamp())")
    lo = F.lit(start).cast("timestamp_ntz") if start else now - F.expr("INTERVAL 2 YEARS")
    return lo, F.lit(stop).cast("timestamp_ntz") if stop else now


def read_points_range(
    spark: SparkSession,
    path: str,
    start: str | None = None,
    stop: str | None = None,
    measurement: str = DEFAULT_MEASUREMENT,
) -> DataFrame:
    """FLT-6: points with ``start <= time < stop`` of one measurement,
    upserted.  The date and measurement predicates prune partitions."""
    log = spark.read.parquet(path)
    lo, hi = range_bounds(start, stop)
    sel = log.where(
        (F.col("measurement") == F.lit(measurement))
        & (F.col("date") >= lo.cast("date"))
        & (F.col("date") <= hi.cast("date"))
        & (F.col("time") >= lo)
        & (F.col("time") < hi)
    )
    return upsert_points(sel)

