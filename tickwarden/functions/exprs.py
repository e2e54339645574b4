"""Column expressions shared by the batch and streaming operators.

All of these are built-in Spark expressions (JVM side, whole-stage
codegen), no Python UDF.  Time helpers work on ``TIMESTAMP_NTZ`` and
epoch milliseconds only, so results do not depend on the session time
zone: UTC wall-clock time is the documented convention.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwarden.schemas import (
    DECREASE_MESSAGE,
    INCREASE_MESSAGE,
    PERCENTAGE_CHANGE_ALERT,
    TARGET_MESSAGE,
    TARGET_PRICE_ALERT,
)

MS_PER_SECOND = 1_000
MS_PER_MINUTE = 60 * MS_PER_SECOND
MS_PER_HOUR = 60 * MS_PER_MINUTE
MS_PER_DAY = 24 * MS_PER_HOUR
MS_PER_WEEK = 7 * MS_PER_DAY
# 1970-01-05 was a Monday: weeks start on Monday.
WEEK_OFFSET_MS = 4 * MS_PER_DAY

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------- numbers


def round2(col: Column | str) -> Column:
    """Round to 2 decimals, half to even on the scaled value.

    Python's ``round(x, 2)`` is half-even on the exact binary value;
    ``rint(x * 100) / 100`` matches it except on a few hand-made near
    ties (2.675).  ``F.round`` is half-up and differs far more often.
    """
    return F.rint(_c(col) * F.lit(100.0)) / F.lit(100.0)


def pct_change(cur: Column | str, prev: Column | str) -> Column:
    """``((cur - prev) / prev) * 100``; null instead of an error when prev is 0."""
    cur, prev = _c(cur), _c(prev)
    return F.try_divide(cur - prev, prev) * F.lit(100.0)


def order_key(df: DataFrame, cols: Sequence[str]) -> Column:
    """One sortable, never-null value for an ordering over ``cols``.

    ``min_by`` / ``max_by`` with a struct as ordering force a sort-based
    aggregate; a single fixed-width key keeps them in hash aggregation
    (map-side partial aggregation without sorting).  ``(timestamp, b)`` -
    epoch ms and an integral sequence number - packs into one
    ``DECIMAL(38,0)`` as ``timestamp * 10^20 + (b + 2^63)``, which
    preserves the order for any long ``b`` while ``|timestamp| < 10^17``
    (epoch ms up to year 3 million); other leading columns could
    overflow that, so they keep the struct.  Nulls sort first (as in the
    windows' ascending order) instead of being skipped by ``min_by`` /
    ``max_by``.
    """
    types = dict(df.dtypes)
    integral = {"bigint", "int", "smallint", "tinyint"}
    if len(cols) == 1 and types.get(cols[0]) in integral:
        return F.coalesce(F.col(cols[0]).cast("bigint"), F.lit(-(2**63)))
    if len(cols) == 1 and types.get(cols[0]) in ("double", "float"):
        return F.coalesce(F.col(cols[0]).cast("double"), F.lit(float("-inf")))
    if len(cols) == 2 and cols[0] == "timestamp" and all(types.get(c) in integral for c in cols):
        dec = "decimal(38,0)"
        shift = F.expr("CAST('100000000000000000000' AS DECIMAL(38,0))")
        bias = F.expr("CAST('9223372036854775808' AS DECIMAL(38,0))")
        a = F.coalesce(F.col(cols[0]).cast(dec), F.expr("CAST('-99999999999999999' AS DECIMAL(38,0))"))
        b = F.coalesce(F.col(cols[1]).cast(dec), -bias)
        return a * shift + (b + bias)
    return F.struct(*cols)


# ------------------------------------------------------------------- time


def ms_to_ntz(ms: Column | str) -> Column:
    """Epoch milliseconds to a UTC wall-clock ``TIMESTAMP_NTZ``."""
    return F.timestamp_add("MILLISECOND", _c(ms), F.expr(_EPOCH_NTZ))


def ntz_to_ms(ts: Column | str) -> Column:
    """``TIMESTAMP_NTZ`` (UTC wall clock) to epoch milliseconds.

    Built from date parts: ``timestamp_diff`` on NTZ values inside a
    daylight-saving gap of the session zone is off by an hour.
    """
    ts = _c(ts)
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    millis = F.floor(F.date_part(F.lit("SECOND"), ts) * F.lit(1000)).cast("bigint")
    return (
        days * F.lit(MS_PER_DAY)
        + F.hour(ts).cast("bigint") * F.lit(MS_PER_HOUR)
        + F.minute(ts).cast("bigint") * F.lit(MS_PER_MINUTE)
        + millis
    )


def ms_to_instant(ms: Column | str) -> Column:
    """Epoch milliseconds to ``TIMESTAMP`` (an instant; watermarks need it)."""
    return F.timestamp_millis(_c(ms))


def iso_datetime(ms: Column | str) -> Column:
    """ISO-8601 text without zone, like Python ``datetime.isoformat()``.

    Seconds precision when the millisecond part is zero, else six
    fraction digits (``2022-01-01T00:00:00``, ``2024-01-01T00:09:58.778000``).
    Built from the text of a ``TIMESTAMP_NTZ`` (zone free) and kept small
    so it stays inside whole-stage codegen; years 1000-9999.
    """
    ms = _c(ms)
    text = ms_to_ntz(ms).cast("string")  # yyyy-MM-dd HH:mm:ss[.fff]
    base = F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8))
    frac = F.pmod(ms, F.lit(1000))
    return F.concat(
        base,
        F.when(frac == 0, F.lit("")).otherwise(
            F.concat(F.lit("."), F.lpad((frac * F.lit(1000)).cast("string"), 6, "0"))
        ),
    )


def bucket_start_ms(ms: Column | str, multiplier: int, timespan: str) -> Column:
    """Start (epoch ms) of the ``multiplier x timespan`` bucket holding ``ms``.

    Second to day buckets align to the epoch, weeks start on Monday,
    month / quarter / year buckets align to the calendar (UTC), counted
    in months since 1970-01.
    """
    ms = _c(ms)
    fixed = {
        "second": MS_PER_SECOND,
        "minute": MS_PER_MINUTE,
        "hour": MS_PER_HOUR,
        "day": MS_PER_DAY,
    }
    if timespan in fixed:
        width = F.lit(fixed[timespan] * multiplier)
        return ms - F.pmod(ms, width)
    if timespan == "week":
        width = F.lit(MS_PER_WEEK * multiplier)
        return ms - F.pmod(ms - F.lit(WEEK_OFFSET_MS), width)
    months = {"month": 1, "quarter": 3, "year": 12}[timespan] * multiplier
    ts = ms_to_ntz(ms)
    since = (F.year(ts) - F.lit(1970)) * F.lit(12) + F.month(ts) - F.lit(1)
    start = since - F.pmod(since, F.lit(months))
    first = F.make_timestamp_ntz(
        F.lit(1970) + F.floor(start / F.lit(12)).cast("int"),
        F.pmod(start, F.lit(12)).cast("int") + F.lit(1),
        F.lit(1),
        F.lit(0),
        F.lit(0),
        F.lit(0),
    )
    return ntz_to_ms(first)


# ------------------------------------------------------------------- text


# Shortest digits that read back as the same double, from the JSON library
# on Spark's own class path.  A cast to string (Java 17's text) sometimes
# has a digit too many.
SHORTEST_DIGITS = "com.fasterxml.jackson.core.io.schubfach.DoubleToDecimal"
# Below this, one digit may do where that text has two.
TWO_DIGIT_LIMIT = 1e-322


def num_text(x: Column | str) -> Column:
    """Python ``repr`` text of a double (what an f-string shows).

    Digits through the built-in ``java_method``, Python's layout
    (``1e+16``, ``1e-05``, ``nan``, ``inf``) through text functions; no
    Python in a task.
    """
    x = _c(x).cast("double")
    one = F.format_string("%.0e", x)
    digits = (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when((F.abs(x) < F.lit(TWO_DIGIT_LIMIT)) & (x != 0) & (one.cast("double") == x), one)
        .otherwise(F.call_function("java_method", F.lit(SHORTEST_DIGITS), F.lit("toString"), x))
    )
    # the transform computes the digits once for all their uses
    return F.transform(F.array(digits), _python_layout)[0]


def _python_layout(text: Column) -> Column:
    """``1.25E10`` and the like as Python lays them out: plain from 1e-4
    up to 1e16, else ``d.ddde±xx``."""
    sign = F.when(text.startswith("-"), "-").otherwise("")
    mantissa = F.substring_index(F.ltrim(text, F.lit("-")), "E", 1)
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    fraction = F.substring_index(mantissa, ".", -1)
    fraction = F.when(fraction == "0", "").otherwise(fraction)
    digits = F.concat(F.substring(mantissa, 1, 1), fraction)
    whole = F.rpad(F.substring(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0"))
    rest = F.substring(digits, exponent + 2, F.lit(17))
    scientific = F.concat(
        F.substring(mantissa, 1, 1),
        F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)),
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.when(F.abs(exponent) < 10, "0").otherwise(""),
        F.abs(exponent).cast("string"),
    )
    return (
        F.when(text == "NaN", "nan")
        .when(text.endswith("Infinity"), F.concat(sign, F.lit("inf")))
        .when(~text.contains("E"), text)
        .when(exponent == -4, F.concat(sign, F.lit("0.000"), digits))
        .when(
            (exponent >= 0) & (exponent < 16),
            F.concat(sign, whole, F.lit("."), F.when(rest == "", "0").otherwise(rest)),
        )
        .otherwise(F.concat(sign, scientific))
    )


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """A ``{name}`` text template filled with columns (one ``concat``)."""
    parts: list[Column] = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(values[field])
    return F.concat(*parts)


def target_message(datetime: Column, ticker: Column, target: Column, current: Column) -> Column:
    """Target-price alert text."""
    return fill_template(
        TARGET_MESSAGE,
        {
            "datetime": _py_str(datetime),
            "ticker": _py_str(ticker),
            "target_price": _py_num(target),
            "current_price": _py_num(current),
        },
    )


def change_message(datetime: Column, ticker: Column, pct: Column, current: Column) -> Column:
    """Price-change alert text: the increase wording when pct > 0, else
    the decrease wording (the sign stays in the number)."""
    values = {
        "datetime": _py_str(datetime),
        "ticker": _py_str(ticker),
        "price_change_percentage": _py_num(pct),
        "current_price": _py_num(current),
    }
    return F.when((pct > 0) & ~F.isnan(pct), fill_template(INCREASE_MESSAGE, values)).otherwise(
        fill_template(DECREASE_MESSAGE, values)
    )


def alert_message(
    target_type: str = TARGET_PRICE_ALERT, change_type: str = PERCENTAGE_CHANGE_ALERT
) -> Column:
    """Message for one alert row of either shape; null for an unknown type."""
    at = F.col("alert_type")
    return (
        F.when(
            at == F.lit(target_type),
            target_message(
                F.col("datetime"), F.col("ticker"), F.col("target_price"), F.col("current_price")
            ),
        )
        .when(
            at == F.lit(change_type),
            change_message(
                F.col("datetime"),
                F.col("ticker"),
                F.col("price_change_percentage"),
                F.col("current_price"),
            ),
        )
        .otherwise(F.lit(None).cast("string"))
    )


def _py_str(col: Column) -> Column:
    # f-string of None is "None"
    return F.coalesce(col.cast("string"), F.lit("None"))


def _py_num(col: Column) -> Column:
    return F.coalesce(num_text(col), F.lit("None"))

