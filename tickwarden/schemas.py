"""Explicit record schemas.

The reference moves schemaless JSON objects; here every record shape is
a fixed ``StructType`` and records that do not conform go to a
quarantine frame instead of failing the job.
"""

from pyspark.sql import types as T

# One upstream aggregate bar as delivered by the market-data API.
RAW_BAR = T.StructType(
    [
        T.StructField("v", T.DoubleType()),  # volume in the period
        T.StructField("vw", T.DoubleType()),  # volume-weighted average price
        T.StructField("o", T.DoubleType()),  # open
        T.StructField("c", T.DoubleType()),  # close
        T.StructField("h", T.DoubleType()),  # high
        T.StructField("l", T.DoubleType()),  # low
        T.StructField("t", T.LongType()),  # period start, epoch ms
        T.StructField("n", T.LongType()),  # number of trades
    ]
)

# One page of the paged aggregates response; a bar's fields stay JSON text,
# so an absent field and a null one differ.
PAGE = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("results", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
        T.StructField("next_url", T.StringType()),
    ]
)

# A landed page together with the request it answered.
LINKED_PAGE = T.StructType([T.StructField("url", T.StringType()), *PAGE.fields])

# The main stream record (a normalised bar or tick).
TICK = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("datetime", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("vwap", T.DoubleType()),
        T.StructField("number_of_trades", T.LongType()),
    ]
)
TICK_FIELDS = [f.name for f in TICK.fields]

TARGET_ALERT = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("datetime", T.StringType()),
        T.StructField("target_price", T.DoubleType()),
        T.StructField("current_price", T.DoubleType()),
        T.StructField("alert_type", T.StringType()),
    ]
)
TARGET_ALERT_FIELDS = [f.name for f in TARGET_ALERT.fields]

CHANGE_ALERT = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("datetime", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("previous_price", T.DoubleType()),
        T.StructField("current_price", T.DoubleType()),
        T.StructField("price_change_percentage", T.DoubleType()),
        T.StructField("alert_type", T.StringType()),
    ]
)
CHANGE_ALERT_FIELDS = [f.name for f in CHANGE_ALERT.fields]

# Both alert shapes in one table (the alert topic), columns of the other
# shape null.
ALERT = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("datetime", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("target_price", T.DoubleType()),
        T.StructField("previous_price", T.DoubleType()),
        T.StructField("current_price", T.DoubleType()),
        T.StructField("price_change_percentage", T.DoubleType()),
        T.StructField("alert_type", T.StringType()),
    ]
)

# Fixed values that must equal the reference's for right results.
TARGET_PRICE_ALERT = "target_price"
PERCENTAGE_CHANGE_ALERT = "percentage_change"
DEFAULT_MEASUREMENT = "stock_price"
DEFAULT_TIMESPAN_KEY = "current"
IGNORED_FIELDS = ("time", "interval")
TIMESPANS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")
TARGET_MESSAGE = (
    "{datetime} {ticker} price has reached the target of ${target_price}. "
    "Current price: ${current_price}"
)
INCREASE_MESSAGE = (
    "{datetime} {ticker} price has increased by {price_change_percentage}%. "
    "Current price: ${current_price}"
)
DECREASE_MESSAGE = (
    "{datetime} {ticker} price has decreased by {price_change_percentage}%. "
    "Current price: ${current_price}"
)
MULTIPLIER_ERROR = "Multiplier must be positive"
TIMESPAN_ERROR = "Invalid timespan"
DATE_FORMAT_ERROR = "Invalid date format. Use YYYY-MM-DD"
