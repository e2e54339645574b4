"""Topic-shaped feeds derived from the fixture tables, and landing them.

A topic record is ``(value STRING, offset BIGINT)``: the JSON text of a
message and its arrival order, the shape a Kafka source row has.  Feeds
are computed by Spark from the tables and written as parquet below the
shared checkpoint folder; file streams then read them like a topic.

Corrupt records in the dirty feeds follow the data, not row ids: the
``error`` events carry a garbled payload, ``purchase`` events a close
sent as quoted text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickwarden.functions.exprs import bucket_start_ms, iso_datetime
from tickwarden.operators.bars import as_raw_bars
from tickwarden.operators.records import record_json
from tickwarden.schemas import TICK_FIELDS
from tickwarden.sources.tables import event_ticks

TOPIC_COLUMNS = ["value", "offset"]


def _garble(text: Column) -> Column:
    """A corrupt payload: every key-value separator garbled (``:`` -> ``=``);
    the whole text is kept."""
    return F.translate(text, ":", "=")


def tick_feed(spark: SparkSession, sf_dir: str, late: Column | None = None) -> DataFrame:
    """Every event as tick JSON text (the stock topic), in event order;
    ``late`` (milliseconds) sets its time back, so times arrive disordered."""
    t = event_ticks(spark, sf_dir, spread=True)
    if late is not None:
        t = t.withColumn("timestamp", F.col("timestamp") - late)
        t = t.withColumn("datetime", iso_datetime(F.col("timestamp")))
    return t.select(record_json(t, TICK_FIELDS).alias("value"), F.col("seq").alias("offset"))


def dirty_tick_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick JSON with corrupt records: garbled text, quoted close."""
    t = event_ticks(spark, sf_dir, spread=True)
    quoted = [F.col(c).cast("string").alias(c) if c == "close" else F.col(c) for c in TICK_FIELDS]
    good = F.to_json(F.struct(*TICK_FIELDS), {"ignoreNullFields": "false"})
    text = (
        F.when(F.col("event_type") == "error", _garble(good))
        .when(
            F.col("event_type") == "purchase",
            F.to_json(F.struct(*quoted), {"ignoreNullFields": "false"}),
        )
        .otherwise(good)
    )
    return t.select(text.alias("value"), F.col("seq").alias("offset"))


def point_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick text at hour granularity, so points of one hour collide.

    ``purchase`` events send the close as text, ``view`` events a time
    with a ``Z`` suffix, ``error`` events are garbled.
    """
    t = event_ticks(spark, sf_dir, spread=True)
    hour = bucket_start_ms(F.col("timestamp"), 1, "hour")
    dt = F.when(F.col("event_type") == "view", F.concat(iso_datetime(hour), F.lit("Z"))).otherwise(
        iso_datetime(hour)
    )
    numeric = F.to_json(F.struct(F.col("ticker"), dt.alias("datetime"), F.col("close")))
    quoted = F.to_json(
        F.struct(F.col("ticker"), dt.alias("datetime"), F.col("close").cast("string").alias("close"))
    )
    body = F.when(F.col("event_type") == "purchase", quoted).otherwise(numeric)
    text = F.when(F.col("event_type") == "error", _garble(body)).otherwise(body)
    return t.select(text.alias("value"), F.col("seq").alias("offset"))


def snapshot_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor snapshots ``{"current": {"time", "interval", "value", "k"}}``;
    ``error`` events arrive without the ``current`` key."""
    t = event_ticks(spark, sf_dir, spread=True)
    fields = F.struct(
        F.col("datetime").alias("time"),
        F.lit(900).alias("interval"),
        F.col("close").alias("value"),
        F.col("size").alias("k"),
    )
    snap = F.when(
        F.col("event_type") == "error", F.to_json(F.struct(fields.alias("hourly")))
    ).otherwise(F.to_json(F.struct(fields.alias("current"))))
    return t.select(snap.alias("value"), F.col("seq").alias("offset"))


def snapshot_documents(spark: SparkSession, sf_dir: str, block: int = 100) -> DataFrame:
    """Pretty-printed snapshots of each day's last closes, at most ``block``
    tickers in a document (``current`` holds a field per ticker)."""
    t = event_ticks(spark, sf_dir).withColumn("day", bucket_start_ms(F.col("timestamp"), 1, "day"))
    last = t.groupBy("day", "ticker").agg(F.max_by("close", "seq").alias("close"))
    fields = F.map_from_entries(F.collect_list(F.struct(F.col("ticker"), F.col("close"))))
    docs = last.groupBy("day", F.floor(F.col("ticker").cast("bigint") / F.lit(block)).alias("block"))
    doc = F.create_map(F.lit("current"), F.col("fields"))
    return docs.agg(fields.alias("fields")).select(
        F.concat_ws("-", "day", "block").alias("poll"),
        F.to_json(doc, {"pretty": "true"}).alias("value"),
    )


def land_documents(docs: DataFrame, path: str) -> str:
    """One file per document, as polls land them, side by side: a folder for
    each would have to be made and listed too."""
    spread = docs.repartition("poll").select("value")
    spread.write.mode("errorifexists").option("maxRecordsPerFile", 1).text(path)
    return path


def page_feed(spark: SparkSession, sf_dir: str, page_size: int = 100) -> DataFrame:
    """Paged aggregates: events as one-trade raw bars, at most
    ``page_size`` per page.  Pages are cut on the event sequence, so a
    page never exceeds the size whatever the ticker skew."""
    t = event_ticks(spark, sf_dir)
    raw = as_raw_bars(t.withColumn("page", F.floor(F.col("seq") / F.lit(page_size))), keep=("page",))
    raw = raw.withColumn("bar", F.struct("v", "vw", "o", "c", "h", "l", "t", "n"))
    return raw.groupBy("ticker", "page").agg(
        F.sort_array(F.collect_list(F.struct(F.col("t").alias("_t"), F.col("bar")))).alias("_r")
    ).select(
        "ticker",
        F.transform("_r", lambda x: x["bar"]).alias("results"),
        F.lit(None).cast("string").alias("next_url"),
        "page",
    )


def linked_page_feed(spark: SparkSession, sf_dir: str, page_size: int = 5) -> DataFrame:
    """Each ticker's bars as a chain of pages of ``page_size``, linked by
    ``next_url`` and landing in no order.  Of tickers divisible by 11 the
    last page names the first again; of tickers that leave 5 modulo 13 the
    second page has not landed."""
    t = event_ticks(spark, sf_dir)
    by_ticker = Window.partitionBy("ticker")
    number = F.floor((F.row_number().over(by_ticker.orderBy("seq")) - 1) / F.lit(page_size))
    raw = as_raw_bars(
        t.withColumn("page", number).withColumn("last", F.floor((F.count("*").over(by_ticker) - 1) / F.lit(page_size))),
        keep=("page", "last"),
    )
    raw = raw.withColumn("bar", F.struct("v", "vw", "o", "c", "h", "l", "t", "n"))
    pages = raw.groupBy("ticker", "page", "last").agg(
        F.sort_array(F.collect_list(F.struct(F.col("t").alias("_t"), F.col("bar")))).alias("_r")
    )
    url = lambda page: F.concat(F.lit("/bars/"), F.col("ticker"), F.lit("/"), page.cast("string"))
    again = F.col("ticker").cast("bigint") % 11 == 0
    following = F.when(F.col("page") < F.col("last"), url(F.col("page") + 1)).when(again, url(F.lit(0)))
    landed = ~((F.col("ticker").cast("bigint") % 13 == 5) & (F.col("page") == 1))
    return pages.where(landed).select(
        url(F.col("page")).alias("url"), "ticker", F.transform("_r", lambda x: x["bar"]).alias("results"),
        following.alias("next_url"),
    ).repartition(F.xxhash64("url"))


def land(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write a feed (one Spark job) and return its path."""
    df.write.mode("errorifexists").format(fmt).save(path)
    return path
