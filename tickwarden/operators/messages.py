"""Alert messages (the notification sink's text) and their dispatch.

One message per alert; the wording is fixed by the reference.  An alert
whose ``alert_type`` is unknown or missing gets no message and goes to
the quarantine frame instead of stopping the job.  The two type names
are parameters everywhere, as they are in the detectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwarden.functions.exprs import alert_message
from tickwarden.operators import decode
from tickwarden.schemas import (
    ALERT,
    CHANGE_ALERT_FIELDS,
    PERCENTAGE_CHANGE_ALERT,
    TARGET_ALERT_FIELDS,
    TARGET_PRICE_ALERT,
)


def alert_messages(
    alerts: DataFrame,
    target_type: str = TARGET_PRICE_ALERT,
    change_type: str = PERCENTAGE_CHANGE_ALERT,
) -> DataFrame:
    """``(ticker, alert_type, datetime, message)`` for alerts of a known type."""
    known = alerts.where(F.col("alert_type").isin(target_type, change_type))
    return known.select(
        "ticker", "alert_type", "datetime", alert_message(target_type, change_type).alias("message")
    )


def keyed(texts: DataFrame) -> DataFrame:
    """Messages as topic records ``(key, value)``, key = ticker."""
    return texts.select(F.col("ticker").alias("key"), F.col("message").alias("value"))


def undeliverable(
    alerts: DataFrame,
    target_type: str = TARGET_PRICE_ALERT,
    change_type: str = PERCENTAGE_CHANGE_ALERT,
) -> DataFrame:
    """Alerts without a message: ``(value, reason)`` rows for the quarantine."""
    reason = _type_reason(F.col("alert_type"), target_type, change_type)
    return alerts.select(
        F.to_json(F.struct(*alerts.columns), {"ignoreNullFields": "false"}).alias("value"),
        reason.alias("reason"),
    ).where(F.col("reason").isNotNull())


def _type_reason(alert_type: Column, target_type: str, change_type: str) -> Column:
    return F.when(alert_type.isNull(), F.lit("missing_alert_type")).when(
        ~alert_type.isin(target_type, change_type), F.lit("unknown_alert_type")
    )


def alert_records(
    alerts: DataFrame,
    target_type: str = TARGET_PRICE_ALERT,
    change_type: str = PERCENTAGE_CHANGE_ALERT,
) -> DataFrame:
    """SNK-1 / S16: ``(key, value)`` for the alert topic.

    Each alert type has its own key set and key order, so the JSON text
    is built per type (nulls kept); ``key`` is the ticker.  An alert of
    another type keeps all its columns, so the topic's readers can
    quarantine it.
    """
    opts = {"ignoreNullFields": "false"}
    at = F.col("alert_type")
    value = (
        F.when(at == F.lit(target_type), F.to_json(F.struct(*TARGET_ALERT_FIELDS), opts))
        .when(at == F.lit(change_type), F.to_json(F.struct(*CHANGE_ALERT_FIELDS), opts))
        .otherwise(F.to_json(F.struct(*[f.name for f in ALERT.fields]), opts))
    )
    return alerts.select(F.col("ticker").alias("key"), value.alias("value"))


def parse_records(
    records: DataFrame,
    target_type: str = TARGET_PRICE_ALERT,
    change_type: str = PERCENTAGE_CHANGE_ALERT,
    value_col: str = "value",
) -> DataFrame:
    """SRC-3: alert-topic JSON parsed once: ``rec``, and ``reason`` where
    there is no alert to deliver (not an alert object, or of an unknown or
    missing type).  Persist it to write both outputs from one parse."""
    parsed = decode.parse(records, ALERT, value_col)
    return parsed.withColumn(
        "reason",
        F.coalesce("reason", _type_reason(F.col("rec.alert_type"), target_type, change_type)),
    )


def alerts_from_records(
    records: DataFrame,
    value_col: str = "value",
    target_type: str = TARGET_PRICE_ALERT,
    change_type: str = PERCENTAGE_CHANGE_ALERT,
) -> DataFrame:
    """SRC-3: the deliverable alerts of alert-topic JSON (either shape)."""
    return decode.good_rows(parse_records(records, target_type, change_type, value_col), ALERT)


def rejected_records(
    records: DataFrame,
    value_col: str = "value",
    target_type: str = TARGET_PRICE_ALERT,
    change_type: str = PERCENTAGE_CHANGE_ALERT,
) -> DataFrame:
    """The other alert-topic records: ``(value, reason)`` for the quarantine."""
    return decode.bad_rows(parse_records(records, target_type, change_type, value_col), value_col)
