"""Oracle SQL: an independent DuckDB statement per catalogue key.

The statements run on the fixture tables registered as views
(``events``, ``orders``, ``lineitem`` ...).  Column names equal the
Spark query's.  Formulas are written the way the semantics read
(``lag`` over the whole key, a running zero flag), not the chunked
Spark plan, so the two are checked against each other.
"""

from __future__ import annotations

from tickwarden.plans import params as P
from tickwarden.schemas import PERCENTAGE_CHANGE_ALERT, TARGET_PRICE_ALERT

ORACLE: dict[str, str] = {}


# epoch_ms() rounds to the nearest millisecond; the tick convention (and
# Spark) truncates, so milliseconds are taken as epoch_us // 1000.


def iso(ms: str) -> str:
    return (
        f"(strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%S') || "
        f"CASE WHEN ({ms}) % 1000 <> 0 THEN '.' || "
        f"lpad(CAST((({ms}) % 1000) * 1000 AS VARCHAR), 6, '0') ELSE '' END)"
    )


def r2(x: str) -> str:
    return f"(round_even(({x}) * 100, 0) / 100)"


EVENT_TICKS = f"""event_ticks AS (
  SELECT CAST(user_id AS VARCHAR) AS ticker,
         (epoch_us(ts) // 1000) AS timestamp,
         {iso('(epoch_us(ts) // 1000)')} AS datetime,
         value AS close,
         event_id AS seq,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS size,
         event_type
  FROM events)"""

ORDER_TICKS = f"""order_ticks AS (
  SELECT CAST(o_custkey AS VARCHAR) AS ticker,
         (epoch_us(o_orderdate) // 1000) AS timestamp,
         {iso('(epoch_us(o_orderdate) // 1000)')} AS datetime,
         o_totalprice AS close,
         o_orderkey AS seq
  FROM orders)"""


def change_alerts_sql(ticks: str, threshold: float, order: str = "timestamp, seq") -> str:
    return f"""change_v AS (
  SELECT ticker, datetime, timestamp, close AS cur,
         lag(close) OVER (PARTITION BY ticker ORDER BY {order}) AS prev,
         max(CASE WHEN close = 0 THEN 1 ELSE 0 END) OVER (
           PARTITION BY ticker ORDER BY {order}
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stuck
  FROM {ticks} WHERE close IS NOT NULL),
change_c AS (
  SELECT ticker, datetime, timestamp, prev AS previous_price, cur AS current_price,
         {r2('(cur - prev) / prev * 100')} AS price_change_percentage,
         '{PERCENTAGE_CHANGE_ALERT}' AS alert_type
  FROM change_v
  WHERE prev IS NOT NULL AND coalesce(stuck, 0) = 0 AND prev <> 0),
change_alerts AS (
  SELECT * FROM change_c
  WHERE NOT isnan(price_change_percentage)
    AND abs(price_change_percentage) >= {float(threshold)})"""


def target_alerts_sql(ticks: str, target: float, order: str = "timestamp, seq") -> str:
    return f"""target_alerts AS (
  SELECT ticker, arg_min(datetime, ({order.replace(', ', ', ')})) AS datetime,
         CAST({float(target)} AS DOUBLE) AS target_price,
         arg_min(close, ({order})) AS current_price,
         '{TARGET_PRICE_ALERT}' AS alert_type
  FROM {ticks}
  WHERE close >= {float(target)} AND NOT isnan(close)
  GROUP BY ticker)"""


ALERTS = f"""{change_alerts_sql('event_ticks', P.PRICE_CHANGE_THRESHOLD)},
{target_alerts_sql('event_ticks', P.TARGET_PRICE)},
alerts AS (
  SELECT ticker, datetime, CAST(NULL AS BIGINT) AS timestamp, target_price,
         CAST(NULL AS DOUBLE) AS previous_price, current_price,
         CAST(NULL AS DOUBLE) AS price_change_percentage, alert_type
  FROM target_alerts
  UNION ALL
  SELECT ticker, datetime, timestamp, CAST(NULL AS DOUBLE) AS target_price,
         previous_price, current_price, price_change_percentage, alert_type
  FROM change_alerts)"""


ORACLE["price_change_alerts"] = f"""WITH {EVENT_TICKS},
{change_alerts_sql('event_ticks', P.PRICE_CHANGE_THRESHOLD)}
SELECT * FROM change_alerts"""

ORACLE["target_price_alerts"] = f"""WITH {EVENT_TICKS},
{target_alerts_sql('event_ticks', P.TARGET_PRICE)}
SELECT * FROM target_alerts"""

ORACLE["alerts_union"] = f"""WITH {EVENT_TICKS},
{ALERTS}
SELECT * FROM alerts"""

# Values stay in [1e-3, 1e7) here, where DuckDB's and Python's float
# text agree.
ORACLE["alert_messages"] = f"""WITH {EVENT_TICKS},
{ALERTS}
SELECT ticker, alert_type, datetime,
       CASE WHEN alert_type = '{TARGET_PRICE_ALERT}' THEN
              datetime || ' ' || ticker || ' price has reached the target of $' ||
              CAST(target_price AS VARCHAR) || '. Current price: $' ||
              CAST(current_price AS VARCHAR)
            ELSE
              datetime || ' ' || ticker || ' price has ' ||
              CASE WHEN price_change_percentage > 0 THEN 'increased' ELSE 'decreased' END ||
              ' by ' || CAST(price_change_percentage AS VARCHAR) ||
              '%. Current price: $' || CAST(current_price AS VARCHAR)
       END AS message
FROM alerts"""

ORACLE["order_change_alerts"] = f"""WITH {ORDER_TICKS},
{change_alerts_sql('order_ticks', P.ORDER_CHANGE_THRESHOLD)}
SELECT * FROM change_alerts"""

ORACLE["round2"] = f"""SELECT l_orderkey, l_linenumber,
       l_extendedprice * (1 - l_discount) AS amount,
       {r2('l_extendedprice * (1 - l_discount)')} AS amount_r2
FROM lineitem"""


def dbl(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def tick_json(close_text: str) -> str:
    """Spark's compact ``to_json`` text of a tick, as string concatenation."""
    return (
        "'{\"ticker\":\"' || ticker || '\",\"timestamp\":' || CAST(timestamp AS VARCHAR) || "
        "',\"datetime\":\"' || datetime || '\",\"open\":' || " + dbl("close") + " || "
        "',\"close\":' || " + close_text + " || "
        "',\"high\":' || " + dbl("close") + " || ',\"low\":' || " + dbl("close") + " || "
        "',\"volume\":' || " + dbl("CAST(size AS DOUBLE)") + " || "
        "',\"vwap\":' || " + dbl("close") + " || ',\"number_of_trades\":1}'"
    )


def garble(text: str) -> str:
    return f"replace({text}, ':', '=')"


ORACLE["iso_datetime"] = f"""SELECT event_id, epoch_us(ts) // 1000 AS timestamp,
       {iso('epoch_us(ts) // 1000')} AS datetime
FROM events"""

ORACLE["record_json"] = f"""WITH {EVENT_TICKS}
SELECT ticker AS key, {tick_json(dbl('close'))} AS value FROM event_ticks"""

TICK_COLUMNS = """ticker, timestamp, datetime, close AS open, close, close AS high, close AS low,
       CAST(size AS DOUBLE) AS volume, close AS vwap, CAST(1 AS BIGINT) AS number_of_trades"""

ORACLE["decode_ticks"] = f"""WITH {EVENT_TICKS}
SELECT {TICK_COLUMNS}
FROM event_ticks WHERE event_type NOT IN ('error', 'purchase')"""

ORACLE["quarantine"] = f"""WITH {EVENT_TICKS}
SELECT CASE WHEN event_type = 'error' THEN {garble(tick_json(dbl('close')))}
            ELSE {tick_json(chr(39) + '"' + chr(39) + ' || ' + dbl('close') + ' || ' + chr(39) + '"' + chr(39))}
       END AS value,
       'malformed' AS reason
FROM event_ticks WHERE event_type IN ('error', 'purchase')"""

ORACLE["pages_explode"] = f"""WITH {EVENT_TICKS}
SELECT ticker, CAST(size AS DOUBLE) AS v, close AS vw, close AS o, close AS c, close AS h,
       close AS l, timestamp AS t, CAST(1 AS BIGINT) AS n
FROM event_ticks"""


# the links walked one by one from every page that no page names
LINKED_PAGES = f"""{EVENT_TICKS},
numbered AS (
  SELECT ticker, (row_number() OVER (PARTITION BY ticker ORDER BY seq) - 1) // 5 AS page,
         (count(*) OVER (PARTITION BY ticker) - 1) // 5 AS last FROM event_ticks),
p AS (
  SELECT '/bars/' || ticker || '/' || page AS url, any_value(ticker) AS ticker, count(*) AS bars,
         CASE WHEN page < last THEN '/bars/' || ticker || '/' || (page + 1)
              WHEN CAST(ticker AS BIGINT) % 11 = 0 THEN '/bars/' || ticker || '/0' END AS next_url
  FROM numbered WHERE NOT (CAST(ticker AS BIGINT) % 13 = 5 AND page = 1) GROUP BY ticker, page, last),
walk AS (
  SELECT url, next_url, url AS chain, 0 AS position FROM p
  WHERE url NOT IN (SELECT next_url FROM p WHERE next_url IS NOT NULL)
  UNION ALL
  SELECT p.url, p.next_url, walk.chain, walk.position + 1 FROM walk JOIN p ON p.url = walk.next_url),
placed AS (
  SELECT url, next_url, chain, position FROM walk
  UNION ALL
  SELECT url, next_url, min(url) OVER (PARTITION BY ticker), NULL FROM p WHERE url NOT IN (SELECT url FROM walk))"""
ORACLE["pages_chain"] = f"""WITH RECURSIVE {LINKED_PAGES}
SELECT placed.url, chain, CAST(position AS BIGINT) AS position, bars FROM placed JOIN p ON p.url = placed.url"""
ORACLE["pages_chain_report"] = f"""WITH RECURSIVE {LINKED_PAGES},
ends AS (
  SELECT chain, count(*) AS pages, bool_or(position IS NULL) AS closed,
         arg_max({{'next_url': next_url}}, position).next_url AS next_url FROM placed GROUP BY chain)
SELECT chain, pages, CASE WHEN closed THEN 'cycle' WHEN next_url IS NULL THEN 'complete' ELSE 'broken' END AS status,
       CASE WHEN NOT closed THEN next_url END AS next_url
FROM ends"""


def bars_sql(bucket: str, ticks: str = "SELECT * FROM event_ticks") -> str:
    # an exact decimal sum; through its text to the nearest double
    return f"""WITH {EVENT_TICKS},
t AS ({ticks}),
b AS (
  SELECT ticker, {bucket} AS bucket,
         arg_min(close, (timestamp, seq)) AS open,
         arg_max(close, (timestamp, seq)) AS close,
         max(close) AS high, min(close) AS low,
         sum(CAST(size AS DOUBLE)) AS volume,
         count(*) AS number_of_trades,
         CAST(CAST(sum(CAST(close AS DECIMAL(18,6)) * CAST(size AS DECIMAL(18,4))) AS VARCHAR) AS DOUBLE)
           AS notional
  FROM t GROUP BY 1, 2)
SELECT ticker, bucket AS timestamp, {iso('bucket')} AS datetime, open, close, high, low, volume,
       CASE WHEN volume = 0 THEN NULL ELSE notional / volume END AS vwap,
       number_of_trades, notional
FROM b"""


TS_MS = "(timestamp)"
ORACLE["bars_day"] = bars_sql("(timestamp // 86400000) * 86400000")
ORACLE["bars_5min"] = bars_sql("(timestamp // 300000) * 300000")
ORACLE["bars_month"] = bars_sql(
    "epoch_us(date_trunc('month', make_timestamp(timestamp * 1000))) // 1000"
)
# Week bars straight from the ticks (ISO weeks start on Monday).
ORACLE["bars_rollup"] = bars_sql(
    "epoch_us(date_trunc('week', make_timestamp(timestamp * 1000))) // 1000"
)

ORACLE["bar_records"] = f"""WITH bars AS ({bars_sql('(timestamp // 86400000) * 86400000')})
SELECT ticker, timestamp, {iso('timestamp')} AS datetime, open, close, high, low, volume, vwap,
       number_of_trades
FROM bars"""

POINTS = f"""WITH p AS (
  SELECT CAST(user_id AS VARCHAR) AS ticker, date_trunc('hour', ts) AS time,
         {r2('value')} AS price, event_id AS seq
  FROM events WHERE event_type <> 'error')
SELECT '{P.MEASUREMENT}' AS measurement, time, ticker, arg_max(price, seq) AS price
FROM p"""

ORACLE["price_points"] = POINTS + "\nGROUP BY ticker, time"

ORACLE["points_range"] = (
    POINTS
    + f"\nWHERE time >= TIMESTAMP '{P.RANGE_START}' AND time < TIMESTAMP '{P.RANGE_STOP}'"
    + "\nGROUP BY ticker, time"
)

ORACLE["points_log_range"] = ORACLE["points_range"]

ORACLE["date_range"] = f"""SELECT * FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{P.DATE_RANGE_START}' AND DATE '{P.DATE_RANGE_END}'"""

ORACLE["route_fields"] = """SELECT 'value' AS topic, CAST(value AS VARCHAR) AS value
FROM events WHERE event_type <> 'error'
UNION ALL
SELECT 'k' AS topic, json_extract_string(props, '$.k') AS value
FROM events WHERE event_type <> 'error'"""


ORACLE["stream_alerts"] = ORACLE["alerts_union"]
ORACLE["stream_resume"] = ORACLE["alerts_union"]
ORACLE["stream_price_change_alerts"] = ORACLE["price_change_alerts"]
ORACLE["stream_target_price_alerts"] = ORACLE["target_price_alerts"]
ORACLE["stream_messages"] = ORACLE["alert_messages"]
ORACLE["scan_ticks"] = f"""WITH {EVENT_TICKS}
SELECT {TICK_COLUMNS} FROM event_ticks"""
ORACLE["raw_tail"] = f"""WITH {EVENT_TICKS}
SELECT {tick_json(dbl('close'))} AS value, seq AS offset FROM event_ticks"""
ORACLE["snapshot_scan"] = f"""WITH {EVENT_TICKS}
SELECT '{{"' || CASE WHEN event_type = 'error' THEN 'hourly' ELSE 'current' END ||
       '":{{"time":"' || datetime || '","interval":900,"value":' || {dbl('close')} ||
       ',"k":' || CAST(size AS VARCHAR) || '}}}}' AS value
FROM event_ticks"""
ORACLE["stream_points"] = ORACLE["price_points"]
ORACLE["stream_route"] = ORACLE["route_fields"]
ORACLE["stream_bars"] = ORACLE["bars_5min"]

ORACLE["stream_quarantine"] = ORACLE["quarantine"]

ORACLE["alert_records"] = f"""WITH {EVENT_TICKS},
{ALERTS}
SELECT ticker AS key,
       CASE WHEN alert_type = '{TARGET_PRICE_ALERT}' THEN
         '{{"ticker":"' || ticker || '","datetime":"' || datetime || '","target_price":' ||
         CAST(target_price AS VARCHAR) || ',"current_price":' || CAST(current_price AS VARCHAR) ||
         ',"alert_type":"' || alert_type || '"}}'
       ELSE
         '{{"ticker":"' || ticker || '","datetime":"' || datetime || '","timestamp":' ||
         CAST(timestamp AS VARCHAR) || ',"previous_price":' || CAST(previous_price AS VARCHAR) ||
         ',"current_price":' || CAST(current_price AS VARCHAR) || ',"price_change_percentage":' ||
         CAST(price_change_percentage AS VARCHAR) || ',"alert_type":"' || alert_type || '"}}'
       END AS value
FROM alerts"""

ORACLE["stream_pages"] = ORACLE["pages_explode"]
ORACLE["stream_bars_month"] = ORACLE["bars_month"]

ORACLE["bars_sub_cent"] = bars_sql(
    "epoch_us(date_trunc('week', make_timestamp(timestamp * 1000))) // 1000",
    f"SELECT * REPLACE (close / {P.SUB_CENT} AS close) FROM event_ticks",
)
ORACLE["stream_bars_month_late"] = bars_sql(
    "epoch_us(date_trunc('month', make_timestamp(timestamp * 1000))) // 1000",
    f"SELECT * REPLACE (timestamp - (seq % 3) * {P.LATE_MS} AS timestamp) FROM event_ticks",
)
ORACLE["ingest_ticks"] = f"""WITH {EVENT_TICKS}
SELECT ticker AS key, {tick_json(dbl('close'))} AS value FROM event_ticks
WHERE CAST(make_timestamp(timestamp * 1000) AS DATE)
      BETWEEN DATE '{P.INGEST_START}' AND DATE '{P.INGEST_END}'"""

ORACLE["alerts_custom_type"] = f"""SELECT * REPLACE (
  CASE WHEN alert_type = '{TARGET_PRICE_ALERT}' THEN '{P.CUSTOM_TARGET_TYPE}'
       ELSE '{P.CUSTOM_CHANGE_TYPE}' END AS alert_type)
FROM ({ORACLE['alert_messages']})"""
ORACLE["alert_quarantine"] = f"""SELECT CASE WHEN key LIKE '%3' THEN {garble('value')} ELSE value END AS value,
       CASE WHEN key LIKE '%3' THEN 'malformed' ELSE 'unknown_alert_type' END AS reason
FROM ({ORACLE['alert_records']})
WHERE key LIKE '%3' OR value LIKE '%"alert_type":"{TARGET_PRICE_ALERT}"%'"""

# arrival order (seq) decides; every number of files per trigger gives the same rows
DISORDERED = f"""disordered AS (
  SELECT * REPLACE (timestamp - (seq * 7 % 13) * {P.DISORDER_MS} AS timestamp,
                    {iso(f'(timestamp - (seq * 7 % 13) * {P.DISORDER_MS})')} AS datetime)
  FROM event_ticks)"""
ORACLE["stream_alerts_disorder"] = f"""WITH {EVENT_TICKS},
{DISORDERED},
{change_alerts_sql('disordered', P.PRICE_CHANGE_THRESHOLD, 'seq')},
{target_alerts_sql('disordered', P.TARGET_PRICE, 'seq')},
alerts AS (
  SELECT ticker, datetime, CAST(NULL AS BIGINT) AS timestamp, target_price,
         CAST(NULL AS DOUBLE) AS previous_price, current_price,
         CAST(NULL AS DOUBLE) AS price_change_percentage, alert_type
  FROM target_alerts
  UNION ALL
  SELECT ticker, datetime, timestamp, CAST(NULL AS DOUBLE), previous_price, current_price,
         price_change_percentage, alert_type
  FROM change_alerts)
SELECT alerts.*, CAST(n AS INTEGER) AS files_per_trigger
FROM alerts, (VALUES {', '.join(f'({n})' for n in P.FILES_PER_TRIGGER)}) AS v(n)"""

ORACLE["stream_ingest"] = ORACLE["ingest_ticks"]
ORACLE["stream_snapshot_route"] = f"""WITH {EVENT_TICKS}
SELECT ticker AS topic, arg_max({dbl('close')}, seq) AS value FROM event_ticks
GROUP BY ticker, timestamp // 86400000"""

ORACLE["stream_bars_closed"] = f"""SELECT * FROM ({ORACLE['bars_day']}) AS b
WHERE timestamp + 86400000 <= (SELECT max(epoch_us(ts) // 1000) - 15000 FROM events)"""
ORACLE["stream_alerts_midway"] = ORACLE["alerts_union"]
ORACLE["stream_state"] = f"""WITH {EVENT_TICKS}
SELECT ticker, coalesce(bool_or(close >= {P.TARGET_PRICE} AND NOT isnan(close)), false) AS latched,
       CASE WHEN bool_or(close = 0) THEN 0.0::DOUBLE ELSE arg_max(close, seq) END AS last_close
FROM event_ticks WHERE close IS NOT NULL GROUP BY ticker"""
ORACLE["stream_messages_once"] = ORACLE["alert_messages"]
# message by message as the running form: spacing * i + max(t_j - spacing * j)
ORACLE["message_schedule"] = f"""WITH a AS (
  SELECT ticker, alert_type, current_price, coalesce(timestamp, epoch_us(CAST(datetime AS TIMESTAMP)) // 1000) AS arrived
  FROM ({ORACLE["alerts_union"]}) AS u),
n AS (SELECT *, row_number() OVER (ORDER BY arrived, ticker, alert_type, current_price) AS i FROM a)
SELECT ticker, alert_type, current_price, arrived,
       1200 * i + max(arrived - 1200 * i) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS send_ms FROM n"""
