"""Fixed parameters of the query catalogue (chosen for the fixture tables)."""

PRICE_CHANGE_THRESHOLD = 500.0  # percent, events ticks
TARGET_PRICE = 250.0  # events ticks
ORDER_CHANGE_THRESHOLD = 300.0  # percent, orders series
MEASUREMENT = "stock_price"
RANGE_START = "2024-01-08 00:00:00"  # points_range, start inclusive
RANGE_STOP = "2024-01-15 00:00:00"  # stop exclusive
DATE_RANGE_START = "1997-01-01"
DATE_RANGE_END = "1997-12-31"
INGEST_START = "2024-01-08"
INGEST_END = "2024-01-14"
CUSTOM_TARGET_TYPE = "level_reached"
CUSTOM_CHANGE_TYPE = "jump"
SUB_CENT = 10_000.0  # events values are divided by it
LATE_MS = 5_000  # times arrive 0, 1 or 2 of these late (within the watermark)
DISORDER_MS = 6 * 3_600_000  # and here 0 to 12 of these
FILES_PER_TRIGGER = (1, 4, 64)
ONCE_WITHIN = "60 days"  # longer than the events ticks are apart
