"""Every catalogue query against its oracle SQL (DuckDB) on sf0.001."""

import math

import duckdb
import pytest
from conftest import SF_SMALL

import __spark_entry__ as E
from tickwarden.plans.catalog import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def test_every_query_has_an_oracle():
    missing = set(QUERIES) - set(E.oracle_sql())
    assert not missing


SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
                 "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[key])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    duck = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    assert {n: SPARK_TO_DUCK.get(t, t) for n, t in df.dtypes} == duck
    assert len(rows) == len(orows)
    assert _canon(df.columns, rows) == _canon(rel.columns, orows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 135  # price-change alerts at threshold 500 on sf0.001


@pytest.mark.parametrize("key", ["price_change_alerts", "bars_month", "points_range", "alert_messages"])
def test_results_do_not_depend_on_session_time_zone(spark, key):
    q = E.queries()[key]
    utc = _canon(q(spark, SF_SMALL).columns, [tuple(r) for r in q(spark, SF_SMALL).collect()])
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = q(spark, SF_SMALL)
        other = _canon(df.columns, [tuple(r) for r in df.collect()])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert utc == other


def test_zero_latch_on_real_zero_closes(spark):
    """sf0.1 is the scale whose events contain zero closes (the latch)."""
    sf = "/root/testdata/sf0.1"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet')")
    assert c.sql("SELECT count(*) FROM events WHERE value = 0").fetchall()[0][0] > 0
    df = E.queries()["price_change_alerts"](spark, sf)
    rel = c.sql(E.oracle_sql()["price_change_alerts"])
    assert _canon(df.columns, [tuple(r) for r in df.collect()]) == _canon(rel.columns, rel.fetchall())


@pytest.mark.parametrize("key", ["price_change_alerts", "price_points", "bars_rollup"])
def test_results_do_not_depend_on_ansi_mode(spark, con, key):
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        df = E.queries()[key](spark, SF_SMALL)
        rows = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)
    rel = con.sql(E.oracle_sql()[key])
    assert _canon(df.columns, rows) == _canon(rel.columns, rel.fetchall())
