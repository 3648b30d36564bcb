"""Trades made of the test tables, for Spark and for DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``lineitem`` as trades: eleven price levels, integral volumes, quarters as bars; seq, the order of arrival, is one
#: number (day, order, line, part), unique within a security.
TRADES_SQL = """
SELECT l_suppkey AS security, l_shipdate AS trad_time, round(1.0 + l_discount * 100, 2) AS price, l_quantity AS volume,
       l_orderkey % 32 AS bid_seq, l_partkey % 32 AS offer_seq, CASE WHEN l_orderkey % 32 > l_partkey % 32 THEN 1 ELSE -1 END AS side,
       ((CAST({days} AS BIGINT) * 4194304 + l_orderkey % 4194304) * 8 + l_linenumber % 8) * 4194304 + l_partkey % 4194304 AS seq,
       {bar} AS bar
FROM lineitem
"""
_DUCK_DAYS = "date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE))"
DUCK_TRADES = TRADES_SQL.format(days=_DUCK_DAYS, bar="CAST(date_trunc('quarter', l_shipdate) AS TIMESTAMP)")
DUCK_MONTHS = TRADES_SQL.format(days=_DUCK_DAYS, bar="CAST(date_trunc('month', l_shipdate) AS TIMESTAMP)")

#: ``events`` as ticks.
TICKS_SQL = """
SELECT user_id AS security, ts AS trad_time, event_id AS seq, value AS price, {props} AS volume,
       CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE -1 END AS side FROM events
"""
DUCK_TICKS = TICKS_SQL.format(props="CAST(json_extract_string(props, '$.k') AS DOUBLE)")


def trades(spark: SparkSession, sf_dir: str, bar: str = "QUARTER", period: int = 1) -> DataFrame:
    """Keyed trades of ``lineitem``; only the columns read are scanned."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines.createOrReplaceTempView("tidemark_lineitem")
    sql = TRADES_SQL.format(days="datediff(l_shipdate, DATE'1990-01-01')", bar=f"CAST(date_trunc('{bar}', l_shipdate) AS TIMESTAMP_NTZ)").replace("FROM lineitem", "FROM tidemark_lineitem")
    return spark.sql(sql).withColumn("period", F.lit(period))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as ticks of users."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("tidemark_events")
    sql = TICKS_SQL.format(props="CAST(get_json_object(props, '$.k') AS DOUBLE)").replace("FROM events", "FROM tidemark_events")
    return spark.sql(sql)


#: ``events`` as trades: prices in tenths, so that levels have several trades; event_id is the order of arrival and of time.
EVENT_TRADES_SQL = """
SELECT CAST(user_id AS STRING) AS security, ts AS trad_time, round(value / 20) / 10 + 1 AS price, {props} + 1 AS volume,
       event_id * 7 % 16 AS bid_seq, event_id * 5 % 16 AS offer_seq, CASE WHEN event_id * 7 % 16 > event_id * 5 % 16 THEN 1 ELSE -1 END AS side, event_id AS seq FROM events
"""
DUCK_EVENT_TRADES = EVENT_TRADES_SQL.format(props="CAST(json_extract_string(props, '$.k') AS DOUBLE)").replace("AS STRING", "AS VARCHAR")


def event_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as trades of users."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("tidemark_events")
    return spark.sql(EVENT_TRADES_SQL.format(props="CAST(get_json_object(props, '$.k') AS DOUBLE)").replace("FROM events", "FROM tidemark_events"))
