"""The canonical tables, derived from the star-schema files: ticks, daily bars, futures curve, positioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, price, ask_volume, bid_volume, side, tick_id."""
    e = read(spark, sf_dir, "events")
    ask = F.col("event_id") % 2 == 0
    return e.select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("value").alias("price"),
        F.when(ask, F.col("value")).otherwise(0.0).alias("ask_volume"),
        F.when(ask, 0.0).otherwise(F.col("value")).alias("bid_volume"),
        F.when(ask, "B").otherwise("S").alias("side"),
        F.col("event_id").alias("tick_id"),
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, open, high, low, close, volume."""
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count("*").alias("volume"),
    )


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts (the hour), open, high, low, close, volume, date, hour."""
    t = ticks(spark, sf_dir)
    g = t.groupBy("symbol", F.date_trunc("hour", "ts").alias("ts")).agg(
        F.min_by("price", "tick_id").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "tick_id").alias("close"),
        F.sum(F.col("price").cast("decimal(18,2)")).cast("double").alias("volume"),
    )
    return g.withColumns({"date": F.to_date("ts"), "hour": F.hour("ts")})


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, contract, price, volume, oi, expiry (the 20th of the contract's month), dte."""
    c = read(spark, sf_dir, "lineitem")
    g = c.groupBy(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("date"), F.col("l_linenumber").alias("contract")).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.sum("l_quantity").alias("volume"),
        F.count("*").alias("oi"),
    )
    expiry = F.date_add(F.add_months(F.trunc("date", "month"), F.col("contract")), 19)
    return g.withColumn("expiry", expiry).withColumn("dte", F.datediff("expiry", "date"))


def positioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, week, longs, shorts, spreads, open_interest, as order counts by status."""
    o = read(spark, sf_dir, "orders")
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).agg(
        n("F").alias("longs"), n("O").alias("shorts"), n("P").alias("spreads"), F.count("*").alias("open_interest")
    )


def trader_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name, week, category, longs, shorts, spreads, open_interest, as order counts by status and the customer's segment."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lower("c_mktsegment").alias("category"))
    o = read(spark, sf_dir, "orders").join(c, "o_custkey")
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    part = lambda i: F.split_part("o_orderpriority", F.lit("-"), F.lit(i))
    return o.groupBy(part(1).alias("code"), F.concat(part(2), F.lit(" - EXCHANGE")).alias("name"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("week"), "category").agg(
        n("F").alias("longs"), n("O").alias("shorts"), n("P").alias("spreads"), F.count("*").alias("open_interest")
    )


#: The same tables in DuckDB's SQL, for the oracles.
TICKS = """ticks AS (
    SELECT event_type AS symbol, ts, value AS price, CASE WHEN event_id % 2 = 0 THEN value ELSE 0 END AS ask_volume,
           CASE WHEN event_id % 2 = 0 THEN 0 ELSE value END AS bid_volume, CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'S' END AS side,
           event_id AS tick_id
    FROM events)"""
BARS = """bars AS (
    SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open,
           max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume
    FROM orders GROUP BY 1, 2)"""
HOURS = (
    TICKS
    + """, hours AS (
    SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, tick_id) AS open, max(price) AS high, min(price) AS low,
           arg_max(price, tick_id) AS close, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS volume,
           CAST(date_trunc('hour', ts) AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour
    FROM ticks GROUP BY symbol, date_trunc('hour', ts), hour(ts))"""
)
CURVE = """curve AS (
    SELECT *, date_diff('day', date, expiry) AS dte FROM (
        SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date, l_linenumber AS contract,
               avg(l_extendedprice / l_quantity) AS price, sum(l_quantity) AS volume, count(*) AS oi,
               CAST(date_trunc('month', CAST(l_shipdate AS DATE)) + to_months(CAST(l_linenumber AS INTEGER)) + INTERVAL 19 DAY AS DATE) AS expiry
        FROM lineitem GROUP BY 1, 2, 3, 7))"""
POSITIONS = """cot AS (
    SELECT o_orderpriority AS symbol, CAST(date_trunc('week', o_orderdate) AS DATE) AS week,
           count(*) FILTER (o_orderstatus = 'F') AS longs, count(*) FILTER (o_orderstatus = 'O') AS shorts,
           count(*) FILTER (o_orderstatus = 'P') AS spreads, count(*) AS open_interest
    FROM orders GROUP BY 1, 2)"""
