"""Queries: positioning by instrument and metric, curve tables by type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import curves, features, positioning
from tidemark.plans.curves import _ROLLS, SPOT
from tidemark.plans.registry import SQL, R, query, rounded
from tidemark.sources.tables import POSITIONS, curve, read, trader_positions
from tidemark.sources.tables import positioning as reports

#: Commodities that stand for the financial ones in the star-schema tables.
FINANCIAL = ["URGENT", "HIGH"]
INSTRUMENTS = """inst AS (SELECT DISTINCT o_orderpriority AS symbol, split_part(o_orderpriority, '-', 2) AS commodity, split_part(o_orderpriority, '-', 1) AS code,
    CASE WHEN split_part(o_orderpriority, '-', 2) IN ('URGENT', 'HIGH') THEN 'tff' ELSE 'disaggregated' END AS report FROM orders)"""
TRADERS = """traders AS (
    SELECT split_part(o_orderpriority, '-', 1) AS code, split_part(o_orderpriority, '-', 2) || ' - EXCHANGE' AS name, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, lower(c_mktsegment) AS category,
           count(*) FILTER (o_orderstatus = 'F') AS longs, count(*) FILTER (o_orderstatus = 'O') AS shorts, count(*) FILTER (o_orderstatus = 'P') AS spreads, count(*) AS open_interest
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def _instruments(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda i: F.split_part("o_orderpriority", F.lit("-"), F.lit(i))
    return positioning.instruments(read(spark, sf, "orders"), "o_orderpriority", part(2), part(1), FINANCIAL)


@query(f"WITH {INSTRUMENTS} SELECT * FROM inst")
def instrument_reports(spark: SparkSession, sf: str) -> DataFrame:
    return _instruments(spark, sf)


@query(f"""WITH {TRADERS} SELECT week, code, name, category, longs, shorts FROM traders
    WHERE (name ILIKE '%urg%' OR name ILIKE '%spec%') AND week BETWEEN DATE '1995-01-01' AND DATE '1997-06-30' AND open_interest >= 2 AND category IN ('building', 'machinery')""")
def positions_found(spark: SparkSession, sf: str) -> DataFrame:
    return positioning.find(
        trader_positions(spark, sf), names=["Urg", "SPEC"], start="1995-01-01", end="1997-06-30", least_open_interest=2,
        categories=["BUILDING", "Machinery"], columns=["week", "code", "name", "category", "longs", "shorts"],
    )


@query(f"WITH {TRADERS}, {INSTRUMENTS} SELECT symbol, report, week, category, longs, shorts, spreads FROM traders JOIN inst USING (code) WHERE symbol IN ('1-URGENT', '5-LOW')")
def positions_by_symbol(spark: SparkSession, sf: str) -> DataFrame:
    out = positioning.of_instruments(trader_positions(spark, sf), _instruments(spark, sf), ["1-urgent", " 5-LOW"])
    return out.select("symbol", "report", "week", "category", "longs", "shorts", "spreads")


@query(f"""WITH {TRADERS}, {INSTRUMENTS} SELECT commodity, week, CAST(sum(open_interest) AS BIGINT) AS open_interest, CAST(sum(longs) FILTER (category = 'building') AS BIGINT) AS building_longs, CAST(sum(shorts) FILTER (category = 'building') AS BIGINT) AS building_shorts,
    CAST(sum(longs) FILTER (category = 'furniture') AS BIGINT) AS furniture_longs, CAST(sum(shorts) FILTER (category = 'furniture') AS BIGINT) AS furniture_shorts FROM traders JOIN inst USING (code) WHERE commodity IN ('MEDIUM', 'HIGH') GROUP BY 1, 2""")
def positions_by_commodity(spark: SparkSession, sf: str) -> DataFrame:
    out = positioning.of_instruments(trader_positions(spark, sf), _instruments(spark, sf), ["medium", "High"], "commodity")
    return positioning.side_by_category(out, ["building", "furniture"], ("longs", "shorts"), ("commodity", "week"))


@query(f"WITH {TRADERS} SELECT DISTINCT code, name FROM traders")
def position_codes(spark: SparkSession, sf: str) -> DataFrame:
    return positioning.codes_listed(trader_positions(spark, sf))


@query(f"""WITH {TRADERS}, {INSTRUMENTS} SELECT report, CAST(grouping(report) AS INTEGER) AS is_total, count(*) AS n_rows, count(DISTINCT code) AS n_codes, min(week) AS first, max(week) AS last FROM traders JOIN inst USING (code) GROUP BY ROLLUP (report)""")
def positions_summary(spark: SparkSession, sf: str) -> DataFrame:
    of = _instruments(spark, sf).select("code", "report")
    # a row an instrument
    out = positioning.summary(trader_positions(spark, sf).join(F.broadcast(of), "code"))
    return out.withColumn("is_total", F.col("is_total").cast("int"))


_METRICS = f"""m AS (SELECT symbol, week, metric, {R("value", 4)} AS value FROM (
    UNPIVOT (SELECT symbol, week, CAST(COLUMNS(* EXCLUDE (symbol, week)) AS DOUBLE) FROM ({SQL["cot_features"]})) ON COLUMNS(* EXCLUDE (symbol, week)) INTO NAME metric VALUE value))"""
_GROUPS = """coalesce(nullif(concat_ws(',', CASE WHEN regexp_matches(metric, 'position|net|long|short') THEN 'positioning' END, CASE WHEN regexp_matches(metric, 'flow|change|delta') THEN 'flows' END,
    CASE WHEN regexp_matches(metric, 'extreme|percentile|zscore|outlier') THEN 'extremes' END, CASE WHEN regexp_matches(metric, 'concentration|ratio|structure|dominance') THEN 'market_structure' END), ''), 'other')"""


def _metrics(spark: SparkSession, sf: str, groups: list[str] | None = None) -> DataFrame:
    return positioning.metrics(features.cot_features(reports(spark, sf)).drop("longs", "shorts", "spreads", "open_interest"), groups=groups)


@query(f"WITH {_METRICS} SELECT * FROM m WHERE regexp_matches(metric, 'flow|extreme')")
def position_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_metrics(spark, sf, ["flows", "extremes"]), "value", digits=4)


@query(f"WITH {_METRICS} SELECT symbol, metric, {_GROUPS} AS groups, count(*) AS n_values, min(week) AS first, max(week) AS last FROM m GROUP BY 1, 2, 3")
def position_metrics_info(spark: SparkSession, sf: str) -> DataFrame:
    return positioning.metrics_info(_metrics(spark, sf))


@query(f"""WITH {POSITIONS} SELECT week, {", ".join(f"max({f}) FILTER (symbol = '{s}') AS " + f'"{s}_{f}"' for s in ("1-URGENT", "3-MEDIUM") for f in ("longs", "shorts"))} FROM cot WHERE symbol IN ('1-URGENT', '3-MEDIUM') GROUP BY week""")
def positions_side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    return positioning.side_by_side(reports(spark, sf), ["1-URGENT", "3-MEDIUM"], ["longs", "shorts"])


_NUMBERS = {"curve": "price", "volume_curve": "volume", "oi_curve": "oi", "dte": "dte"}
_IN_SEQUENCE = {"seq_curve": "price", "seq_volume": "volume", "seq_oi": "oi", "seq_dte": "dte", "seq_spreads": "adjacent"}
_TABLES = (
    f"{_ROLLS}, {SPOT[SPOT.index('spot AS'):]}, sq AS (SELECT *, lead(price) OVER (PARTITION BY symbol, date ORDER BY seq) - price AS adjacent FROM seq), tables AS ("
    + " UNION ALL ".join(
        [f"SELECT symbol, date, '{t}' AS curve_type, CAST(NULL AS INTEGER) AS seq, CAST(contract AS VARCHAR) AS contract, CAST({c} AS DOUBLE) AS value FROM curve WHERE {c} IS NOT NULL" for t, c in _NUMBERS.items()]
        + [f"SELECT symbol, date, '{t}', seq, CAST(contract AS VARCHAR), CAST({c} AS DOUBLE) FROM sq WHERE {c} IS NOT NULL" for t, c in _IN_SEQUENCE.items()]
        + ["SELECT symbol, date, 'seq_labels', seq, CAST(contract AS VARCHAR), NULL FROM sq", "SELECT symbol, date, 'front', NULL, CAST(contract AS VARCHAR), price FROM sq WHERE seq = 0"]
        + ["SELECT symbol, date, 'spot', NULL, NULL, spot FROM spot", "SELECT symbol, date, 'roll_dates', NULL, pattern, interval_days FROM ri"]
    )
    + ")"
)


@query(f"WITH {_TABLES} SELECT symbol, date, curve_type, seq, contract, {R('value')} AS value FROM tables")
def curve_tables(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.curve_tables(curve(spark, sf)), "value")


@query(f"WITH {_TABLES} SELECT symbol, curve_type, count(*) AS n_rows, count(DISTINCT date) AS n_days, min(date) AS first, max(date) AS last FROM tables WHERE date BETWEEN DATE '1994-03-01' AND DATE '1997-12-31' AND curve_type IN ('seq_spreads', 'oi_curve', 'spot') GROUP BY 1, 2")
def curve_table_summary(spark: SparkSession, sf: str) -> DataFrame:
    return curves.curve_summary(curves.curve_tables(curve(spark, sf), ["seq_spreads", "oi_curve", "spot"], "1994-03-01", "1997-12-31"))
