"""Results and plans that only large tables show: busy days, long histories, large running sums."""

import datetime
import os
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_oracle import TABLES, rows
from tidemark.operators import bars, microstructure
from tidemark.plans import catalog, flow
from tidemark.plans.registry import R, r


@pytest.fixture(scope="module")
def heavy(data, tmp_path_factory):
    """The tables with a first tick of each symbol that takes its running volume over 2^24, and every fifth one on a bucket's border."""
    folder = tmp_path_factory.mktemp("heavy")
    for t in TABLES:
        if t != "events":
            os.symlink(f"{data}/{t}.parquet", folder / f"{t}.parquet")
    con = duckdb.connect()
    con.execute(f"""COPY (WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k FROM read_parquet('{data}/events.parquet')),
        v AS (SELECT * REPLACE (CAST(CASE k WHEN 0 THEN 2e7 ELSE greatest(value, 0.01) END AS DECIMAL(18,2)) AS value) FROM e),
        o AS (SELECT *, sum(value) FILTER (k % 5 < 4) OVER (PARTITION BY event_type, k // 5) AS others FROM v)
        SELECT * EXCLUDE (k, others) REPLACE (CASE WHEN k % 5 = 4 THEN 500 - CAST(others % 500 AS DOUBLE) ELSE CAST(value AS DOUBLE) END AS value) FROM o) TO '{folder}/events.parquet' (FORMAT parquet)""")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return str(folder), con


#: Queries that stand on volume buckets.
ON_BUCKETS = [
    "volume_buckets",
    "vpin",
    "orderflow_wom_weekday",
    "screen_patterns",
    "pattern_gates",
    "any_pattern_active",
    "pattern_series",
    "decision_rows",
    "aggregated_positions",
    "resolved_decisions",
    "backtest_rows",
    "backtest_by_pattern",
    "backtest_by_week",
    "threshold_sweep",
]


@pytest.mark.parametrize("name", ON_BUCKETS)
def test_buckets_of_large_volumes(spark, heavy, name):
    folder, con = heavy
    assert rows(catalog.queries()[name](spark, folder).toPandas()) == rows(con.execute(catalog.oracle_sql()[name]).df())


def grid(spark, days=2, seconds=400):
    """Steps with gaps, some without volume or with an unknown one: symbol, date, second, n_trades, buy_count, sell_count, buy_vol, sell_vol."""
    rng = random.Random(7)
    out = []
    for symbol in "ab":
        for day in range(days):
            for at in sorted(rng.sample(range(seconds), seconds // 3)):
                buys, sells = rng.randrange(4), rng.randrange(4)
                out.append((symbol, datetime.date(2024, 1, 1 + day), 86400 * day + at, buys + sells, buys, sells, 0.1 * buys if at % 90 > 30 else rng.choice([0.0, None]), 0.3 * sells if at % 90 > 30 else 0.0))
    return out, spark.createDataFrame(out, "symbol string, date date, second bigint, n_trades bigint, buy_count bigint, sell_count bigint, buy_vol double, sell_vol double")


def last(steps, i, column, n):
    """Sum over the last n seconds of step i's day, row by row; None without a value."""
    s, d, at = steps[i][:3]
    values = [r[column] for r in steps if r[:2] == (s, d) and at - n < r[2] <= at and r[column] is not None]
    return sum(values) if values else None


def frames_of_time(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("RangeFrame, -")


@pytest.mark.parametrize("window, base", [(1, 7), (10, 60), (50, 1000)])
def test_arrival_rates_without_frames_of_time(spark, window, base):
    steps, df = grid(spark)
    out = microstructure.arrival_rates(df, window, base)
    found = {(r.symbol, r.second): r for r in out.collect()}
    assert len(found) == out.count() == len(steps) and out.columns == [*df.columns, "lam_buy", "z_buy", "lam_sell", "z_sell", "imbalance"]
    for i, step in enumerate(steps):
        r = found[step[0], step[2]]
        for c, rate, z in ((4, r.lam_buy, r.z_buy), (5, r.lam_sell, r.z_sell)):
            usual = last(steps, i, c, base) / base
            assert rate == last(steps, i, c, window) / window and abs(z - (rate - usual) / max(usual, 1e-6) ** 0.5) < 1e-9
    assert frames_of_time(out) == 0


@pytest.mark.parametrize("window", [1, 10, 50, 1000])
def test_flow_features_without_frames_of_time(spark, window):
    steps, df = grid(spark)
    out = microstructure.flow_features(df, window)
    found = {(r.symbol, r.second): r for r in out.collect()}
    assert len(found) == out.count() == len(steps) and out.columns == [*df.columns, "trade_imbalance", "flow", "fano", "variation"]
    for i, step in enumerate(steps):
        r = found[step[0], step[2]]
        b, v, n = (last(steps, i, c, window) for c in (6, 7, 3))
        share = None if b is None or v is None or b + v == 0 else (b - v) / (b + v)
        assert (r.trade_imbalance is None) == (share is None) and (share is None or abs(r.trade_imbalance - share) < 1e-12)
        k = min(window, step[2] - min(s[2] for s in steps if s[:2] == step[:2]) + 1)
        squares = sum(s[3] ** 2 for s in steps if s[:2] == step[:2] and step[2] - window < s[2] <= step[2])
        assert (r.fano is None) == (n == 0) and (n == 0 or abs(r.fano - max(squares / k - (n / k) ** 2, 0) / (n / k)) < 1e-9)
    assert frames_of_time(out) == 0


def test_sessions_are_attached_where_rows_are(spark):
    start = datetime.datetime(2024, 1, 1)
    hours = lambda *h: [start + datetime.timedelta(hours=x) for x in h]
    # two sessions on the first day, one that is over at midnight, none for four days, then one; two close at the same time
    closes = hours(9, 15, 24, 140, 140)
    marks = [(i, c - datetime.timedelta(hours=2), c) for i, c in enumerate(closes)]
    times = hours(*[x / 2 for x in range(-60, 320)]) + [c - datetime.timedelta(microseconds=1) for c in closes] + [None]
    sessions = spark.createDataFrame(marks, "session_id int, open_ts timestamp_ntz, close_ts timestamp_ntz")
    df = spark.createDataFrame(list(enumerate(times)), "i int, ts timestamp_ntz").repartition(4, "i")
    for mode, mark in (("close", lambda m: m[2] - datetime.timedelta(microseconds=1)), ("reference", lambda m: m[1])):
        out = bars.attach_sessions(df, sessions, mode=mode)
        found = {r.i: (r.session_id, r.at) for r in out.withColumn("at", F.spark_partition_id()).collect()}
        assert len(found) == len(times) and len({at for _, at in found.values()}) == 4
        for i, t in enumerate(times):
            ahead = [(mark(m), -m[0]) for m in marks if t is not None and mark(m) >= t]
            assert found[i][0] == (-min(ahead)[1] if ahead else None)
    assert bars.attach_sessions(df, sessions.where("false")).where("session_id IS NULL").count() == len(times)


@pytest.mark.parametrize("digits", [2, 4, 5, 6])
def test_halves_are_rounded_as_in_the_sql(spark, digits):
    rng = random.Random(digits)
    halves = [(2 * rng.randrange(-3_000_000, 3_000_000) + 1) * 5 / 10 ** (digits + 1) for _ in range(5000)]
    odd = [None, 0.0, -0.0, 1e300, -1e18, 2.0**53, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame(list(enumerate([*halves, *odd])), "i int, x double").withColumn("x", r("x", digits))
    con = duckdb.connect()
    con.register("t", pa.table({"i": range(len(halves) + len(odd)), "x": pa.array([*halves, *odd], pa.float64())}))
    found, truth = df.orderBy("i").collect(), con.execute(f"SELECT i, {R('x', digits)} FROM t ORDER BY i").fetchall()
    assert [repr(x.x) for x in found] == [repr(x[1]) for x in truth]


def test_patterns_are_made_from_the_published_table(spark, heavy):
    folder, con = heavy
    names = ["symbol", "wom", "weekday", "metric", "n", "mean", "std", "t_stat"]
    found = sorted(map(tuple, flow.pressure_by_wom(spark, folder).select(*names).collect()))
    assert found == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({flow.WOM_WEEKDAY})").fetchall())


@pytest.fixture(scope="module")
def zeros(data, tmp_path_factory):
    """Events in every hour, with some hours and days that open or close at 0."""
    folder = tmp_path_factory.mktemp("zeros")
    con = duckdb.connect()
    con.execute(f"""COPY (WITH e AS (SELECT event_id + 1000000 * k AS event_id, ts + to_hours(k) AS ts, user_id, event_type, round(value * (1 + (event_id * 7 + k * 5) % 11), 2) + 0.01 AS value, props
            FROM read_parquet('{data}/events.parquet'), (SELECT unnest(range(24)) AS k)),
        x AS (SELECT *, row_number() OVER h AS first, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id DESC) AS last, day(ts) AS d, hour(ts) AS clock FROM e WINDOW h AS (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id))
        SELECT event_id, ts, user_id, event_type, CASE WHEN first = 1 AND (d * 24 + clock) % 97 = 5 OR last = 1 AND (d * 24 + clock) % 101 = 9 AND clock < 20 OR last = 1 AND clock = 23 AND d = 9 AND event_type = 'view' THEN 0.0 ELSE value END AS value, props
        FROM x) TO '{folder}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    return str(folder), con


#: Queries of returns between the prices of hours.
ON_RETURNS = [
    "backtest_by_pattern",
    "aggregated_positions",
    "decision_rows",
    "resolved_decisions",
    "threshold_sweep",
    "screen_patterns",
    "pattern_gates",
    "any_pattern_active",
    "seasonal_ranking",
    "session_horizons",
    "intraday_delta",
    "opening_period_return",
    "feature_backtest",
    "time_predictability",
    "backtest_by_week",
    "backtest_rows",
    "pattern_series",
]


@pytest.mark.parametrize("name", ON_RETURNS)
def test_prices_of_zero(spark, zeros, name):
    folder, con = zeros
    truth = con.execute(catalog.oracle_sql()[name]).df()
    assert len(truth) and rows(catalog.queries()[name](spark, folder).toPandas()) == rows(truth)
