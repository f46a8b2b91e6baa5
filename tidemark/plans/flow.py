"""Queries: relational primitives, bars and sessions, volume buckets and order flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars, orderflow, relational
from tidemark.plans.registry import R, query, r, rounded
from tidemark.sources.tables import BARS, HOURS, TICKS, daily_bars, hourly_bars, read, ticks


def _events(spark, sf, kind, *cols):
    return read(spark, sf, "events").where(F.col("event_type") == kind).select(*cols)


@query("""SELECT c.event_id, c.user_id, v.event_id AS view_id, v.value AS view_value
    FROM (SELECT * FROM events WHERE event_type = 'click') c
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts >= v.ts""")
def asof_backward(spark: SparkSession, sf: str) -> DataFrame:
    left = _events(spark, sf, "click", "event_id", "user_id", "ts")
    right = _events(spark, sf, "view", "user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return relational.asof_join(left, right, ["user_id"], "ts", ["view_id", "view_value"]).drop("ts")


@query("""SELECT c.event_id, v.event_id AS view_id
    FROM (SELECT * FROM events WHERE event_type = 'click') c
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts <= v.ts""")
def asof_forward(spark: SparkSession, sf: str) -> DataFrame:
    left = _events(spark, sf, "click", "event_id", "user_id", "ts")
    right = _events(spark, sf, "view", "user_id", "ts", F.col("event_id").alias("view_id"))
    return relational.asof_join(left, right, ["user_id"], "ts", ["view_id"], "forward").select("event_id", "view_id")


@query("""WITH p AS (
        SELECT c.event_id, v.event_id AS view_id, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(epoch_us(c.ts) - epoch_us(v.ts)), v.ts) AS k
        FROM (SELECT * FROM events WHERE event_type = 'click') c
        JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND abs(epoch_us(c.ts) - epoch_us(v.ts)) <= 86400000000)
    SELECT c.event_id, p.view_id FROM events c LEFT JOIN p ON c.event_id = p.event_id AND k = 1 WHERE c.event_type = 'click'""")
def asof_nearest(spark: SparkSession, sf: str) -> DataFrame:
    left = _events(spark, sf, "click", "event_id", "user_id", "ts")
    right = _events(spark, sf, "view", "user_id", "ts", F.col("event_id").alias("view_id"))
    return relational.nearest_join(left, right, ["user_id"], "ts", ["view_id"], 86400).select("event_id", "view_id")


@query("""SELECT p.event_id AS signup_id, count(*) AS n_events, round(sum(e.value), 2) + 0.0 AS total
    FROM events p JOIN events e ON e.user_id = p.user_id AND e.ts BETWEEN p.ts AND p.ts + INTERVAL 2 HOUR
    WHERE p.event_type = 'signup' GROUP BY 1""")
def range_join_window(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("user_id", "ts", "value")
    starts = _events(spark, sf, "signup", "user_id", F.col("event_id").alias("signup_id"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("end"))
    joined = relational.range_join(e, starts, ["user_id"], "ts", "start", "end", 7200)
    return joined.groupBy("signup_id").agg(F.count("*").alias("n_events"), r(F.sum("value"), 2).alias("total"))


@query(f"""WITH {HOURS} SELECT a.symbol, a.ts, a.close, b.close AS close_later FROM hours a LEFT JOIN hours b ON a.symbol = b.symbol AND b.ts = a.ts + INTERVAL 3 HOUR""")
def shifted_join(spark: SparkSession, sf: str) -> DataFrame:
    h = hourly_bars(spark, sf).select("symbol", "ts", "close")
    return relational.shifted_join(h, ["symbol"], "ts", "close", 10800, "close_later").select("symbol", "ts", "close", "close_later")


@query("""SELECT user_id, event_type, event_id, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def dedupe_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    return relational.keep_last(read(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT o_custkey, o_orderkey, o_totalprice, k AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3""")
def top_k_per_group(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    return relational.top_k(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query(f"""WITH {BARS}, n AS (SELECT count(DISTINCT symbol) AS n FROM bars), t AS (SELECT date FROM bars GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT n FROM n))
    SELECT symbol, date, close FROM bars WHERE date IN (SELECT date FROM t)""")
def align_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return relational.common_times(daily_bars(spark, sf), ts="date").select("symbol", "date", "close")


@query(f"""WITH {BARS}, spine AS (SELECT * FROM (SELECT DISTINCT date FROM bars), (SELECT DISTINCT symbol FROM bars))
    SELECT s.symbol, s.date, last_value(b.close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY s.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close
    FROM spine s LEFT JOIN bars b USING (symbol, date)""")
def align_union(spark: SparkSession, sf: str) -> DataFrame:
    return relational.all_times(daily_bars(spark, sf), ["close"], ts="date")


@query(f"""WITH {BARS}, n AS (SELECT count(DISTINCT symbol) AS n FROM bars), t AS (SELECT date FROM bars GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT n FROM n))
    SELECT symbol, count(*) AS n_rows, count(*) FILTER (date IN (SELECT date FROM t)) AS n_common,
           {R("count(*) FILTER (date IN (SELECT date FROM t)) / count(*)")} AS efficiency FROM bars GROUP BY 1""")
def alignment_efficiency(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(relational.alignment_report(daily_bars(spark, sf), ts="date"), "efficiency")


@query(f"""WITH {BARS}, x AS (SELECT symbol, date, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS ret FROM bars)
    SELECT a.symbol AS name_a, b.symbol AS name_b, count(*) AS n, {R("corr(a.ret, b.ret)")} AS correlation
    FROM x a JOIN x b USING (date) WHERE a.symbol < b.symbol AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2""")
def pairwise_correlation(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.functions.numeric import by, log_ratio

    b = daily_bars(spark, sf)
    x = b.select("symbol", "date", log_ratio("close", F.lag("close").over(by("symbol", "date"))).alias("ret"))
    return rounded(relational.pairs(x, ["date"], "symbol", "ret"), "correlation")


@query(f"""WITH {TICKS} SELECT symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, arg_min(price, tick_id) AS open, max(price) AS high, min(price) AS low,
        arg_max(price, tick_id) AS close, {R("sum(ask_volume)", 2)} AS ask_volume, {R("sum(bid_volume)", 2)} AS bid_volume FROM ticks GROUP BY 1, 2""")
def resample_15min(spark: SparkSession, sf: str) -> DataFrame:
    out = bars.resample(ticks(spark, sf), "15 minutes", tiebreak="tick_id", sums=("ask_volume", "bid_volume"))
    return rounded(out, "ask_volume", "bid_volume", digits=2).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"""WITH {BARS} SELECT symbol, date + CAST((4 - (isodow(date) - 1) + 7) % 7 AS INTEGER) AS week, arg_min(open, date) AS open, max(high) AS high,
        min(low) AS low, arg_max(close, date) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY 1, 2""")
def resample_weekly(spark: SparkSession, sf: str) -> DataFrame:
    return bars.resample_weekly(daily_bars(spark, sf), 4)


@query(f"""WITH {TICKS}, g AS (SELECT symbol, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS gap FROM ticks),
    c AS (SELECT symbol, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2)
    SELECT symbol, {R("max(n) / sum(n)")} AS modal_share, max(n) / sum(n) < 0.8 AS is_tick FROM c GROUP BY 1""")
def tick_data_test(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bars.is_tick_data(ticks(spark, sf)), "modal_share")


@query("""SELECT event_id, ts FROM events WHERE hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) >= 79200 OR hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) <= 7200""")
def session_overnight(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").where(bars.in_session("ts", "22:00", "02:00")).select("event_id", "ts")


@query("""SELECT event_id, CASE WHEN hour(ts) * 60 + minute(ts) >= 510 THEN CAST(ts AS DATE) ELSE CAST(ts AS DATE) - 1 END AS session_date,
        CAST(floor((hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) - 30600) / 60) AS BIGINT) AS k FROM events""")
def session_labels(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    return e.select("event_id", bars.session_date("ts", "08:30").alias("session_date"), bars.minutes_since_open("ts", "08:30").alias("k"))


@query("""WITH s AS (SELECT DISTINCT CAST(ts AS DATE) AS session_id FROM events WHERE isodow(ts) <= 5)
    SELECT e.event_id, min(s.session_id) AS session_id FROM events e LEFT JOIN s ON e.ts < s.session_id + INTERVAL 15 HOUR GROUP BY 1""")
def sessionize(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("event_id", "ts")
    return bars.attach_sessions(e, bars.schedule(e.select(F.col("ts").alias("date")))).select("event_id", "session_id")


@query("""SELECT event_id, CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
        CAST(floor((day(ts) + isodow(date_trunc('month', ts)) - 2) / 7) + 1 AS INTEGER) AS wom_calendar,
        CAST(floor((day(ts) - 1) / 7) + 1 AS INTEGER) AS wom_days, strftime(ts, '%H:%M:%S') AS clock_time, CAST(ts AS DATE) AS local_date FROM events""")
def calendar_columns(spark: SparkSession, sf: str) -> DataFrame:
    return bars.calendar_columns(read(spark, sf, "events").select("event_id", "ts")).drop("ts")


_GAPS = f"""{HOURS}, g AS (SELECT symbol, ts AS gap_end, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS gap_start FROM hours),
    s AS (SELECT *, CAST(epoch(gap_end) - epoch(gap_start) AS BIGINT) AS seconds FROM g WHERE gap_start IS NOT NULL),
    c AS (SELECT symbol, seconds, count(*) AS n FROM s GROUP BY 1, 2),
    m AS (SELECT symbol, seconds AS modal_seconds FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, seconds) AS k FROM c) WHERE k = 1),
    found AS (SELECT symbol, gap_start, gap_end, seconds, CASE WHEN isodow(gap_start) = 5 AND isodow(gap_end) = 1 AND seconds < 72 * 3600 THEN 'weekend'
        WHEN seconds BETWEEN 24 * 3600 AND 72 * 3600 THEN 'holiday' WHEN isodow(gap_start) >= 4 AND isodow(gap_end) <= 2 AND seconds > 48 * 3600 THEN 'contract_roll'
        ELSE 'data_missing' END AS gap_type FROM s JOIN m USING (symbol) WHERE seconds > 2 * modal_seconds)"""


@query(f"WITH {_GAPS} SELECT symbol, gap_start, gap_end, seconds, gap_type FROM found")
def gap_detection(spark: SparkSession, sf: str) -> DataFrame:
    return bars.gaps(hourly_bars(spark, sf), factor=2.0).select("symbol", "gap_start", "gap_end", "seconds", "gap_type")


@query(f"WITH {_GAPS} SELECT symbol, gap_type, count(*) AS n_gaps, CAST(sum(seconds) AS BIGINT) AS total_seconds, max(seconds) AS longest_seconds FROM found GROUP BY 1, 2")
def gap_summary(spark: SparkSession, sf: str) -> DataFrame:
    return bars.gap_summary(bars.gaps(hourly_bars(spark, sf), factor=2.0))


SIZE, WINDOW = 500.0, 20
_BUCKETS = f"""{TICKS}, placed AS (SELECT *, sum(CAST(ask_volume + bid_volume AS DECIMAL(18,2))) OVER (PARTITION BY symbol ORDER BY ts, tick_id ROWS UNBOUNDED PRECEDING) AS cumulative FROM ticks),
    b AS (SELECT symbol, CAST(floor((CAST(cumulative AS DOUBLE) - 1e-9) / 500) AS BIGINT) AS bucket, min(ts) AS ts_start, max(ts) AS ts_end,
          sum(ask_volume) AS ask_volume, sum(bid_volume) AS bid_volume, count(*) AS n_ticks FROM placed GROUP BY 1, 2),
    buckets AS (SELECT *, ask_volume + bid_volume AS total_volume, ask_volume / (ask_volume + bid_volume) AS ask_share, ask_volume - bid_volume AS imbalance,
          (ask_volume - bid_volume) / (ask_volume + bid_volume) AS imbalance_fraction FROM b)"""


def _buckets(spark, sf):
    return orderflow.volume_buckets(ticks(spark, sf), SIZE, ("ts", "tick_id"))


@query(f"""WITH {_BUCKETS} SELECT symbol, bucket, ts_start, ts_end, n_ticks, {R("ask_volume", 2)} AS ask_volume, {R("bid_volume", 2)} AS bid_volume, {R("ask_share")} AS ask_share,
        {R("imbalance_fraction")} AS imbalance_fraction FROM buckets""")
def volume_buckets(spark: SparkSession, sf: str) -> DataFrame:
    out = _buckets(spark, sf).select("symbol", "bucket", "ts_start", "ts_end", "n_ticks", "ask_volume", "bid_volume", "ask_share", "imbalance_fraction")
    return rounded(rounded(out, "ask_volume", "bid_volume", digits=2), "ask_share", "imbalance_fraction")


@query(f"""WITH {TICKS}, d AS (SELECT symbol, CAST(ts AS DATE) AS date, sum(ask_volume + bid_volume) AS volume FROM ticks GROUP BY 1, 2),
    base AS (SELECT symbol, quantile_cont(volume, 0.5) / 10 AS base FROM d GROUP BY 1),
    c AS (SELECT DISTINCT symbol, greatest(round_even(base * k, 0), 1.0) AS bucket_size FROM base, (SELECT unnest([0.5, 0.75, 1.0, 1.25, 1.5, 2.0]) AS k)),
    s AS (SELECT symbol, bucket_size, abs(quantile_cont(ceil(volume / bucket_size), 0.5) - 10) AS miss, var_pop(ceil(volume / bucket_size)) AS v FROM d JOIN c USING (symbol) GROUP BY 1, 2)
    SELECT symbol, bucket_size, miss FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY miss, v, bucket_size) AS k FROM s) WHERE k = 1""")
def auto_bucket_size(spark: SparkSession, sf: str) -> DataFrame:
    return orderflow.auto_bucket_size(ticks(spark, sf), 10)


@query(f"""WITH {_BUCKETS} SELECT symbol, bucket, {R(f"sum(abs(imbalance)) OVER w / sum(total_volume) OVER w")} AS vpin FROM buckets
    WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)""")
def vpin(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(orderflow.vpin(_buckets(spark, sf), WINDOW).select("symbol", "bucket", "vpin"), "vpin")


@query(f"""WITH {_BUCKETS}, f AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket) AS i, ask_volume > bid_volume AS buy FROM buckets),
    runs AS (SELECT *, i - row_number() OVER (PARTITION BY symbol, buy ORDER BY bucket) AS g FROM f),
    pos AS (SELECT *, row_number() OVER (PARTITION BY symbol, buy, g ORDER BY bucket) AS k FROM runs)
    SELECT a.symbol, a.bucket, {R("sum(abs(b.imbalance)) / sum(b.total_volume)")} AS vpin, {R("sum(b.ask_volume) / sum(b.total_volume)")} AS buy_share,
           CAST(coalesce(max(least(b.k, b.i - a.i + {WINDOW})) FILTER (b.buy), 0) AS INTEGER) AS max_buy_run
    FROM pos a JOIN pos b ON a.symbol = b.symbol AND b.i BETWEEN a.i - {WINDOW - 1} AND a.i GROUP BY a.symbol, a.bucket, a.i""")
def vpin_signed(spark: SparkSession, sf: str) -> DataFrame:
    out = orderflow.vpin_signed(ticks(spark, sf), SIZE, WINDOW, order=("ts", "tick_id"))
    return rounded(out.select("symbol", "bucket", "vpin", "buy_share", "max_buy_run"), "vpin", "buy_share")


@query(f"""WITH {TICKS} SELECT symbol, count(*) AS n_ticks, count(*) FILTER (ask_volume IS NULL OR bid_volume IS NULL) AS n_null,
        count(*) FILTER (ask_volume < 0 OR bid_volume < 0) AS n_negative, count(*) FILTER (ask_volume = 0 AND bid_volume = 0) AS n_zero,
        min(ts) AS first_ts, max(ts) AS last_ts, {R("sum(ask_volume + bid_volume)", 2)} AS total_volume FROM ticks GROUP BY 1""")
def vpin_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(orderflow.tick_diagnostics(ticks(spark, sf)), "total_volume", digits=2)


@query(f"""WITH {TICKS}, m AS (SELECT symbol, CAST(ts AS DATE) AS date, quantile_cont(price, 0.5) AS med, avg(price) AS mean, stddev_pop(price) AS sd FROM ticks GROUP BY 1, 2),
    d AS (SELECT t.tick_id, t.symbol, m.date, t.price, med, mean, sd FROM ticks t JOIN m ON t.symbol = m.symbol AND CAST(t.ts AS DATE) = m.date),
    a AS (SELECT symbol, date, quantile_cont(abs(price - med), 0.5) AS mad FROM d GROUP BY 1, 2)
    SELECT tick_id, {R("CASE WHEN mad > 0 THEN 0.67448975 * (price - med) / mad WHEN sd > 0 THEN (price - mean) / sd ELSE 0 END")} AS robust_z FROM d JOIN a USING (symbol, date)""")
def robust_zscores(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf).withColumn("date", F.to_date("ts"))
    return rounded(orderflow.robust_zscores(t, "price", ["symbol", "date"]).select("tick_id", "robust_z"), "robust_z")


_METRICS = f"""{_BUCKETS}, metrics AS (SELECT *, ask_share - 0.5 AS buy_pressure, 0.5 - ask_share AS sell_pressure, CAST(isodow(ts_end) - 1 AS INTEGER) AS weekday,
        strftime(date_trunc('hour', ts_end), '%H:%M:%S') AS clock_time, CAST(floor((day(ts_end) - 1) / 7) + 1 AS INTEGER) AS wom FROM buckets),
    long AS (SELECT symbol, weekday, clock_time, wom, metric, value FROM (UNPIVOT metrics ON buy_pressure, sell_pressure, imbalance_fraction INTO NAME metric VALUE value))"""
_NAMES = ["buy_pressure", "sell_pressure", "imbalance_fraction"]


def _metrics(spark, sf):
    return orderflow.pressure_metrics(_buckets(spark, sf))


@query(f"""WITH {_METRICS} SELECT symbol, clock_time, metric, {R("avg(value)")} AS mean, {R("quantile_cont(value, 0.5)")} AS median, count(*) AS n FROM long GROUP BY 1, 2, 3""")
def intraday_pressure(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(orderflow.pressure_table(_metrics(spark, sf), _NAMES), "mean", "median")


def _seasonality_sql(groups: str) -> str:
    return f"""WITH {_METRICS} SELECT symbol, {groups}, metric, {R("avg(value)")} AS mean, {R("stddev(value)")} AS std, count(*) AS n,
        {R("CASE WHEN stddev(value) > 0 THEN avg(value) / (stddev(value) / sqrt(count(*))) ELSE 0 END")} AS t_stat
        FROM long GROUP BY ALL HAVING count(*) > 1"""


@query(_seasonality_sql("weekday"))
def orderflow_weekly_pressure(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: scan, running-sum buckets, t statistics; q values are tested separately, DuckDB has no Student t."""
    out = orderflow.seasonality_table(_metrics(spark, sf), ["weekday"], _NAMES)
    return rounded(out.drop("p_value", "q_value", "rejected"), "mean", "std", "t_stat")


WOM_WEEKDAY = _seasonality_sql("wom, weekday")


def pressure_by_wom(spark: SparkSession, sf: str) -> DataFrame:
    """The table as it is published, so rounded: patterns are made from these numbers."""
    return rounded(orderflow.seasonality_table(_metrics(spark, sf), ["wom", "weekday"], _NAMES), "mean", "std", "t_stat")


@query(WOM_WEEKDAY)
def orderflow_wom_weekday(spark: SparkSession, sf: str) -> DataFrame:
    return pressure_by_wom(spark, sf).drop("p_value", "q_value", "rejected")


@query()
def orderflow_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly table with p and q values, inverse metrics left out, and the session counts."""
    tables = orderflow.scan(ticks(spark, sf), SIZE, WINDOW, ("ts", "tick_id"))
    return tables["weekly"].join(tables["metadata"], "symbol")


@query()
def orderflow_peak_pressure(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf)
    weekly = orderflow.seasonality_table(m, ["weekday"], _NAMES)
    return orderflow.weekly_peak_pressure(m, weekly.withColumn("rejected", F.col("p_value") <= 0.5), _NAMES)
