"""Queries: statistics and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import numeric
from tidemark.operators import features
from tidemark.plans.registry import R, query, rounded
from tidemark.sources.tables import BARS, HOURS, POSITIONS, TICKS, daily_bars, hourly_bars, positioning, ticks

W = "OVER (PARTITION BY symbol ORDER BY date)"


def roll(agg: str, c: str, n: int, order: str = "date", least: int | None = None) -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    call = agg.format(c) if "{" in agg else f"{agg}({c})"
    return f"CASE WHEN count({c}) {w} >= {n if least is None else least} THEN {call} {w} END"


RETURNS = f"{BARS}, rets AS (SELECT *, ln(close / lag(close) {W}) AS ret FROM bars)"


@query(f"WITH {BARS} SELECT symbol, date, {R(roll('avg', 'close', 20))} AS sma_20, {R(roll('avg', 'close', 50))} AS sma_50, {R(roll('avg', 'close', 200))} AS sma_200 FROM bars")
def moving_averages(spark: SparkSession, sf: str) -> DataFrame:
    out = features.moving_averages(daily_bars(spark, sf)).select("symbol", "date", "sma_20", "sma_50", "sma_200")
    return rounded(out, "sma_20", "sma_50", "sma_200")


@query(f"""WITH {BARS}, c AS (SELECT *, close - lag(close) {W} AS change FROM bars),
    g AS (SELECT symbol, date, {roll("avg", "CASE WHEN change IS NOT NULL THEN greatest(change, 0) END", 14)} AS gain, {roll("avg", "CASE WHEN change IS NOT NULL THEN greatest(-change, 0) END", 14)} AS loss FROM c)
    SELECT symbol, date, {R("CASE WHEN gain IS NULL OR loss IS NULL THEN NULL WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END")} AS rsi FROM g""")
def rsi(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.rsi(daily_bars(spark, sf)).select("symbol", "date", "rsi"), "rsi")


@query(f"""WITH {BARS}, t AS (SELECT *, greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})) AS tr FROM bars)
    SELECT symbol, date, {R("tr")} AS true_range, {R(roll("avg", "tr", 14))} AS atr FROM t""")
def atr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.atr(daily_bars(spark, sf)).select("symbol", "date", "true_range", "atr"), "true_range", "atr")


_CUM = "OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"


@query(f"""WITH {BARS}, v AS (SELECT symbol, date, close, sum((high + low + close) / 3 * volume) {_CUM} / sum(volume) {_CUM} AS vwap FROM bars)
    SELECT symbol, date, {R("vwap")} AS vwap, {R("(close - vwap) / vwap")} AS vwap_deviation FROM v""")
def vwap(spark: SparkSession, sf: str) -> DataFrame:
    out = features.vwap(daily_bars(spark, sf)).select("symbol", "date", "vwap", "vwap_deviation")
    return rounded(out, "vwap", "vwap_deviation")


@query(f"""WITH {BARS}, s AS (SELECT *, coalesce(sign(close - lag(close) {W}) * volume, volume) AS sv FROM bars) SELECT symbol, date, CAST(sum(sv) {_CUM} AS DOUBLE) AS obv FROM s""")
def obv(spark: SparkSession, sf: str) -> DataFrame:
    return features.obv(daily_bars(spark, sf)).select("symbol", "date", "obv")


@query(f"WITH {BARS} SELECT symbol, date, " + ", ".join(f"{R(f'close / lag(close, {n}) {W} - 1')} AS momentum_{n}" for n in (5, 10, 20)) + " FROM bars")
def momentum(spark: SparkSession, sf: str) -> DataFrame:
    names = ["momentum_5", "momentum_10", "momentum_20"]
    return rounded(features.momentum(daily_bars(spark, sf)).select("symbol", "date", *names), *names)


@query(f"""WITH RECURSIVE {BARS}, n AS (SELECT symbol, date, close, row_number() {W} AS i FROM bars),
    e AS (SELECT symbol, date, i, close, CAST(close AS DOUBLE) AS f, CAST(close AS DOUBLE) AS s, CAST(0 AS DOUBLE) AS g FROM n WHERE i = 1
        UNION ALL SELECT n.symbol, n.date, n.i, n.close, e.f + (n.close - e.f) * 2 / 13, e.s + (n.close - e.s) * 2 / 27,
            e.g + ((e.f + (n.close - e.f) * 2 / 13) - (e.s + (n.close - e.s) * 2 / 27) - e.g) * 2 / 10 FROM n JOIN e ON n.symbol = e.symbol AND n.i = e.i + 1)
    SELECT symbol, date, {R("f", 2)} AS ema_12, {R("s", 2)} AS ema_26, {R("f - s", 2)} AS macd, {R("g", 2)} AS macd_signal, {R("f - s - g", 2)} AS macd_histogram FROM e""")
def macd(spark: SparkSession, sf: str) -> DataFrame:
    names = ["ema_12", "ema_26", "macd", "macd_signal", "macd_histogram"]
    return rounded(features.macd(daily_bars(spark, sf)).select("symbol", "date", *names), *names, digits=2)


@query(f"""WITH {BARS}, c AS (SELECT *, close / lag(close) {W} - 1 AS change, close / lag(close, 5) {W} - 1 AS moved, row_number() {W} AS i FROM bars),
    w AS (SELECT a.symbol, a.date, a.moved, sum(power(1 - 2.0 / 21, a.i - b.i)) AS w1, sum(power(1 - 2.0 / 21, 2 * (a.i - b.i))) AS w2, sum(power(1 - 2.0 / 21, a.i - b.i) * b.change) / sum(power(1 - 2.0 / 21, a.i - b.i)) AS m, a.i
        FROM c a JOIN c b ON a.symbol = b.symbol AND b.i <= a.i AND b.change IS NOT NULL GROUP BY ALL),
    v AS (SELECT w.symbol, w.date, w.moved, sqrt(any_value(w1) * any_value(w1) / (any_value(w1) * any_value(w1) - any_value(w2)) * sum(power(1 - 2.0 / 21, w.i - b.i) * power(b.change - m, 2)) / any_value(w1)) AS sd, count(*) AS n
        FROM w JOIN c b ON w.symbol = b.symbol AND b.i <= w.i AND b.change IS NOT NULL GROUP BY w.symbol, w.date, w.moved)
    SELECT c.symbol, c.date, {R("CASE WHEN n > 1 THEN sd END", 5)} AS ewm_vol, {R("CASE WHEN n > 1 THEN c.moved / (sd * sqrt(5) + 1e-8) END", 4)} AS normalised_return FROM c LEFT JOIN v USING (symbol, date)""")
def volatility_normalised_returns(spark: SparkSession, sf: str) -> DataFrame:
    out = features.volatility_normalised_returns(daily_bars(spark, sf)).select("symbol", "date", "ewm_vol", "normalised_return")
    return rounded(rounded(out, "ewm_vol", digits=5), "normalised_return", digits=4)


_RV = f"""{HOURS}, hr AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS ret FROM hours),
    rv AS (SELECT symbol, date, sum(ret * ret) AS rv, sum(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END) AS rv_down, sum(CASE WHEN ret > 0 THEN ret * ret ELSE 0 END) AS rv_up FROM hr GROUP BY 1, 2)"""


@query(f"""WITH {_RV} SELECT symbol, date, {R("rv")} AS rv, {R("rv_down")} AS rv_down, {R("rv_up")} AS rv_up, {R(roll("avg", "rv", 5) + " * 252", 4)} AS rv_rolling,
    {R(roll("avg", "rv_down", 5) + " * 252", 4)} AS semi_rolling FROM rv""")
def realized_variance(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(features.realized_variance(hourly_bars(spark, sf)), "rv", "rv_down", "rv_up")
    return rounded(out, "rv_rolling", "semi_rolling", digits=4)


@query(f"""WITH {TICKS}, d AS (SELECT symbol, CAST(ts AS DATE) AS date, sum(ask_volume - bid_volume) AS delta FROM ticks GROUP BY 1, 2)
    SELECT symbol, date, {R("delta", 2)} AS delta, {R(roll("sum", "delta", 5), 2)} AS delta_rolling, {R(f"sum(delta) {_CUM}", 2)} AS delta_total FROM d""")
def cumulative_delta(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.cumulative_delta(ticks(spark, sf)), "delta", "delta_rolling", "delta_total", digits=2)


@query(f"""WITH {_RV}, m AS (SELECT *, {roll("avg", "rv", 1)} AS m1, {roll("avg", "rv", 5)} AS m5, {roll("avg", "rv", 22)} AS m22 FROM rv)
    SELECT symbol, date, {R(f"lag(m1) {W}")} AS rv_1, {R(f"lag(m5) {W}")} AS rv_5, {R(f"lag(m22) {W}")} AS rv_22, {R(f"lead(rv) {W}")} AS target FROM m""")
def har_features(spark: SparkSession, sf: str) -> DataFrame:
    rv = features.realized_variance(hourly_bars(spark, sf)).select("symbol", "date", "rv")
    return rounded(features.har_features(rv).drop("rv"), "rv_1", "rv_5", "rv_22", "target")


@query(f"""WITH {_RV} SELECT symbol, date, {R("sum(ret * ret)")} AS opening_rv, {R("sum(CASE WHEN ret > 0 THEN ret * ret END)")} AS opening_up, {R("sum(CASE WHEN ret < 0 THEN ret * ret END)")} AS opening_down
    FROM hr WHERE hour BETWEEN 9 AND 10 GROUP BY 1, 2""")
def opening_volatility(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.opening_volatility(hourly_bars(spark, sf)), "opening_rv", "opening_up", "opening_down")


@query(f"""WITH {BARS}, h AS (SELECT symbol, date, close, {roll("max", "high", 20)} AS high_20, {roll("min", "low", 20)} AS low_20 FROM bars)
    SELECT symbol, date, high_20, low_20, {R("(close - low_20) / nullif(high_20 - low_20, 0)")} AS place_20 FROM h""")
def market_structure(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.market_structure(daily_bars(spark, sf), (20,)).select("symbol", "date", "high_20", "low_20", "place_20"), "place_20")


@query(f"""WITH {HOURS}, w AS (SELECT *, max(CASE WHEN hour BETWEEN 9 AND 11 THEN high END) OVER d AS range_high, min(CASE WHEN hour BETWEEN 9 AND 11 THEN low END) OVER d AS range_low FROM hours WINDOW d AS (PARTITION BY symbol, date))
    SELECT symbol, ts, range_high, range_low, CASE WHEN close > range_high THEN 1 WHEN close < range_low THEN -1 ELSE 0 END AS signal FROM w""")
def range_breakout(spark: SparkSession, sf: str) -> DataFrame:
    return features.range_breakout(hourly_bars(spark, sf), 9, 11).select("symbol", "ts", "range_high", "range_low", "signal")


@query(f"""WITH {BARS}, q AS (SELECT symbol, date, close, {roll("quantile_cont({}, 0.25)", "close", 20, least=10)} AS lo, {roll("quantile_cont({}, 0.75)", "close", 20, least=10)} AS hi FROM bars)
    SELECT symbol, date, CASE WHEN lo IS NULL THEN NULL WHEN close <= lo THEN 0 WHEN close >= hi THEN 2 ELSE 1 END AS regime FROM q""")
def percentile_regime(spark: SparkSession, sf: str) -> DataFrame:
    return features.percentile_regime(daily_bars(spark, sf), "close", 20).select("symbol", "date", "regime")


@query(f"""WITH {BARS}, m AS (SELECT symbol, date, {roll("avg", "close", 10)} AS f, {roll("avg", "close", 30)} AS s FROM bars)
    SELECT symbol, date, CASE WHEN f - s IS NULL THEN NULL WHEN f - s > 0.005 * abs(s) THEN 1 WHEN f - s < -0.005 * abs(s) THEN -1 ELSE 0 END AS trend_regime FROM m""")
def trend_regime(spark: SparkSession, sf: str) -> DataFrame:
    return features.trend_regime(daily_bars(spark, sf)).select("symbol", "date", "trend_regime")


@query(f"""WITH {RETURNS}, k AS (SELECT symbol, date, CASE WHEN ret IS NOT NULL THEN row_number() OVER (PARTITION BY symbol ORDER BY abs(ret) NULLS LAST, date) / count(ret) OVER (PARTITION BY symbol) END AS p FROM rets)
    SELECT symbol, date, {R("p")} AS rank_pct, CASE WHEN p IS NULL THEN NULL WHEN p <= 0.33 THEN -1 WHEN p > 0.67 THEN 1 ELSE 0 END AS volatility_regime FROM k""")
def volatility_regime(spark: SparkSession, sf: str) -> DataFrame:
    x = features.returns(daily_bars(spark, sf)).withColumn("size", F.abs("ret"))
    return rounded(features.volatility_regime(x, "size").select("symbol", "date", "rank_pct", "volatility_regime"), "rank_pct")


@query(f"""WITH {POSITIONS}, n AS (SELECT symbol, week, CAST(longs - shorts AS DOUBLE) AS net FROM cot),
    z AS (SELECT symbol, week, (net - {roll("avg", "net", 26, "week")}) / nullif({roll("stddev_pop", "net", 26, "week")}, 0) AS z,
        26 * net - {roll("sum", "net", 26, "week")} AS away, {roll("sum", "net", 26, "week")} AS s, {roll("sum", "net * net", 26, "week")} AS q FROM n)
    SELECT symbol, week, {R("z")} AS crowding_z, CASE WHEN z IS NULL THEN NULL WHEN away * away <= 26 * q - s * s THEN 0 WHEN away > 0 THEN 1 ELSE -1 END AS crowding_regime FROM z""")
def crowding_regime(spark: SparkSession, sf: str) -> DataFrame:
    c = positioning(spark, sf).withColumn("net", F.col("longs") - F.col("shorts"))
    return rounded(features.crowding_regime(c, "net").select("symbol", "week", "crowding_z", "crowding_regime"), "crowding_z")


_WK = "OVER (PARTITION BY symbol ORDER BY week)"


@query(f"""WITH {POSITIONS}, n AS (SELECT *, longs - shorts AS net FROM cot), f AS (SELECT *, net - lag(net, 8) {_WK} AS flow_8, net - lag(net, 13) {_WK} AS flow_13,
        100 * (net - {roll("min", "net", 52, "week")}) / ({roll("max", "net", 52, "week")} - {roll("min", "net", 52, "week")} + 1e-8) AS i FROM n)
    SELECT symbol, week, net, {R("net / open_interest")} AS net_share, {R("spreads / open_interest")} AS spread_share, {R("longs / nullif(shorts, 0)")} AS long_short, flow_8, flow_13,
           flow_8 - lag(flow_8, 4) {_WK} AS flow_8_momentum, flow_13 - lag(flow_13, 6) {_WK} AS flow_13_momentum, {R("i", 4)} AS cot_index,
           CASE WHEN i >= 85 THEN 1 WHEN i <= 15 THEN -1 WHEN i IS NOT NULL THEN 0 END AS extreme FROM f""")
def cot_features(spark: SparkSession, sf: str) -> DataFrame:
    out = features.cot_features(positioning(spark, sf)).drop("longs", "shorts", "spreads", "open_interest")
    return rounded(rounded(out, "net_share", "spread_share", "long_short"), "cot_index", digits=4)


@query(f"""WITH {RETURNS} SELECT symbol, date, {R(roll("avg", "ret", 10))} AS roll_mean, {R(roll("stddev", "ret", 10))} AS roll_std, {R(roll("min", "ret", 10))} AS roll_min, {R(roll("max", "ret", 10))} AS roll_max,
    {R(roll("sum", "ret", 10))} AS roll_sum, {R(roll("quantile_cont({}, 0.5)", "ret", 10))} AS roll_median, {R(f"CASE WHEN count(ret) {_CUM} >= 10 THEN avg(ret) {_CUM} END")} AS expanding_mean FROM rets""")
def rolling_stats(spark: SparkSession, sf: str) -> DataFrame:
    names = ["roll_mean", "roll_std", "roll_min", "roll_max", "roll_sum", "roll_median", "expanding_mean"]
    return rounded(features.rolling_stats(features.returns(daily_bars(spark, sf)), "ret", 10).select("symbol", "date", *names), *names)


@query(f"""WITH {RETURNS}, p AS (SELECT symbol, ret, lag(ret, 5) {W} AS b FROM rets) SELECT symbol, count(*) AS n, {R("corr(ret, b)")} AS autocorrelation FROM p WHERE ret IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.autocorrelation(features.returns(daily_bars(spark, sf)), "ret", 5), "autocorrelation")


@query(f"""WITH {RETURNS} SELECT symbol, count(ret) AS n, {R("avg(ret)")} AS mean, {R("stddev(ret)")} AS std, {R("skewness(ret)")} AS skew, {R("avg(ret) / (stddev(ret) / sqrt(count(ret)))")} AS t_stat,
    {R("quantile_cont(ret, 0.05)")} AS q05, {R("quantile_cont(ret, 0.95)")} AS q95 FROM rets GROUP BY 1""")
def group_statistics(spark: SparkSession, sf: str) -> DataFrame:
    x = features.returns(daily_bars(spark, sf))
    out = x.groupBy("symbol").agg(
        F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev("ret").alias("std"), numeric.corrected_skew("ret").alias("skew"), numeric.t_stat("ret").alias("t_stat"),
        F.percentile("ret", F.lit(0.05)).alias("q05"), F.percentile("ret", F.lit(0.95)).alias("q95"),
    )
    return rounded(out, "mean", "std", "skew", "t_stat", "q05", "q95")


@query(f"""WITH p AS (SELECT event_type, event_id, 1 / (1 + abs(value)) AS p FROM events), k AS (SELECT *, row_number() OVER w AS rk, count(*) OVER (PARTITION BY event_type) AS m FROM p WINDOW w AS (PARTITION BY event_type ORDER BY p, event_id))
    SELECT event_type, event_id, {R("least(1.0, min(p * m / rk) OVER (PARTITION BY event_type ORDER BY p, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")} AS q_value FROM k""")
def fdr_bh(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "event_id", (1 / (1 + F.abs("value"))).alias("p"))
    return rounded(numeric.fdr(e, "p", ["event_type"], ["event_id"]).select("event_type", "event_id", "q_value"), "q_value")


@query(f"""WITH {RETURNS}, x AS (SELECT *, row_number() {W} AS i FROM rets), a AS (SELECT a.symbol, a.date, a.ret AS own, a.i, b.ret, CASE WHEN b.i = 2 THEN 1 ELSE 1 - power(0.5, 0.1) END * power(power(0.5, 0.1), a.i - b.i) AS w FROM x a JOIN x b ON a.symbol = b.symbol AND b.i <= a.i AND b.ret IS NOT NULL),
    m AS (SELECT symbol, date, sum(w * ret) AS mean, sum(w * w) AS w2, count(*) AS n FROM a GROUP BY 1, 2),
    v AS (SELECT a.symbol, a.date, CASE WHEN any_value(n) >= 5 THEN sqrt(sum(w * power(ret - mean, 2)) / (1 - any_value(w2))) END AS vol FROM a JOIN m USING (symbol, date) GROUP BY 1, 2)
    SELECT x.symbol, x.date, {R("vol")} AS ewma_vol, {R(f"ret / greatest(lag(vol) OVER (PARTITION BY x.symbol ORDER BY x.date), 0.0001)", 4)} AS weighted FROM x LEFT JOIN v USING (symbol, date)""")
def ewma_volatility(spark: SparkSession, sf: str) -> DataFrame:
    out = features.volatility_weighted(features.returns(daily_bars(spark, sf))).select("symbol", "date", "ewma_vol", "weighted")
    return rounded(rounded(out, "ewma_vol"), "weighted", digits=4)


@query(f"""WITH RECURSIVE {BARS}, n AS (SELECT symbol, date, close::DOUBLE AS x, row_number() {W} AS i FROM bars),
    k AS (SELECT symbol, date, i, x AS level, 1.001 - 1.001 / 1.101 * 1.001 AS p FROM n WHERE i = 1
        UNION ALL SELECT n.symbol, n.date, n.i, k.level + (k.p + 0.001) / (k.p + 0.101) * (n.x - k.level), (k.p + 0.001) - (k.p + 0.001) / (k.p + 0.101) * (k.p + 0.001) FROM n JOIN k ON n.symbol = k.symbol AND n.i = k.i + 1)
    SELECT symbol, date, {R("level", 3)} AS filtered FROM k""")
def kalman_filter(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.kalman(daily_bars(spark, sf), "close").select("symbol", "date", "filtered"), "filtered", digits=3)
