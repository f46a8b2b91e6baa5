"""Queries: statistical screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features, screens
from tidemark.plans.registry import R, query, rounded
from tidemark.sources.tables import BARS, HOURS, daily_bars, hourly_bars, read

W = "OVER (PARTITION BY symbol ORDER BY date)"
_FLAGS = f"""{BARS}, p AS (SELECT *, ln(close / lag(close) {W}) AS ret, ln(lead(close) {W} / close) AS fwd_1, ln(lead(close, 3) {W} / close) AS fwd_3, ln(lead(close, 5) {W} / close) AS fwd_5,
    row_number() OVER (PARTITION BY symbol, date_trunc('month', date) ORDER BY date) AS month_pos, row_number() OVER (PARTITION BY symbol, date_trunc('month', date) ORDER BY date DESC) AS month_left,
    row_number() OVER (PARTITION BY symbol, date_trunc('quarter', date) ORDER BY date) AS quarter_pos, row_number() OVER (PARTITION BY symbol, date_trunc('quarter', date) ORDER BY date DESC) AS quarter_left FROM bars)"""
_EACH = " UNION ALL ".join(
    [f"SELECT symbol, '{side}_{unit}_{k}' AS flag, fwd_1, fwd_3, fwd_5 FROM p WHERE {unit}_{end} <= {k}" for unit in ("month", "quarter") for side, end in (("first", "pos"), ("last", "left")) for k in (1, 3, 5)]
    + ["SELECT symbol, 'first_week', fwd_1, fwd_3, fwd_5 FROM p WHERE month_pos <= 5", "SELECT symbol, 'last_week', fwd_1, fwd_3, fwd_5 FROM p WHERE month_left <= 5"]
)
T = "avg({0}) / (stddev({0}) / sqrt(count({0})))"


@query(f"WITH {_FLAGS} SELECT symbol, date, CAST(month_pos AS INTEGER) AS month_pos, CAST(month_left AS INTEGER) AS month_left, CAST(quarter_pos AS INTEGER) AS quarter_pos, month_left <= 3 AS last_month_3 FROM p")
def calendar_flags(spark: SparkSession, sf: str) -> DataFrame:
    return screens.calendar_flags(daily_bars(spark, sf)).select("symbol", "date", "month_pos", "month_left", "quarter_pos", "last_month_3")


@query(f"WITH {_FLAGS} SELECT symbol, date, {R('fwd_1')} AS fwd_1, {R('fwd_3')} AS fwd_3, {R('fwd_5')} AS fwd_5 FROM p")
def forward_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(screens.forward_returns(daily_bars(spark, sf)).select("symbol", "date", "fwd_1", "fwd_3", "fwd_5"), "fwd_1", "fwd_3", "fwd_5")


@query(f"""WITH {_FLAGS}, e AS ({_EACH}), l AS (SELECT symbol, flag, 1 AS horizon, fwd_1 AS ret FROM e UNION ALL SELECT symbol, flag, 3, fwd_3 FROM e UNION ALL SELECT symbol, flag, 5, fwd_5 FROM e)
    SELECT symbol, flag, horizon, count(ret) AS n, {R("avg(ret)")} AS mean, {R(T.format("ret"))} AS t_stat FROM l WHERE ret IS NOT NULL GROUP BY 1, 2, 3 HAVING count(ret) >= 10""")
def calendar_edges(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(screens.calendar_edges(daily_bars(spark, sf)), "mean", "t_stat")


@query()
def calendar_edges_tested(spark: SparkSession, sf: str) -> DataFrame:
    return screens.tested(screens.calendar_edges(daily_bars(spark, sf)), ["symbol"], ["flag", "horizon"])


_WEEKS = f"""{_FLAGS}, m AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month_start, sum(CASE WHEN month_pos <= 5 THEN ret END) AS first_week_ret, sum(CASE WHEN month_left <= 5 THEN ret END) AS last_week_ret FROM p GROUP BY 1, 2)"""
_MW = "OVER (PARTITION BY symbol ORDER BY month_start)"


@query(f"""WITH {_WEEKS}, l AS (SELECT *, lag(last_week_ret) {_MW} AS b1, lag(first_week_ret, 12) {_MW} AS f12, lag(last_week_ret, 12) {_MW} AS b12 FROM m),
    t AS (SELECT symbol, 'last_on_first' AS test, first_week_ret AS x, last_week_ret AS y FROM l UNION ALL SELECT symbol, 'first_on_last', b1, first_week_ret FROM l
          UNION ALL SELECT symbol, 'first_annual', f12, first_week_ret FROM l UNION ALL SELECT symbol, 'last_annual', b12, last_week_ret FROM l)
    SELECT symbol, test, count(*) AS n, {R("regr_slope(y, x)")} AS slope, {R("regr_r2(y, x)")} AS r2, {R("corr(x, y) * sqrt(count(*) - 2) / sqrt(1 - corr(x, y) * corr(x, y))", 4)} AS t_stat
    FROM t WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2""")
def calendar_lead_lag(spark: SparkSession, sf: str) -> DataFrame:
    out = screens.lead_lag(daily_bars(spark, sf)).drop("intercept")
    return rounded(rounded(out, "slope", "r2"), "t_stat", digits=4)


@query(f"""WITH {_FLAGS} SELECT symbol, CAST(isodow(date) - 1 AS INTEGER) AS weekday, count(ret) AS n, {R("avg(ret)")} AS mean, {R("stddev(ret)")} AS std, {R("avg(ret) / stddev(ret)")} AS sharpe, {R("skewness(ret)")} AS skew,
    {R("avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END)")} AS positive, {R(T.format("ret"))} AS t_stat FROM p WHERE ret IS NOT NULL GROUP BY 1, 2""")
def weekday_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(screens.weekday_statistics(daily_bars(spark, sf)), "mean", "std", "sharpe", "skew", "positive", "t_stat")


@query(f"""WITH {_FLAGS}, g AS (SELECT symbol, isodow(date) AS d, count(ret) AS gn, avg(ret) AS gm, var_pop(ret) AS gv FROM p WHERE ret IS NOT NULL GROUP BY 1, 2),
    t AS (SELECT symbol, CAST(sum(gn) AS BIGINT) AS n, count(*) AS k, sum(gn * gv) AS within, sum(gn * gm * gm) - sum(gn * gm) * sum(gn * gm) / sum(gn) AS between_ FROM g GROUP BY 1)
    SELECT symbol, n, k, {R("(between_ / (k - 1)) / (within / (n - k))", 5)} AS f_stat FROM t""")
def weekday_anova(spark: SparkSession, sf: str) -> DataFrame:
    x = features.returns(daily_bars(spark, sf)).withColumn("d", F.weekday("date"))
    return rounded(screens.anova(x, ["symbol"], "d", "ret"), "f_stat", digits=5)


@query()
def weekday_anova_tested(spark: SparkSession, sf: str) -> DataFrame:
    x = features.returns(daily_bars(spark, sf)).withColumn("d", F.weekday("date"))
    return screens.anova_tested(screens.anova(x, ["symbol"], "d", "ret"))


_SESSION = f"""{HOURS}, s AS (SELECT symbol, date, arg_min(open, ts) AS fo, arg_max(close, ts) AS lc, arg_max(close, ts) FILTER (hour < 9) AS oc, arg_min(open, ts) FILTER (hour > 14) AS co FROM hours WHERE hour BETWEEN 8 AND 15 GROUP BY 1, 2),
    sess AS (SELECT symbol, date, ln(oc / fo) AS opening_ret, ln(lc / co) AS closing_ret, ln(lc / fo) AS full_ret FROM s),
    mom AS (SELECT *, full_ret - closing_ret AS rest_ret, CASE WHEN count(full_ret) OVER w = 5 THEN sum(full_ret) OVER w END AS st_momentum FROM sess WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""


def _sessions(spark, sf):
    return screens.session_returns(hourly_bars(spark, sf), 8, 15)


@query(f"WITH {_SESSION} SELECT symbol, date, {R('opening_ret')} AS opening_ret, {R('closing_ret')} AS closing_ret, {R('full_ret')} AS full_ret, {R('st_momentum')} AS st_momentum FROM mom")
def session_momentum(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_sessions(spark, sf).drop("rest_ret"), "opening_ret", "closing_ret", "full_ret", "st_momentum")


@query(f"""WITH {_SESSION} SELECT symbol, count(*) AS n, {R("corr(opening_ret, closing_ret)", 5)} AS open_close, {R("corr(opening_ret, rest_ret)", 5)} AS open_rest, {R("corr(st_momentum, opening_ret)", 5)} AS momentum_open,
    {R("corr(st_momentum, closing_ret)", 5)} AS momentum_close, {R("corr(st_momentum, full_ret)", 5)} AS momentum_full FROM mom
    WHERE opening_ret IS NOT NULL AND closing_ret IS NOT NULL AND st_momentum IS NOT NULL AND full_ret IS NOT NULL GROUP BY 1 HAVING count(*) >= 10""")
def momentum_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(screens.momentum_correlations(_sessions(spark, sf)), "open_close", "open_rest", "momentum_open", "momentum_close", "momentum_full", digits=5)


@query(f"""WITH {_SESSION}, l AS (UNPIVOT (SELECT symbol, CAST(isodow(date) - 1 AS INTEGER) AS weekday, opening_ret, closing_ret, full_ret, st_momentum FROM mom) ON opening_ret, closing_ret, full_ret, st_momentum INTO NAME kind VALUE ret)
    SELECT symbol, weekday, kind, count(*) AS n, {R("avg(ret)")} AS mean, {R("stddev(ret)")} AS std FROM l GROUP BY 1, 2, 3""")
def momentum_by_weekday(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(screens.momentum_by_weekday(_sessions(spark, sf)).drop("skew", "t_stat"), "mean", "std")


@query(f"""WITH {_SESSION}, v AS (SELECT *, avg(abs(opening_ret)) OVER w AS open_vol, avg(abs(closing_ret)) OVER w AS close_vol FROM mom WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
    z AS (SELECT *, (open_vol - avg(open_vol) OVER (PARTITION BY symbol)) / nullif(stddev(open_vol) OVER (PARTITION BY symbol), 0) AS z FROM v)
    SELECT symbol, date, {R("open_vol")} AS open_vol, {R("close_vol")} AS close_vol, {R("z")} AS open_vol_z, coalesce(z > 2, false) AS high_vol, coalesce(z < -2, false) AS low_vol FROM z""")
def volatility_patterns(spark: SparkSession, sf: str) -> DataFrame:
    out = screens.volatility_patterns(_sessions(spark, sf)).select("symbol", "date", "open_vol", "close_vol", "open_vol_z", "high_vol", "low_vol")
    return rounded(out, "open_vol", "close_vol", "open_vol_z")


@query(f"""WITH {HOURS}, g AS (SELECT symbol, hour, avg(volume) AS mv, count(*) AS n FROM hours GROUP BY 1, 2), e AS (SELECT symbol, quantile_cont(mv, 0.8) AS edge FROM g GROUP BY 1)
    SELECT symbol, hour, {R("mv")} AS mean_volume, n, {R("(mv - avg(mv) OVER w) / stddev(mv) OVER w", 5)} AS z, CAST(row_number() OVER (PARTITION BY symbol ORDER BY mv DESC, hour) AS INTEGER) AS rank, mv >= edge AS busy,
           row_number() OVER (PARTITION BY symbol ORDER BY mv DESC, hour) <= 3 AS top FROM g JOIN e USING (symbol) WINDOW w AS (PARTITION BY symbol)""")
def volume_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(screens.volume_profile(hourly_bars(spark, sf)), "mean_volume"), "z", digits=5)


_HR = f"{HOURS}, r AS (SELECT symbol, hour, date, ts, close, volume, ln(close / open) AS ret FROM hours)"


@query(f"""WITH {_HR}, lc AS (SELECT symbol, date, arg_max(close, ts) AS dc FROM r GROUP BY 1, 2)
    SELECT a.symbol, a.hour, count(*) AS n, count(b.ret) AS n_next_day, {R("corr(a.ret, b.ret)", 5)} AS r_next_day, {R("corr(a.ret, c.ret)", 5)} AS r_next_week
    FROM r a JOIN lc USING (symbol, date) LEFT JOIN r b ON b.symbol = a.symbol AND b.hour = a.hour AND b.date = a.date + 1 LEFT JOIN r c ON c.symbol = a.symbol AND c.hour = a.hour AND c.date = a.date + 5
    GROUP BY 1, 2 HAVING count(*) >= 15""")
def time_predictability(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(screens.time_predictability(hourly_bars(spark, sf), ieee=True).drop("r_to_close", "mean", "n_next_week"), "r_next_day", "r_next_week", digits=5)


@query(f"""WITH {_HR} SELECT a.symbol, printf('%02d', a.hour) AS name_a, printf('%02d', b.hour) AS name_b, count(*) AS n, {R("corr(a.ret, b.ret)", 5)} AS r FROM r a JOIN r b ON a.symbol = b.symbol AND a.date = b.date AND a.hour < b.hour
    GROUP BY 1, 2, 3 HAVING count(*) >= 15""")
def time_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(screens.time_matrix(hourly_bars(spark, sf)), "r", digits=5)


@query(f"""WITH {BARS}, x AS (SELECT symbol, date, ln(close / open) AS ret, lead(date) {W} AS nd, lead(ln(close / open)) {W} AS mret FROM bars)
    SELECT symbol, count(*) AS n, {R("corr(ret, mret)", 5)} AS r, {R("avg(CASE WHEN ret > 0 THEN mret END)")} AS after_gain, {R("avg(CASE WHEN ret < 0 THEN mret END)")} AS after_loss
    FROM x WHERE isodow(date) = 5 AND isodow(nd) = 1 AND nd - date = 3 AND ret IS NOT NULL AND mret IS NOT NULL GROUP BY 1 HAVING count(*) >= 5""")
def weekend_hedging(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(screens.weekend_hedging(daily_bars(spark, sf)).drop("t_stat"), "r", digits=5), "after_gain", "after_loss")


_MONTHLY = f"""{BARS}, mc AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month_start, arg_max(close, date) AS close FROM bars GROUP BY 1, 2),
    mr AS (SELECT *, ln(close / lag(close) {_MW}) AS ret, CAST(month(month_start) AS INTEGER) AS month FROM mc)"""


@query(f"""WITH {_MONTHLY}, o AS (SELECT symbol, avg(ret) AS overall FROM mr GROUP BY 1), g AS (SELECT symbol, month, count(ret) AS n, avg(ret) AS mean, stddev(ret) AS std, any_value(overall) AS overall FROM mr JOIN o USING (symbol) WHERE ret IS NOT NULL GROUP BY 1, 2)
    SELECT symbol, month, n, {R("mean")} AS mean, {R("std")} AS std, {R("(mean - overall) / (std / sqrt(n))", 5)} AS t_stat, {R("(mean - avg(mean) OVER w) / stddev(mean) OVER w", 5)} AS z FROM g WINDOW w AS (PARTITION BY symbol)""")
def abnormal_months(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(screens.abnormal_months(screens.monthly_returns(daily_bars(spark, sf))), "mean", "std"), "t_stat", "z", digits=5)


@query(f"""WITH {_MONTHLY}, x AS (SELECT symbol, month, ret, lag(ret) OVER (PARTITION BY symbol, month ORDER BY month_start) AS x FROM mr)
    SELECT symbol, month, count(*) AS n, {R("regr_slope(ret, x)", 5)} AS slope, {R("regr_r2(ret, x)", 5)} AS r2 FROM x WHERE x IS NOT NULL AND ret IS NOT NULL GROUP BY 1, 2""")
def last_year_predicts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(screens.last_year_predicts(screens.monthly_returns(daily_bars(spark, sf))).select("symbol", "month", "n", "slope", "r2"), "slope", "r2", digits=5)


@query(f"""WITH {_MONTHLY}, x AS (SELECT symbol, ret, k AS lag, CASE k WHEN 1 THEN lag(ret, 1) {_MW} WHEN 2 THEN lag(ret, 2) {_MW} ELSE lag(ret, 3) {_MW} END AS x FROM mr, (SELECT unnest([1, 2, 3]) AS k)),
    l1 AS (SELECT symbol, ret, lag(ret, 1) {_MW} AS x1, lag(ret, 2) {_MW} AS x2, lag(ret, 3) {_MW} AS x3 FROM mr),
    u AS (SELECT symbol, 1 AS lag, x1 AS x, ret FROM l1 UNION ALL SELECT symbol, 2, x2, ret FROM l1 UNION ALL SELECT symbol, 3, x3, ret FROM l1)
    SELECT symbol, lag, count(*) AS n, {R("regr_slope(ret, x)", 5)} AS slope, {R("regr_r2(ret, x)", 5)} AS r2 FROM u WHERE x IS NOT NULL AND ret IS NOT NULL GROUP BY 1, 2""")
def lag_month_predictability(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(screens.lag_months(screens.monthly_returns(daily_bars(spark, sf))).select("symbol", "lag", "n", "slope", "r2"), "slope", "r2", digits=5)


@query(f"""WITH {_MONTHLY}, d AS (SELECT symbol, date, ln(close / lag(close) {W}) AS ret FROM bars)
    SELECT m.symbol, m.month_start, m.month, {R("any_value(m.ret)")} AS month_ret, {R("sum(d.ret)")} AS window_ret, count(*) AS n_days FROM mr m JOIN d ON d.symbol = m.symbol AND d.date BETWEEN m.month_start - 90 AND m.month_start - 60
    WHERE d.ret IS NOT NULL GROUP BY 1, 2, 3""")
def prewindow(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(screens.prewindow(daily_bars(spark, sf)), "month_ret", "window_ret")


@query(f"""WITH {_MONTHLY} SELECT symbol, month_start, {R("ret - avg(ret) OVER (PARTITION BY symbol, month)")} AS deseasonalised FROM mr""")
def deseasonalise(spark: SparkSession, sf: str) -> DataFrame:
    m = screens.monthly_returns(daily_bars(spark, sf))
    return rounded(screens.deseasonalise(m, "ret", "month_start").select("symbol", "month_start", "deseasonalised"), "deseasonalised")


@query(f"""WITH {_HR}, s AS (SELECT symbol, date, hour, CASE WHEN count(ret) OVER w = 2 THEN sum(ret) OVER w END AS sr FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))
    SELECT a.symbol, count(*) AS n, {R("corr(a.sr, b.sr)", 5)} AS r FROM s a JOIN s b USING (symbol, date) WHERE a.hour = 9 AND b.hour = 14 AND a.sr IS NOT NULL AND b.sr IS NOT NULL GROUP BY 1 HAVING count(*) >= 10""")
def intraday_between_times(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(screens.between_times(hourly_bars(spark, sf), 9, 14), "r", digits=5)


def _releases(spark, sf):
    o = read(spark, sf, "events").where("event_type = 'signup'")
    return o.select(
        F.lit("click").alias("symbol"), F.concat(F.lit("E"), F.col("user_id") % 3).alias("event_code"), F.col("ts").alias("release_ts"), F.col("value").alias("actual"), F.lit(25.0).alias("consensus"), F.lit(10.0).alias("stdev")
    )


_EVENT = f"""{HOURS}, rel AS (SELECT 'click' AS symbol, 'E' || (user_id % 3) AS event_code, ts AS release_ts, value AS actual FROM events WHERE event_type = 'signup'),
    h AS (SELECT * FROM hours WHERE symbol = 'click'), day AS (SELECT date, arg_max(close, ts) AS t0 FROM h GROUP BY 1), day2 AS (SELECT *, lead(t0) OVER (ORDER BY date) AS t1 FROM day),
    pre AS (SELECT r.release_ts, h.close AS pre FROM rel r ASOF LEFT JOIN h ON r.release_ts - INTERVAL 1 HOUR >= h.ts), post AS (SELECT r.release_ts, h.close AS post FROM rel r ASOF LEFT JOIN h ON r.release_ts + INTERVAL 1 HOUR >= h.ts),
    ev AS (SELECT r.event_code, r.release_ts, r.actual, ln(post / pre) AS r_event, ln(t0 / post) AS r_t0, ln(t1 / t0) AS r_t1, actual - 25 AS surprise FROM rel r JOIN pre USING (release_ts) JOIN post USING (release_ts) LEFT JOIN day2 ON CAST(r.release_ts AS DATE) = day2.date)"""


@query(f"WITH {_EVENT} SELECT event_code, release_ts, {R('r_event')} AS r_event, {R('r_t0')} AS r_t0, {R('r_t1')} AS r_t1, {R('surprise / 10')} AS surprise_z FROM ev")
def event_returns(spark: SparkSession, sf: str) -> DataFrame:
    out = screens.event_returns(hourly_bars(spark, sf), _releases(spark, sf)).select("event_code", "release_ts", "r_event", "r_t0", "r_t1", "surprise_z")
    return rounded(out, "r_event", "r_t0", "r_t1", "surprise_z")


@query(f"""WITH {_EVENT} SELECT 'click' AS symbol, event_code, count(r_event) AS n, {R("avg(r_event)")} AS mean_event, {R(T.format("r_event"), 5)} AS t_stat, {R("avg(r_t0)")} AS mean_t0, {R("avg(r_t1)")} AS mean_t1, {R("corr(surprise, r_event)", 5)} AS r_surprise,
    {R("corr(r_event, r_t0)", 5)} AS r_event_t0 FROM ev GROUP BY event_code HAVING count(r_event) >= 3""")
def event_screen(spark: SparkSession, sf: str) -> DataFrame:
    out = screens.event_summary(screens.event_returns(hourly_bars(spark, sf), _releases(spark, sf)))
    return rounded(rounded(out, "mean_event", "mean_t0", "mean_t1"), "t_stat", "r_surprise", "r_event_t0", digits=5)


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), r AS (SELECT * FROM (VALUES ('STORAGE', 3, NULL, '10:30'), ('WASDE', 4, 2, '12:00')) t(event_code, weekday, wom, clock))
    SELECT event_code, date, (date + CAST(clock || ':00' AS TIME)) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS release_ts FROM d JOIN r ON isodow(date) - 1 = weekday AND (wom IS NULL OR floor((day(date) - 1) / 7) + 1 = wom)""")
def event_calendar(spark: SparkSession, sf: str) -> DataFrame:
    dates = read(spark, sf, "orders").select(F.col("o_orderdate").alias("date"))
    return screens.event_calendar(dates, [("STORAGE", 3, None, "10:30"), ("WASDE", 4, 2, "12:00")])


@query(f"""WITH {HOURS}, x AS (SELECT symbol, date, hour, volume / sum(volume) OVER (PARTITION BY symbol, date) AS s FROM hours), e AS (SELECT symbol, date, quantile_cont(s, 0.01) AS lo, quantile_cont(s, 0.99) AS hi FROM x GROUP BY 1, 2),
    c AS (SELECT symbol, hour, greatest(lo, least(hi, s)) AS s FROM x JOIN e USING (symbol, date)), g AS (SELECT symbol, hour, avg(s) AS m, quantile_cont(s, 0.5) AS q, count(*) AS n FROM c GROUP BY 1, 2)
    SELECT symbol, hour, {R("m")} AS mean_share, {R("q")} AS median_share, n, row_number() OVER (PARTITION BY symbol ORDER BY m DESC, hour) = 1 AS peak, row_number() OVER (PARTITION BY symbol ORDER BY m, hour) = 1 AS trough FROM g""")
def liquidity_share(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(screens.liquidity_share(hourly_bars(spark, sf)), "mean_share", "median_share")


@query(f"""WITH {BARS}, o AS (SELECT symbol, avg(volume) AS overall FROM bars GROUP BY 1), u AS (SELECT symbol, volume, 'month' AS bucket, CAST(month(date) AS INTEGER) AS value FROM bars UNION ALL SELECT symbol, volume, 'weekday', CAST(isodow(date) - 1 AS INTEGER) FROM bars)
    SELECT symbol, bucket, value, count(*) AS n, {R("avg(volume)")} AS mean, {R("(avg(volume) - any_value(overall)) / nullif(stddev(volume) / sqrt(count(*)), 0)", 5)} AS t_stat FROM u JOIN o USING (symbol) GROUP BY 1, 2, 3""")
def volume_seasonality(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(screens.volume_seasonality(daily_bars(spark, sf)), "mean"), "t_stat", digits=5)


@query(f"""WITH {HOURS}, r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS ret FROM hours),
    d AS (SELECT symbol, date, sum(ret * ret) AS rv, arg_max(close, ts) AS dc, sum(CASE WHEN hour = 9 THEN volume ELSE 0 END) / sum(volume) AS open_share, sum(CASE WHEN hour = 12 THEN volume ELSE 0 END) / sum(volume) AS lunch_share, sum(CASE WHEN hour = 15 THEN volume ELSE 0 END) / sum(volume) AS close_share FROM r GROUP BY 1, 2),
    n AS (SELECT *, ln(lead(dc) {W} / dc) AS nr FROM d), l AS (UNPIVOT n ON open_share, lunch_share, close_share INTO NAME feature VALUE share)
    SELECT symbol, feature, count(*) AS n, {R("corr(share, nr)", 5)} AS r_next, {R("corr(share, rv)", 5)} AS r_rv FROM l GROUP BY 1, 2""")
def volume_effects(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(screens.volume_effects(hourly_bars(spark, sf)), "r_next", "r_rv", digits=5)


@query()
def compression_screen(spark: SparkSession, sf: str) -> DataFrame:
    return screens.compression(daily_bars(spark, sf)).select("symbol", "date", "sd_ratio", "compressed", "run_length", "since", "hh", "ll", "direction", "trigger")


@query()
def session_first_hours(spark: SparkSession, sf: str) -> DataFrame:
    return screens.first_hours(hourly_bars(spark, sf))


@query()
def har_screen(spark: SparkSession, sf: str) -> DataFrame:
    rv = features.realized_variance(hourly_bars(spark, sf)).select("symbol", "date", "rv")
    return screens.har_scores(rv, first=4)
