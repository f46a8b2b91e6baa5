"""Statistical screens: calendar, seasonality, momentum, events, liquidity, compression, first hours, HAR.

Each screen is one plan over all symbols and returns a long table; statistics that need Student's t or F go through the
shared kernel, q values through numeric.fdr with the scope that the screen names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import by, corr, corr_ieee, corrected_skew, f_pvalue, fdr, log_change, log_ratio, ratio, rolling, rolling_percentile, t_of_r, t_pvalue, t_stat
from tidemark.operators.features import returns
from tidemark.operators.models import walk_forward
from tidemark.operators.relational import asof_join, pairs

FLAGS = [f"{side}_{unit}_{k}" for unit in ("month", "quarter") for side in ("first", "last") for k in (1, 3, 5)] + ["first_week", "last_week"]


def calendar_flags(bars: DataFrame, week_len: int = 5) -> DataFrame:
    """Trading-day positions from both ends of the month and quarter, and flags of the first and last k days and weeks."""
    out = bars
    for unit in ("month", "quarter"):
        key = F.date_trunc(unit, "date")
        up = Window.partitionBy("symbol", key).orderBy("date")
        down = Window.partitionBy("symbol", key).orderBy(F.col("date").desc())
        out = out.withColumn(f"{unit}_pos", F.row_number().over(up)).withColumn(f"{unit}_left", F.row_number().over(down))
        for k in (1, 3, 5):
            out = out.withColumn(f"first_{unit}_{k}", F.col(f"{unit}_pos") <= k).withColumn(f"last_{unit}_{k}", F.col(f"{unit}_left") <= k)
    return out.withColumn("first_week", F.col("month_pos") <= week_len).withColumn("last_week", F.col("month_left") <= week_len)


def forward_returns(bars: DataFrame, horizons: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    w = by("symbol", "date")
    return bars.withColumns({f"fwd_{h}": log_ratio(F.lead("close", h).over(w), "close") for h in horizons})


def calendar_edges(bars: DataFrame, horizons: tuple[int, ...] = (1, 3, 5), least: int = 10) -> DataFrame:
    """Mean forward return after each flag, with t; p and q (over a symbol's whole table) in calendar_edges_tested."""
    flagged = forward_returns(calendar_flags(bars), horizons)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("on")) for f in FLAGS])).alias("f")
    ahead = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("ret")) for h in horizons])).alias("h")
    long = flagged.select("symbol", each, *[f"fwd_{h}" for h in horizons]).where("f.on").select("symbol", "f.flag", ahead).select("symbol", "flag", "h.horizon", "h.ret")
    return long.where("ret IS NOT NULL").groupBy("symbol", "flag", "horizon").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), t_stat("ret").alias("t_stat")).where(F.col("n") >= least)


def tested(stats: DataFrame, scope: list[str], order: list[str], t: str = "t_stat", df: Column | None = None) -> DataFrame:
    """p by Student's t (n - 1 unless df is given) and q within the scope."""
    p = stats.withColumn("p_value", t_pvalue(t, (F.col("n") - 1 if df is None else df).cast("double")))
    return fdr(p, "p_value", scope, order)


def week_returns(bars: DataFrame, week_len: int = 5) -> DataFrame:
    """Log-return sums of the first and last trading week of each month, with their lags of one and twelve rows."""
    flagged = calendar_flags(returns(bars), week_len).withColumn("month_start", F.trunc("date", "month"))
    monthly = flagged.groupBy("symbol", "month_start").agg(F.sum(F.when(F.col("first_week"), F.col("ret"))).alias("first_week_ret"), F.sum(F.when(F.col("last_week"), F.col("ret"))).alias("last_week_ret"))
    w = by("symbol", "month_start")
    return monthly.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in ("first_week_ret", "last_week_ret") for k in (1, 12)})


def regression(df: DataFrame, keys: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Slope, intercept, r2, n and the slope's t of y on x; null below `least` complete rows."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = ok.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), corr(x, y).alias("r"))
    return g.withColumn("t_stat", F.when(F.col("n") >= least, t_of_r("r", "n"))).drop("r")


def lead_lag(bars: DataFrame) -> DataFrame:
    """Four tests: last week on this month's first week, first week on last month's last week, and both on their own twelfth lag."""
    m = week_returns(bars)
    tests = [("last_on_first", "first_week_ret", "last_week_ret"), ("first_on_last", "last_week_ret_lag1", "first_week_ret"), ("first_annual", "first_week_ret_lag12", "first_week_ret"), ("last_annual", "last_week_ret_lag12", "last_week_ret")]
    long = m.select("symbol", F.explode(F.array(*[F.struct(F.lit(n).alias("test"), F.col(x).alias("x"), F.col(y).alias("y")) for n, x, y in tests])).alias("t")).select("symbol", "t.*")
    return regression(long, ["symbol", "test"], "x", "y")


def weekday_statistics(bars: DataFrame, key: Column | None = None, name: str = "weekday", ieee: bool = False) -> DataFrame:
    """Of each weekday (or another key): n, mean, deviation, Sharpe, corrected skew, share of gains, t."""
    x = returns(bars, ieee=ieee).where("ret IS NOT NULL").withColumn(name, F.weekday("date") if key is None else key)
    return x.groupBy("symbol", name).agg(
        F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev("ret").alias("std"), ratio(F.avg("ret"), F.stddev("ret")).alias("sharpe"),
        corrected_skew("ret").alias("skew"), F.avg((F.col("ret") > 0).cast("double")).alias("positive"), t_stat("ret").alias("t_stat"),
    )


def anova(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """One-way F of a value between groups, from sums of squares; p through the shared kernel."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys, group).agg(F.count("*").alias("gn"), F.avg(value).alias("gm"), F.var_pop(value).alias("gv"))
    total = g.groupBy(*keys).agg(F.sum("gn").alias("n"), F.count("*").alias("k"), F.sum(F.col("gn") * F.col("gv")).alias("within"), F.sum(F.col("gn") * F.col("gm") * F.col("gm")).alias("sq"), F.sum(F.col("gn") * F.col("gm")).alias("sm"))
    between = F.col("sq") - F.col("sm") * F.col("sm") / F.col("n")
    f = ratio(between / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    return total.where("k > 1 AND n > k").select(*keys, "n", "k", f.alias("f_stat"))


def anova_tested(stats: DataFrame) -> DataFrame:
    return stats.withColumn("p_value", f_pvalue("f_stat", (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")))


def session_returns(intraday: DataFrame, open_hour: int, close_hour: int, edge_hours: int = 1, momentum_days: int = 5) -> DataFrame:
    """Opening, closing and full-session log returns a day, and the sum of the previous sessions' returns."""
    s = intraday.where(F.col("hour").between(open_hour, close_hour))
    g = s.groupBy("symbol", "date").agg(
        F.min_by("open", "ts").alias("first_open"), F.max_by("close", "ts").alias("last_close"),
        F.max_by(F.when(F.col("hour") < open_hour + edge_hours, F.col("close")), F.when(F.col("hour") < open_hour + edge_hours, F.col("ts"))).alias("opening_close"),
        F.min_by(F.when(F.col("hour") > close_hour - edge_hours, F.col("open")), F.when(F.col("hour") > close_hour - edge_hours, F.col("ts"))).alias("closing_open"),
    )
    out = g.select("symbol", "date", log_ratio("opening_close", "first_open").alias("opening_ret"), log_ratio("last_close", "closing_open").alias("closing_ret"), log_ratio("last_close", "first_open").alias("full_ret"))
    before = by("symbol", "date").rowsBetween(-momentum_days, -1)
    momentum = F.when(F.count("full_ret").over(before) == momentum_days, F.sum("full_ret").over(before))
    return out.withColumn("st_momentum", momentum).withColumn("rest_ret", F.col("full_ret") - F.col("closing_ret"))


def momentum_correlations(sessions: DataFrame, least: int = 10) -> DataFrame:
    """Five correlations of complete sessions by symbol."""
    ok = sessions.dropna(subset=["opening_ret", "closing_ret", "st_momentum", "full_ret"])
    tests = {"open_close": ("opening_ret", "closing_ret"), "open_rest": ("opening_ret", "rest_ret"), "momentum_open": ("st_momentum", "opening_ret"), "momentum_close": ("st_momentum", "closing_ret"), "momentum_full": ("st_momentum", "full_ret")}
    return ok.groupBy("symbol").agg(F.count("*").alias("n"), *[corr(x, y).alias(k) for k, (x, y) in tests.items()]).where(F.col("n") >= least)


def momentum_by_weekday(sessions: DataFrame) -> DataFrame:
    names = ["opening_ret", "closing_ret", "full_ret", "st_momentum"]
    long = sessions.withColumn("weekday", F.weekday("date")).unpivot(["symbol", "weekday"], names, "kind", "ret").where("ret IS NOT NULL")
    return long.groupBy("symbol", "weekday", "kind").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev("ret").alias("std"), corrected_skew("ret").alias("skew"), t_stat("ret").alias("t_stat"))


def volatility_patterns(sessions: DataFrame, window: int = 5) -> DataFrame:
    """Rolling mean of |return| at open and close, and days beyond two deviations of it."""
    w = by("symbol", "date")
    out = sessions.withColumn("open_vol", rolling(F.avg, F.abs("opening_ret"), w, window, 1)).withColumn("close_vol", rolling(F.avg, F.abs("closing_ret"), w, window, 1))
    whole = Window.partitionBy("symbol")
    z = ratio(F.col("open_vol") - F.avg("open_vol").over(whole), F.stddev("open_vol").over(whole))
    return out.withColumn("open_vol_z", z).withColumn("high_vol", F.coalesce(F.col("open_vol_z") > 2, F.lit(False))).withColumn("low_vol", F.coalesce(F.col("open_vol_z") < -2, F.lit(False)))


def volume_profile(intraday: DataFrame, top: int = 3) -> DataFrame:
    """Mean volume by hour, its z among hours, rank, and whether it is among the busiest fifth."""
    g = intraday.groupBy("symbol", "hour").agg(F.avg("volume").alias("mean_volume"), F.count("*").alias("n"))
    w = Window.partitionBy("symbol")
    edge = g.groupBy("symbol").agg(F.percentile("mean_volume", F.lit(0.8)).alias("edge"))
    out = g.withColumn("z", ratio(F.col("mean_volume") - F.avg("mean_volume").over(w), F.stddev("mean_volume").over(w))).withColumn("rank", F.row_number().over(w.orderBy(F.col("mean_volume").desc(), "hour")))
    return out.join(F.broadcast(edge), "symbol").withColumn("busy", F.col("mean_volume") >= F.col("edge")).withColumn("top", F.col("rank") <= top).drop("edge")


def time_predictability(intraday: DataFrame, least: int = 15, ieee: bool = False) -> DataFrame:
    """For each clock hour: correlation of its return with the next day's, the day five calendar days on, and the rest of the day."""
    change, r_of = (log_change, corr_ieee) if ieee else (log_ratio, corr)
    r = intraday.withColumn("ret", change("close", "open"))
    d = r.groupBy("symbol", "hour", "date").agg(F.sum("ret").alias("ret"))
    last = intraday.groupBy("symbol", "date").agg(F.max_by("close", "ts").alias("day_close"))
    here = intraday.select("symbol", "hour", "date", F.col("close").alias("hour_close")).join(last, ["symbol", "date"]).select("symbol", "hour", "date", change("day_close", "hour_close").alias("to_close"))
    out = d.join(here, ["symbol", "hour", "date"])
    for name, k in (("next_day", 1), ("next_week", 5)):
        later = d.select("symbol", "hour", F.date_sub("date", k).alias("date"), F.col("ret").alias(name))
        out = out.join(later, ["symbol", "hour", "date"], "left")
    return out.groupBy("symbol", "hour").agg(
        F.count("*").alias("n"), F.avg("ret").alias("mean"), F.count("next_day").alias("n_next_day"), F.count("next_week").alias("n_next_week"), r_of("ret", "next_day").alias("r_next_day"), r_of("ret", "next_week").alias("r_next_week"), r_of("ret", "to_close").alias("r_to_close")
    ).where(F.col("n") >= least)


def time_matrix(intraday: DataFrame, least: int = 15) -> DataFrame:
    """Pairwise correlations of hourly returns of the same day."""
    r = intraday.select("symbol", "date", F.format_string("%02d", "hour").alias("at"), log_ratio("close", "open").alias("ret"))
    a = r.select("symbol", "date", F.col("at").alias("name_a"), F.col("ret").alias("x")).where("x IS NOT NULL")
    b = r.select("symbol", "date", F.col("at").alias("name_b"), F.col("ret").alias("y")).where("y IS NOT NULL")
    g = a.join(b, ["symbol", "date"]).where("name_a < name_b").groupBy("symbol", "name_a", "name_b")
    return g.agg(F.count("*").alias("n"), corr("x", "y").alias("r")).where(F.col("n") >= least)


def weekend_hedging(bars: DataFrame, least: int = 5) -> DataFrame:
    """Friday's open-to-close return against the next session's if it is a Monday: correlation and conditional means."""
    day = bars.withColumn("ret", log_ratio("close", "open"))
    w = by("symbol", "date")
    x = day.withColumn("next_date", F.lead("date").over(w)).withColumn("monday_ret", F.lead("ret").over(w)).where((F.weekday("date") == 4) & (F.weekday("next_date") == 0) & (F.datediff("next_date", "date") == 3))
    g = x.where("ret IS NOT NULL AND monday_ret IS NOT NULL").groupBy("symbol")
    return g.agg(
        F.count("*").alias("n"), corr("ret", "monday_ret").alias("r"), F.avg(F.when(F.col("ret") > 0, F.col("monday_ret"))).alias("after_gain"), F.avg(F.when(F.col("ret") < 0, F.col("monday_ret"))).alias("after_loss")
    ).where(F.col("n") >= least).withColumn("t_stat", t_of_r("r", "n"))


def monthly_returns(bars: DataFrame) -> DataFrame:
    """Log change of the month's last close."""
    m = bars.groupBy("symbol", F.trunc("date", "month").alias("month_start")).agg(F.max_by("close", "date").alias("close"))
    return m.withColumn("ret", log_ratio("close", F.lag("close").over(by("symbol", "month_start")))).withColumn("month", F.month("month_start"))


def abnormal_months(monthly: DataFrame) -> DataFrame:
    """t of each calendar month's mean against the overall mean, and its z among months."""
    whole = monthly.groupBy("symbol").agg(F.avg("ret").alias("overall"))
    x = monthly.join(F.broadcast(whole), "symbol").where("ret IS NOT NULL")
    g = x.groupBy("symbol", "month").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev("ret").alias("std"), F.first("overall").alias("overall"))
    w = Window.partitionBy("symbol")
    return g.withColumn("t_stat", ratio(F.col("mean") - F.col("overall"), F.col("std") / F.sqrt("n"))).withColumn("z", ratio(F.col("mean") - F.avg("mean").over(w), F.stddev("mean").over(w))).drop("overall")


def last_year_predicts(monthly: DataFrame, least: int = 5) -> DataFrame:
    """Per calendar month, this year's return on last year's."""
    x = monthly.withColumn("x", F.lag("ret").over(by(["symbol", "month"], "month_start")))
    return regression(x, ["symbol", "month"], "x", "ret", least)


def lag_months(monthly: DataFrame, lags: int = 3) -> DataFrame:
    w = by("symbol", "month_start")
    lagged = monthly.withColumns({f"lag_{k}": F.lag("ret", k).over(w) for k in range(1, lags + 1)})
    long = lagged.select("symbol", "ret", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"lag_{k}").alias("x")) for k in range(1, lags + 1)])).alias("l"))
    return regression(long.select("symbol", "l.lag", "l.x", "ret"), ["symbol", "lag"], "x", "ret")


def prewindow(bars: DataFrame, start_days: int = 90, end_days: int = 60) -> DataFrame:
    """For each month, the sum of daily log returns from start_days to end_days before its first day, both ends in."""
    daily = returns(bars).where("ret IS NOT NULL").select("symbol", "date", "ret")
    m = monthly_returns(bars).select("symbol", "month_start", "month", F.col("ret").alias("month_ret"))
    spread = m.withColumn("date", F.explode(F.sequence(F.date_sub("month_start", start_days), F.date_sub("month_start", end_days))))
    return spread.join(daily, ["symbol", "date"]).groupBy("symbol", "month_start", "month", "month_ret").agg(F.sum("ret").alias("window_ret"), F.count("*").alias("n_days"))


def deseasonalise(df: DataFrame, value: str, date: str = "date") -> DataFrame:
    """A value less its symbol's mean of the calendar month."""
    return df.withColumn("deseasonalised", F.col(value) - F.avg(value).over(Window.partitionBy("symbol", F.month(date))))


def between_times(intraday: DataFrame, first_hour: int, second_hour: int, window: int = 2, least: int = 10) -> DataFrame:
    """Correlation of the summed returns of the `window` bars from two clock hours on, of the same day; incomplete windows are left out."""
    r = intraday.withColumn("ret", log_ratio("close", "open"))
    ahead = by("symbol", "ts").rowsBetween(0, window - 1)
    s = r.withColumn("sum_ret", F.when(F.count("ret").over(ahead) == window, F.sum("ret").over(ahead)))
    a = s.where(F.col("hour") == first_hour).select("symbol", "date", F.col("sum_ret").alias("x"))
    b = s.where(F.col("hour") == second_hour).select("symbol", "date", F.col("sum_ret").alias("y"))
    g = a.join(b, ["symbol", "date"]).where("x IS NOT NULL AND y IS NOT NULL").groupBy("symbol").agg(F.count("*").alias("n"), corr("x", "y").alias("r"))
    return g.where(F.col("n") >= least)


def event_returns(bars: DataFrame, events: DataFrame, pre_seconds: int = 3600, post_seconds: int = 3600) -> DataFrame:
    """Returns around releases: last bar at or before release - pre, last bar at or before release + post, that day's and the next session's close.

    events: symbol, event_code, release_ts, actual, consensus, stdev.
    """
    e = events.withColumn("event_row", F.xxhash64("symbol", "event_code", "release_ts"))
    px = bars.select("symbol", "ts", "close")
    for name, shift in (("pre_close", F.expr(f"INTERVAL -{pre_seconds} SECONDS")), ("post_close", F.expr(f"INTERVAL {post_seconds} SECONDS"))):
        e = asof_join(e.withColumn("ts", F.col("release_ts") + shift), px.withColumnRenamed("close", name), ["symbol"], "ts", [name]).drop("ts")
    day = bars.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.max_by("close", "ts").alias("close_t0"))
    day = day.withColumn("close_t1", F.lead("close_t0").over(by("symbol", "date")))
    out = e.withColumn("date", F.to_date("release_ts")).join(day, ["symbol", "date"], "left")
    surprise = F.col("actual") - F.col("consensus")
    return out.withColumns(
        {
            "r_event": log_ratio("post_close", "pre_close"),
            "r_t0": log_ratio("close_t0", "post_close"),
            "r_t1": log_ratio("close_t1", "close_t0"),
            "surprise": surprise,
            "surprise_pct": ratio(surprise, F.abs("consensus")),
            "surprise_z": ratio(surprise, "stdev"),
        }
    ).drop("event_row")


def event_summary(found: DataFrame, least: int = 3) -> DataFrame:
    """By symbol and event: n, means, t of the event return, and its correlation with the surprise and the return to the close."""
    return found.groupBy("symbol", "event_code").agg(
        F.count("r_event").alias("n"), F.avg("r_event").alias("mean_event"), t_stat("r_event").alias("t_stat"), F.avg("r_t0").alias("mean_t0"), F.avg("r_t1").alias("mean_t1"), corr("surprise", "r_event").alias("r_surprise"), corr("r_event", "r_t0").alias("r_event_t0")
    ).where(F.col("n") >= least)


def event_calendar(dates: DataFrame, definitions: list[tuple[str, int, int | None, str]], zone: str = "America/New_York") -> DataFrame:
    """release_ts (UTC) of recurring events (code, weekday, week of month or None for every week, clock in the zone) on the given dates."""
    rules = dates.sparkSession.createDataFrame(definitions, "event_code string, weekday int, wom int, clock string")
    d = dates.select(F.to_date("date").alias("date")).distinct()
    hit = (F.weekday("date") == F.col("weekday")) & (F.col("wom").isNull() | (F.floor((F.day("date") - 1) / 7) + 1 == F.col("wom")))
    local = F.to_timestamp_ntz(F.concat_ws(" ", F.col("date").cast("string"), F.concat("clock", F.lit(":00"))))
    return d.join(F.broadcast(rules), hit).select("event_code", "date", F.convert_timezone(F.lit(zone), F.lit("UTC"), local).alias("release_ts"))  # one row a rule


def liquidity_share(intraday: DataFrame, tail: float = 0.01) -> DataFrame:
    """Each hour's share of the day's volume, winsorised within the day, as mean, median and n by hour, with peak and trough."""
    x = intraday.withColumn("share", ratio("volume", F.sum("volume").over(Window.partitionBy("symbol", "date"))))
    edges = x.groupBy("symbol", "date").agg(F.percentile("share", F.lit(tail)).alias("lo"), F.percentile("share", F.lit(1 - tail)).alias("hi"))
    x = x.join(edges, ["symbol", "date"]).withColumn("share", F.greatest("lo", F.least("hi", "share")))
    g = x.groupBy("symbol", "hour").agg(F.avg("share").alias("mean_share"), F.percentile("share", F.lit(0.5)).alias("median_share"), F.count("*").alias("n"))
    w = Window.partitionBy("symbol")
    return g.withColumn("peak", F.row_number().over(w.orderBy(F.col("mean_share").desc(), "hour")) == 1).withColumn("trough", F.row_number().over(w.orderBy("mean_share", "hour")) == 1)


def volume_seasonality(bars: DataFrame) -> DataFrame:
    """t of mean volume by month and by weekday against the overall mean."""
    whole = bars.groupBy("symbol").agg(F.avg("volume").alias("overall"))
    each = F.explode(F.array(F.struct(F.lit("month").alias("bucket"), F.month("date").alias("value")), F.struct(F.lit("weekday").alias("bucket"), F.weekday("date").alias("value")))).alias("b")
    g = bars.join(F.broadcast(whole), "symbol").select("symbol", "volume", "overall", each).groupBy("symbol", "b.bucket", "b.value")
    return g.agg(F.count("*").alias("n"), F.avg("volume").alias("mean"), ratio(F.avg("volume") - F.first("overall"), F.stddev("volume") / F.sqrt(F.count("*"))).alias("t_stat"))


def volume_effects(intraday: DataFrame) -> DataFrame:
    """Correlation of the open's, lunch's and close's share of the day's volume with the next day's return and with realised variance."""
    r = returns(intraday, 1, "ts")
    hours = {"open_share": 9, "lunch_share": 12, "close_share": 15}
    d = r.groupBy("symbol", "date").agg(F.sum(F.col("ret") * F.col("ret")).alias("rv"), F.max_by("close", "ts").alias("day_close"), *[ratio(F.sum(F.when(F.col("hour") == h, F.col("volume")).otherwise(0.0)), F.sum("volume")).alias(n) for n, h in hours.items()])
    d = d.withColumn("next_ret", log_ratio(F.lead("day_close").over(by("symbol", "date")), "day_close"))
    long = d.unpivot(["symbol", "date", "rv", "next_ret"], list(hours), "feature", "share")
    return long.groupBy("symbol", "feature").agg(F.count("*").alias("n"), corr("share", "next_ret").alias("r_next"), corr("share", "rv").alias("r_rv"))


def compression(bars: DataFrame, short: int = 10, long: int = 50, threshold: float = 0.75, least: int = 3, channel: int = 20, expiry: int = 10) -> DataFrame:
    """Runs of compressed volatility (short over long deviation under the threshold) and the breakouts after them.

    run_length is the whole run's on each of its rows; a run of at least `least` rows is valid for `expiry` rows after
    its end; a close beyond the previous channel high or low then triggers, UP before DOWN, the first per run.
    """
    w = by("symbol", "date")
    x = returns(bars).withColumn("sd_ratio", ratio(rolling(F.stddev, "ret", w, short), rolling(F.stddev, "ret", w, long)))
    x = x.withColumn("compressed", F.coalesce(F.col("sd_ratio") < threshold, F.lit(False))).withColumn("row", F.row_number().over(w))
    change = (F.col("compressed") != F.coalesce(F.lag("compressed").over(w), F.lit(False))).cast("int")
    x = x.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("run_length", F.when(F.col("compressed"), F.count("*").over(Window.partitionBy("symbol", "run"))))
    ended = F.when(F.col("compressed") & (F.col("run_length") >= least), F.col("row"))
    x = x.withColumn("last_end", F.last(ended, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("last_run", F.last(F.when(ended.isNotNull(), F.col("run")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = w.rowsBetween(-channel, -1)
    x = x.withColumn("since", F.col("row") - F.col("last_end")).withColumn("hh", F.max("high").over(before)).withColumn("ll", F.min("low").over(before))
    live = (F.col("since") > 0) & (F.col("since") <= expiry)
    direction = F.when(live & (F.col("close") > F.col("hh")), "UP").when(live & (F.col("close") < F.col("ll")), "DOWN")
    x = x.withColumn("direction", direction)
    first = F.row_number().over(Window.partitionBy("symbol", "last_run", F.col("direction").isNotNull()).orderBy("date"))
    return x.withColumn("trigger", F.col("direction").isNotNull() & (first == 1)).drop("change", "run", "row", "last_run", "last_end")


def first_hours(intraday: DataFrame, open_hour: int = 8, hours: int = 2, least: int = 1, lookback: int = 10) -> DataFrame:
    """Open, close, volume, realised variance, normalised return and relative volume of each session's first hours.

    The relative volume divides by the sum over hours of the median volume of the same hour in the previous sessions.
    Ranks within a date are by relative volume, the smallest rank shared by ties.
    """
    f = returns(intraday, 1, "ts").where(F.col("hour").between(open_hour, open_hour + hours - 1))
    before = Window.partitionBy("symbol", "hour").orderBy("date").rowsBetween(-lookback, -1)
    f = f.withColumn("usual", F.percentile("volume", F.lit(0.5)).over(before))
    g = f.groupBy("symbol", "date").agg(F.count("*").alias("n_bars"), F.min_by("open", "ts").alias("open"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.sqrt(F.sum(F.col("ret") * F.col("ret"))).alias("rv"), F.sum("usual").alias("usual"))
    g = g.where(F.col("n_bars") >= least).withColumn("ret", log_ratio("close", "open"))
    w = by("symbol", "date")
    sd = F.lag(rolling(F.stddev, "ret", w, lookback, max(3, lookback // 2))).over(w)
    g = g.withColumn("sd", sd).withColumn("vol_norm", ratio("ret", "sd")).withColumn("relative_volume", ratio("volume", "usual"))
    return g.withColumn("rank", F.when(F.col("relative_volume").isNotNull(), F.rank().over(Window.partitionBy("date").orderBy(F.col("relative_volume").desc_nulls_last())))).drop("sd", "usual")


def har_scores(daily: DataFrame, first: int = 60, ridge: float = 1e-4, exogenous: tuple[str, ...] = ()) -> DataFrame:
    """Expanding log-HAR(1, 5, 22) one-step forecasts by symbol and their out-of-sample r2, QLIKE and score.

    daily: symbol, date, rv and the exogenous columns, whose values of the day before join the regression.  Each forecast
    is fitted on the rows before it, `first` at least; the score is the last forecast's z among all, discounted by r2
    and QLIKE.
    """
    w = by("symbol", "date")
    v = daily.withColumn("v", F.ln(F.greatest("rv", F.lit(1e-12)))).withColumn("nth", F.row_number().over(w))
    mean = lambda n: F.avg("v").over(w.rowsBetween(-n, -1))
    x = v.withColumns({"v1": mean(1), "v5": mean(5), "v22": mean(22), **{f"x_{c}": F.lag(c).over(w) for c in exogenous}}).where("nth > 22")
    made = walk_forward(x, ["v1", "v5", "v22", *[f"x_{c}" for c in exogenous]], "v", ["symbol"], "date", ridge=ridge, least=first, penalise_intercept=True)
    made = made.withColumns({"p": F.when(F.col("n_train") >= first, F.col("predicted")), "off": F.exp(F.col("v") - F.col("predicted"))})
    known = F.col("p").isNotNull() & F.col("v").isNotNull()
    q = lambda c: F.when(known, c)
    g = made.groupBy("symbol").agg(
        F.count(q(F.col("v"))).alias("n"),
        (1 - F.sum(q((F.col("v") - F.col("p")) ** 2)) / F.greatest(F.var_pop(q(F.col("v"))) * F.count(q(F.col("v"))), F.lit(1e-12))).alias("r2"),
        F.avg(q(F.col("off") - F.ln("off") - 1)).alias("qlike"),
        ((F.max_by("p", q(F.col("date"))) - F.avg(q(F.col("p")))) / F.greatest(F.stddev_pop(q(F.col("p"))), F.lit(1e-12))).alias("z"),
    )
    enough = F.col("n") >= 2
    score = F.col("z") * F.greatest("r2", F.lit(0.0)) / (1 + F.greatest("qlike", F.lit(0.0)))
    return g.select("symbol", "n", F.when(enough, F.col("r2")).alias("r2"), F.when(enough, F.col("qlike")).alias("qlike"), F.when(enough, score).alias("score"))


def correlation_matrix(sessions: DataFrame, value: str = "ret") -> DataFrame:
    return pairs(sessions, ["date"], "symbol", value)


def rolling_median_ratio(bars: DataFrame, n: int = 20) -> DataFrame:
    return bars.withColumn("ratio", ratio("volume", rolling_percentile("volume", 0.5, by("symbol", "date"), n)))
