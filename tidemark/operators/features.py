"""Technical, volatility, regime and positioning features over (symbol, time) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import by, corr, cumulative, ewm, ewms, expanding, finite, log_change, log_ratio, ratio, rolling, rolling_percentile, scan, zscore


def returns(bars: DataFrame, n: int = 1, order: str = "date", into: str = "ret", log: bool = True, ieee: bool = False) -> DataFrame:
    before = F.lag("close", n).over(by("symbol", order))
    return bars.withColumn(into, (log_change if ieee else log_ratio)("close", before) if log else ratio("close", before) - 1)


def moving_averages(bars: DataFrame, windows: tuple[int, ...] = (20, 50, 200), order: str = "date") -> DataFrame:
    w = by("symbol", order)
    return bars.withColumns({f"sma_{n}": rolling(F.avg, "close", w, n) for n in windows})


def rsi(bars: DataFrame, period: int = 14, order: str = "date") -> DataFrame:
    """Relative strength index from simple means of gains and losses; 100 without losses."""
    w = by("symbol", order)
    moved = bars.withColumn("change", F.col("close") - F.lag("close").over(w))
    gain = rolling(F.avg, F.greatest("change", F.lit(0.0)), w, period)
    loss = rolling(F.avg, F.greatest(-F.col("change"), F.lit(0.0)), w, period)
    gain = F.when(F.count("change").over(w.rowsBetween(-(period - 1), 0)) >= period, gain)
    value = F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))
    return moved.withColumn("rsi", F.when(gain.isNotNull() & loss.isNotNull(), value)).drop("change")


def true_range(order: str = "date") -> Column:
    before = F.lag("close").over(by("symbol", order))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(bars: DataFrame, period: int = 14, order: str = "date", method: str = "sma") -> DataFrame:
    """Mean true range: simple, or Wilder's recursive mean (alpha 1/period)."""
    ranged = bars.withColumn("true_range", true_range(order))
    if method == "wilder":
        return ewm(ranged, "true_range", ["symbol"], [order], 1 / period, "atr", least=period)
    return ranged.withColumn("atr", rolling(F.avg, "true_range", by("symbol", order), period))


def vwap(bars: DataFrame, order: str = "date") -> DataFrame:
    """Cumulative volume-weighted typical price and the close's distance from it."""
    w = by("symbol", order)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    value = ratio(cumulative(typical * F.col("volume"), w), cumulative("volume", w))
    return bars.withColumn("vwap", value).withColumn("vwap_deviation", ratio(F.col("close") - F.col("vwap"), "vwap"))


def obv(bars: DataFrame, order: str = "date", seeded: bool = True) -> DataFrame:
    """On-balance volume, seeded with the first volume or with zero."""
    w = by("symbol", order)
    signed = F.signum(F.col("close") - F.lag("close").over(w)) * F.col("volume")
    first = F.col("volume").cast("double") if seeded else F.lit(0.0)
    return bars.withColumn("signed_volume", F.coalesce(signed, first)).withColumn("obv", cumulative("signed_volume", w)).drop("signed_volume")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, order: str = "date") -> DataFrame:
    """EMA difference, its signal line and histogram; spans give alpha 2 / (span + 1)."""
    out = ewms(bars, {f"ema_{n}": ("close", 2 / (n + 1)) for n in (fast, slow)}, ["symbol"], [order])
    out = out.withColumn("macd", F.col(f"ema_{fast}") - F.col(f"ema_{slow}"))
    out = ewm(out, "macd", ["symbol"], [order], 2 / (signal + 1), "macd_signal")
    return out.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def momentum(bars: DataFrame, periods: tuple[int, ...] = (5, 10, 20), order: str = "date") -> DataFrame:
    w = by("symbol", order)
    return bars.withColumns({f"momentum_{n}": ratio("close", F.lag("close", n).over(w)) - 1 for n in periods})


def volatility_normalised_returns(bars: DataFrame, n: int = 5, span: int = 20, order: str = "date") -> DataFrame:
    """n-row change over the exponentially weighted deviation of daily changes times sqrt(n)."""
    out = returns(bars, 1, order, "change", log=False)
    out = ewm(out, "change", ["symbol"], [order], 2 / (span + 1), "ewm_vol", adjust=True, spread=True)
    change = ratio("close", F.lag("close", n).over(by("symbol", order))) - 1
    return out.withColumn("normalised_return", change / (F.col("ewm_vol") * F.sqrt(F.lit(float(n))) + 1e-8))


def realized_variance(intraday: DataFrame, window: int = 5, annualise: float = 252.0) -> DataFrame:
    """Daily sums of squared log returns and of the negative ones, with rolling annualised sums."""
    r2 = returns(intraday, 1, "ts").withColumn("date", F.to_date("ts"))
    daily = r2.groupBy("symbol", "date").agg(
        F.sum(F.col("ret") * F.col("ret")).alias("rv"),
        F.sum(F.when(F.col("ret") < 0, F.col("ret") * F.col("ret")).otherwise(0.0)).alias("rv_down"),
        F.sum(F.when(F.col("ret") > 0, F.col("ret") * F.col("ret")).otherwise(0.0)).alias("rv_up"),
    )
    w = by("symbol", "date")
    return daily.withColumn("rv_rolling", rolling(F.avg, "rv", w, window) * annualise).withColumn("semi_rolling", rolling(F.avg, "rv_down", w, window) * annualise)


def cumulative_delta(ticks: DataFrame, window: int = 5) -> DataFrame:
    """Daily ask minus bid volume and its rolling and running sums."""
    daily = ticks.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.sum(F.col("ask_volume") - F.col("bid_volume")).alias("delta"))
    w = by("symbol", "date")
    return daily.withColumn("delta_rolling", rolling(F.sum, "delta", w, window)).withColumn("delta_total", cumulative("delta", w))


def har_features(daily: DataFrame, value: str = "rv", horizons: tuple[int, ...] = (1, 5, 22), target: int = 1) -> DataFrame:
    """Means over past horizons, shifted by one row, and the mean of the next `target` rows."""
    w = by("symbol", "date")
    means = daily.withColumns({f"mean_{h}": rolling(F.avg, value, w, h) for h in horizons})
    out = means.withColumns({f"{value}_{h}": F.lag(f"mean_{h}").over(w) for h in horizons}).drop(*[f"mean_{h}" for h in horizons])
    ahead = w.rowsBetween(1, target)
    return out.withColumn("target", F.when(F.count(value).over(ahead) == target, F.avg(value).over(ahead)))


def opening_volatility(intraday: DataFrame, start: str = "09:00", hours: int = 2) -> DataFrame:
    """Realised variance of the session's opening hours and its halves by sign, null without returns of that sign."""
    h = int(start[:2])
    r2 = returns(intraday, 1, "ts").withColumn("date", F.to_date("ts")).where(F.hour("ts").between(h, h + hours - 1))
    sq = F.col("ret") * F.col("ret")
    return r2.groupBy("symbol", "date").agg(F.sum(sq).alias("opening_rv"), F.sum(F.when(F.col("ret") > 0, sq)).alias("opening_up"), F.sum(F.when(F.col("ret") < 0, sq)).alias("opening_down"))


def market_structure(bars: DataFrame, lookbacks: tuple[int, ...] = (5, 20), order: str = "date") -> DataFrame:
    """Rolling highs and lows and the close's place between them."""
    w = by("symbol", order)
    out = bars
    for n in lookbacks:
        hi, lo = rolling(F.max, "high", w, n), rolling(F.min, "low", w, n)
        out = out.withColumn(f"high_{n}", hi).withColumn(f"low_{n}", lo).withColumn(f"place_{n}", ratio(F.col("close") - F.col(f"low_{n}"), F.col(f"high_{n}") - F.col(f"low_{n}")))
    return out


def range_breakout(intraday: DataFrame, start_hour: int, end_hour: int) -> DataFrame:
    """High and low of a clock window spread over the day, and +1, -1 or 0 as a close is above, below or inside."""
    inside = F.col("hour").between(start_hour, end_hour)
    w = Window.partitionBy("symbol", "date")
    out = intraday.withColumn("range_high", F.max(F.when(inside, F.col("high"))).over(w)).withColumn("range_low", F.min(F.when(inside, F.col("low"))).over(w))
    return out.withColumn("signal", F.when(F.col("close") > F.col("range_high"), 1).when(F.col("close") < F.col("range_low"), -1).otherwise(0))


def percentile_regime(df: DataFrame, value: str, lookback: int, low: float = 0.25, high: float = 0.75, order: str = "date") -> DataFrame:
    """0, 1 or 2 as a value is under, between or over its rolling percentiles (from half the lookback on)."""
    w = by("symbol", order)
    lo, hi = (rolling_percentile(value, q, w, lookback, lookback // 2) for q in (low, high))
    return df.withColumn("low_band", lo).withColumn("high_band", hi).withColumn("regime", F.when(F.col("low_band").isNull(), None).when(F.col(value) <= F.col("low_band"), 0).when(F.col(value) >= F.col("high_band"), 2).otherwise(1))


def trend_regime(bars: DataFrame, fast: int = 10, slow: int = 30, band: float = 0.0, pct: float = 0.005, order: str = "date") -> DataFrame:
    """Sign of the fast less the slow mean, 0 within max(band, pct * |slow|)."""
    w = by("symbol", order)
    out = bars.withColumn("fast", rolling(F.avg, "close", w, fast)).withColumn("slow", rolling(F.avg, "close", w, slow))
    edge = F.greatest(F.lit(band), pct * F.abs("slow"))
    gap = F.col("fast") - F.col("slow")
    return out.withColumn("trend_regime", F.when(gap.isNull(), None).when(gap > edge, 1).when(gap < -edge, -1).otherwise(0))


def volatility_regime(df: DataFrame, value: str, low: float = 0.33, high: float = 0.67, order: str = "date") -> DataFrame:
    """Buckets -1, 0, 1 of the percent rank of a value among all of its symbol's, ties in order."""
    w = Window.partitionBy("symbol").orderBy(F.col(value).asc_nulls_last(), order)
    rank = F.when(F.col(value).isNotNull(), F.row_number().over(w) / F.count(value).over(Window.partitionBy("symbol")))
    return df.withColumn("rank_pct", rank).withColumn("volatility_regime", F.when(F.col("rank_pct").isNull(), None).when(F.col("rank_pct") <= low, -1).when(F.col("rank_pct") > high, 1).otherwise(0))


def crowding_regime(df: DataFrame, value: str, window: int = 26, band: float = 1.0, order: str = "week") -> DataFrame:
    """Sign of the rolling population z where it leaves the band.

    Whether it does is told from sums, (n x - S)^2 against band^2 (n Q - S^2), which are exact for whole numbers.
    """
    w = by("symbol", order)
    x = F.col(value).cast("double")
    total, squares = rolling(F.sum, x, w, window), rolling(F.sum, x * x, w, window)
    away = window * x - total
    outside = away * away > band * band * (window * squares - total * total)
    out = df.withColumn("crowding_z", zscore(value, w, window))
    return out.withColumn("crowding_regime", F.when(F.col("crowding_z").isNull(), None).when(outside & (away > 0), 1).when(outside & (away < 0), -1).otherwise(0))


def cot_index(df: DataFrame, value: str, window: int = 52, order: str = "week", into: str = "cot_index", least: int | None = None) -> DataFrame:
    """Place of a value in its rolling range, 0 to 100."""
    w = by("symbol", order)
    lo, hi = rolling(F.min, value, w, window, least), rolling(F.max, value, w, window, least)
    return df.withColumn(into, 100 * (F.col(value) - lo) / (hi - lo + 1e-8))


def cot_features(cot: DataFrame, window: int = 52, flows: tuple[int, ...] = (8, 13)) -> DataFrame:
    """Net position, shares of open interest, flows and their momentum, index, and extremes at 15 and 85."""
    w = by("symbol", "week")
    out = cot.withColumn("net", F.col("longs") - F.col("shorts"))
    out = out.withColumns({"net_share": ratio("net", "open_interest"), "spread_share": ratio("spreads", "open_interest"), "long_short": ratio("longs", "shorts")})
    for n in flows:
        out = out.withColumn(f"flow_{n}", F.col("net") - F.lag("net", n).over(w))
        out = out.withColumn(f"flow_{n}_momentum", F.col(f"flow_{n}") - F.lag(f"flow_{n}", n // 2).over(w))
    out = cot_index(out, "net", window)
    return out.withColumn("extreme", F.when(F.col("cot_index") >= 85, 1).when(F.col("cot_index") <= 15, -1).when(F.col("cot_index").isNotNull(), 0))


def normalise_columns(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Rename the first column found under each alias list, whatever its case and outer blanks."""
    have = {c.strip().lower(): c for c in df.columns}
    out = df
    for name, options in aliases.items():
        found = next((have[o.lower()] for o in options if o.lower() in have), None)
        if found and found != name:
            out = out.withColumnRenamed(found, name)
    return out


def ewma_volatility(df: DataFrame, value: str = "ret", halflife: float = 10.0, order: str = "date", least: int = 5, into: str = "ewma_vol") -> DataFrame:
    """Exponentially weighted deviation with a half-life in rows."""
    return ewm(df, value, ["symbol"], [order], 1 - 0.5 ** (1 / halflife), into, adjust=False, spread=True, least=least)


def volatility_weighted(df: DataFrame, value: str = "ret", halflife: float = 10.0, floor: float = 1e-4, target: float | None = None, order: str = "date") -> DataFrame:
    """Returns over their lagged volatility (at least the floor), scaled to a target if given."""
    out = ewma_volatility(df, value, halflife, order)
    before = F.greatest(F.lag("ewma_vol").over(by("symbol", order)), F.lit(floor))
    return out.withColumn("weighted", finite(F.col(value) / before * F.lit(1.0 if target is None else target)))


def rolling_stats(df: DataFrame, value: str, n: int, order: str = "date") -> DataFrame:
    """Mean, deviation, extremes, sum, median and z of the last n rows."""
    w = by("symbol", order)
    return df.withColumns(
        {
            "roll_mean": rolling(F.avg, value, w, n),
            "roll_std": rolling(F.stddev, value, w, n),
            "roll_min": rolling(F.min, value, w, n),
            "roll_max": rolling(F.max, value, w, n),
            "roll_sum": rolling(F.sum, value, w, n),
            "roll_median": rolling_percentile(value, 0.5, w, n),
            "roll_z": zscore(value, w, n, population=False),
            "expanding_mean": expanding(F.avg, value, w, n),
        }
    )


def autocorrelation(df: DataFrame, value: str, lag: int = 1, order: str = "date") -> DataFrame:
    """Lag correlation of each symbol's series."""
    placed = df.withColumn("before", F.lag(value, lag).over(by("symbol", order))).where(F.col(value).isNotNull() & F.col("before").isNotNull())
    return placed.groupBy("symbol").agg(F.count("*").alias("n"), corr(value, "before").alias("autocorrelation"))


def kalman(df: DataFrame, value: str, process: float = 1e-3, noise: float = 1e-1, order: str = "date") -> DataFrame:
    """One-dimensional local-level filter of each symbol, from its first number on; a null or NaN keeps the level."""

    def step(state, x):
        level, p = state
        known = x is not None and x == x
        if level is None and known:
            level = float(x)
        p += process
        if known:
            gain = p / (p + noise)
            level, p = level + gain * (x - level), (1 - gain) * p
        return (level, p if level is not None else 1.0), (level,)

    return scan(df, ["symbol"], [order], [value], lambda: (None, 1.0), step, "filtered double")


def positions_of(df: DataFrame, codes: list[str], start: str | None = None, end: str | None = None, code: str = "symbol", week: str = "week") -> DataFrame:
    """Rows of the codes, whatever their case and spaces around them, from `start` on and before `end`."""
    out = df.where(F.upper(F.trim(F.col(code))).isin([c.strip().upper() for c in codes]))
    out = out if start is None else out.where(F.col(week) >= F.lit(start).cast("date"))
    return out if end is None else out.where(F.col(week) < F.lit(end).cast("date"))
