"""Patterns, gates, horizons and backtests.

Gates are long (symbol, ts, pattern_key): a pattern is a row of a dimension table, and a bar matches by joins, so
thousands of patterns need no columns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import by, clip, fdr, log_change, log_ratio, ratio, sign, t_pvalue
from tidemark.operators.relational import nearest_join, shifted_join


def significance(n: str = "n", t: str = "t_stat", r: str = "correlation", p: str = "p_value", hit: str = "hit_rate", strength: str = "strength") -> Column:
    """Score of a pattern from support, t, correlation, p, hit rate and strength; a missing p adds its whole weight."""
    zero = F.lit(0.0)
    c = lambda x: F.coalesce(F.col(x), zero)
    s = F.abs(c(strength))
    return (
        0.30 * F.log10(1 + c(n)) / 4
        + 0.25 * F.least(F.abs(c(t)), F.lit(10.0)) / 10
        + 0.20 * F.least(F.abs(c(r)), F.lit(1.0))
        + 0.15 * (1 - c(p))
        + 0.10 * c(hit)
        + 0.10 * s / (1 + s)
    )


def ranked(patterns: DataFrame, per_symbol: bool = False, top: int | None = None, by_column: str = "score") -> DataFrame:
    """Rank by a column, then support, |t|, symbol and key."""
    w = Window.partitionBy("symbol") if per_symbol else Window.partitionBy(F.lit(0))
    order = [F.col(by_column).desc_nulls_last(), F.col("n").desc_nulls_last(), F.abs("t_stat").desc_nulls_last(), F.col("symbol"), F.col("pattern_key")]
    if not per_symbol and top is not None:
        best = patterns.orderBy(*order).limit(top)
        return best.withColumn("rank", F.row_number().over(w.orderBy(*order)))
    out = patterns.withColumn("rank", F.row_number().over(w.orderBy(*order)))
    return out if top is None else out.where(F.col("rank") <= top)


def merged(left: DataFrame, right: DataFrame, conflict: str = "prefer_strong", months: str = "intersect") -> DataFrame:
    """Union of two pattern tables (symbol, pattern_key, strength, months, ...) with one row for each key.

    On conflict the stronger row, the left or the right one stays, or both do with a number added to the key; months of
    the two are intersected, united, or taken from one side.
    """
    a, b = left.withColumn("side", F.lit(0)), right.withColumn("side", F.lit(1))
    keys = ["symbol", "pattern_key"]
    w = Window.partitionBy(*keys)
    both = a.unionByName(b, allowMissingColumns=True)
    first = {"prefer_strong": [F.abs("strength").desc_nulls_last(), F.col("side")], "left": [F.col("side")], "right": [F.col("side").desc()], "keep_both": [F.col("side")]}[conflict]
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("months"))).over(w)
    joined = {"intersect": F.array_intersect, "union": lambda x, y: F.array_sort(F.array_union(x, y)), "left": lambda x, y: x, "right": lambda x, y: y}[months](of(0), of(1))
    both = both.withColumn("months", F.coalesce(joined, of(0), of(1)) if conflict != "keep_both" else F.col("months")).withColumn("pick", F.row_number().over(w.orderBy(*first)))
    if conflict == "keep_both":
        return both.withColumn("pattern_key", F.when(F.col("pick") > 1, F.concat_ws("#", "pattern_key", F.col("pick").cast("string"))).otherwise(F.col("pattern_key"))).drop("side", "pick")
    return both.where("pick = 1").drop("side", "pick")


def gates(bars: DataFrame, patterns: DataFrame) -> DataFrame:
    """Long gates: the bars of each pattern, with its mean, correlation, strength and bias where patterns have them.

    patterns: symbol, pattern_key, pattern_type, weekday, hour, wom, months (null: no condition).  weekday and
    order-flow gates open on the session's last bar; time gates on bars of their clock hour; weekend gates on the last
    bar of a Friday.  Order-flow types take no month mask.

    A bar meets patterns by equality only: it stands once for each of the eight choices of conditions that a pattern can
    have, so the join makes no more rows than gates, whatever the number of patterns.
    """
    last = F.row_number().over(Window.partitionBy("symbol", "date").orderBy(F.col("ts").desc())) == 1
    conditions = {"weekday": F.weekday("date"), "hour": F.col("hour"), "wom": (F.floor((F.day("date") + F.weekday(F.trunc("date", "month")) - 1) / 7) + 1).cast("int")}
    none = F.lit(-1)
    b = bars.withColumns({f"at_{c}": v for c, v in conditions.items()} | {"bar_month": F.month("date"), "is_last": last})
    b = b.select("symbol", "ts", "date", "bar_month", "is_last", *[f"at_{c}" for c in conditions])
    for c in conditions:
        b = b.withColumn(f"key_{c}", F.explode(F.array(F.col(f"at_{c}").cast("int"), none)))
    anchored = F.col("pattern_type").isin("weekday_mean", "weekday_returns", "momentum_weekday", "oflow_weekly", "oflow_wom", "weekend_hedging")
    numbers = [c for c in ("mean", "correlation", "strength", "bias") if c in patterns.columns]
    p = patterns.select("symbol", "pattern_key", "pattern_type", "months", *numbers, anchored.alias("anchored"), *[F.coalesce(F.col(c).cast("int"), none).alias(f"key_{c}") for c in conditions])
    month_ok = F.col("months").isNull() | F.col("pattern_type").startswith("oflow") | F.array_contains("months", F.col("bar_month"))
    j = b.join(p, ["symbol", *[f"key_{c}" for c in conditions]]).where(month_ok & (~F.col("anchored") | F.col("is_last")))
    return j.select("symbol", "ts", "date", "pattern_key", "pattern_type", *numbers, F.lit(1).cast("tinyint").alias("gate"))


def any_gate(bars: DataFrame, gated: DataFrame) -> DataFrame:
    """Each bar with the number of open gates and whether there is one."""
    n = gated.groupBy("symbol", "ts").agg(F.count("*").alias("n_gates"))
    return bars.select("symbol", "ts").join(n, ["symbol", "ts"], "left").select("symbol", "ts", F.coalesce("n_gates", F.lit(0)).alias("n_gates"), F.col("n_gates").isNotNull().alias("any_active"))


#: The horizon that a pattern type predicts.
HORIZONS = {
    "weekday_mean": "same_day_oc", "time_predictive_nextday": "next_day_cc", "time_predictive_nextweek": "next_week_cc", "time_predictive_intraday": "intraday_delta",
    "oflow_weekly": "same_day_oc", "oflow_wom": "same_day_oc", "oflow_peak": "intraday_delta", "weekend_hedging": "next_monday_oc", "calendar": "next_day_cc",
}


def horizon_of(pattern_type: Column | str) -> Column:
    c = F.col(pattern_type) if isinstance(pattern_type, str) else pattern_type
    return F.coalesce(F.create_map(*[F.lit(x) for kv in HORIZONS.items() for x in kv])[c], F.lit("intraday_delta"))


def session_horizons(bars: DataFrame, days: int = 5, edge: float = 0.5, ieee: bool = False) -> DataFrame:
    """A row a session with its open-to-close return and those to the next close, the close `days` sessions on, the next Monday, and the same session's `days` before; clipped."""
    s = bars.groupBy("symbol", "date").agg(F.min_by("open", "ts").alias("open"), F.max_by("close", "ts").alias("close"))
    w = by("symbol", "date")
    cut = lambda c: clip(c, -edge, edge)
    change = log_change if ieee else log_ratio
    oc = change("close", "open")
    s = s.withColumn("same_day_oc", cut(oc))
    monday = F.when((F.weekday("date") == 4) & (F.weekday(F.lead("date").over(w)) == 0), F.lead("same_day_oc").over(w))
    return s.withColumns(
        {
            "next_day_cc": cut(change(F.lead("close").over(w), "close")),
            "next_week_cc": cut(change(F.lead("close", days).over(w), "close")),
            "next_monday_oc": monday,
            "prev_week": F.lag("same_day_oc", days).over(w),
        }
    )


def intraday_delta(bars: DataFrame, minutes: int, ieee: bool = False) -> DataFrame:
    """ln(close at exactly ts + minutes / close)."""
    x = shifted_join(bars.select("symbol", "ts", "close"), ["symbol"], "ts", "close", minutes * 60, "later")
    return x.select("symbol", "ts", (log_change if ieee else log_ratio)("later", "close").alias("intraday_delta"))


def opening_period(bars: DataFrame, minutes: int, tolerance_seconds: int = 300, ieee: bool = False) -> DataFrame:
    """Return from a session's first open to the close nearest to `minutes` later, within the tolerance."""
    first = bars.groupBy("symbol", "date").agg(F.min("ts").alias("first_ts"), F.min_by("open", "ts").alias("first_open"))
    at = first.withColumn("ts", F.col("first_ts") + F.make_interval(mins=F.lit(minutes)))
    found = nearest_join(at, bars.select("symbol", "ts", "close"), ["symbol"], "ts", ["close"], tolerance_seconds)
    return found.select("symbol", "date", (log_change if ieee else log_ratio)("close", "first_open").alias("opening_ret"))


def decisions(gated: DataFrame, bars: DataFrame, patterns: DataFrame | None = None, minutes: int = 60, ieee: bool = False) -> DataFrame:
    """Decision rows: symbol, ts_decision, gate, pattern_type, returns_x, returns_y, side_hint, correlation, strength.

    y is the pattern type's horizon.  x is the past move for time patterns, the same session a week before for weekly
    ones, else the pattern's mean.  Rows without x and y are left out; side hints come from order flow only.
    patterns are needed only where the gates do not carry their numbers.
    """
    s = session_horizons(bars, ieee=ieee)
    d = intraday_delta(bars, minutes, ieee)
    back = shifted_join(bars.select("symbol", "ts", "close"), ["symbol"], "ts", "close", -minutes * 60, "earlier").select("symbol", "ts", (log_change if ieee else log_ratio)("close", "earlier").alias("past"))
    j = gated.join(s.drop("open", "close"), ["symbol", "date"]).join(d, ["symbol", "ts"], "left").join(back, ["symbol", "ts"], "left")
    if patterns is not None:
        j = j.drop("mean", "correlation", "strength", "bias").join(patterns.select("symbol", "pattern_key", "mean", "correlation", "strength", "bias"), ["symbol", "pattern_key"])
    h = horizon_of("pattern_type")
    y = F.coalesce(*[F.when(h == name, F.col(name)) for name in ("same_day_oc", "next_day_cc", "next_week_cc", "next_monday_oc", "intraday_delta")])
    x = F.when(F.col("pattern_type").startswith("time_"), F.coalesce("past", "correlation")).when(F.col("pattern_type").startswith("oflow"), F.coalesce("prev_week", "mean")).otherwise(F.col("mean"))
    hint = F.when(F.col("pattern_type").startswith("oflow"), F.when(F.col("bias") == "buy", 1).when(F.col("bias") == "sell", -1).otherwise(0)).otherwise(0)
    out = j.select("symbol", F.col("ts").alias("ts_decision"), F.col("pattern_key").alias("gate"), "pattern_type", x.alias("returns_x"), y.alias("returns_y"), hint.alias("side_hint"), "correlation", "strength")
    return out.where("returns_x IS NOT NULL AND returns_y IS NOT NULL")


def aggregated_positions(xy: DataFrame) -> DataFrame:
    """By symbol and time: the sign of the summed scores |x| * sign(correlation) * strength, and mean x and y."""
    score = F.abs("returns_x") * sign(F.coalesce("correlation", F.lit(1.0))) * F.coalesce("strength", F.lit(1.0))
    g = xy.withColumn("score", score).groupBy("symbol", "ts_decision").agg(F.sum("score").alias("score"), F.avg("returns_x").alias("returns_x"), F.avg("returns_y").alias("returns_y"), F.count("*").alias("n"))
    return g.withColumn("position", sign("score").cast("int"))


def resolved(xy: DataFrame, group: str = "symbol") -> DataFrame:
    """One decision for each time and group: the largest |score|, then |x|, then the gate; with the gates that met there."""
    score = F.abs("returns_x") * F.coalesce("strength", F.lit(1.0))
    w = Window.partitionBy(group, "ts_decision")
    x = xy.withColumn("score", score).withColumn("pick", F.row_number().over(w.orderBy(F.col("score").desc(), F.abs("returns_x").desc(), "gate"))).withColumn("members", F.size(F.collect_set("gate").over(w)))
    return x.where("pick = 1").drop("pick")


def backtest(xy: DataFrame, threshold: float | Column, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts_decision", "gate"), use_side_hint: bool = True) -> DataFrame:
    """Positions, profit, cumulative profit and drawdown of decision rows in order.

    Direction is the sign of x times that of the correlation, a side hint other than zero overrides it; a position is
    taken from |x| >= threshold on.  Drawdown is from the running maximum of the profit, without a leading zero.
    """
    t = F.lit(threshold) if isinstance(threshold, float) else threshold
    direction = sign(F.col("returns_x") * F.when(F.coalesce("correlation", F.lit(1.0)) < 0, -1).otherwise(1))
    if use_side_hint:
        direction = F.when(F.coalesce("side_hint", F.lit(0)) != 0, F.col("side_hint").cast("double")).otherwise(direction)
    w = by(list(keys), list(order)).rowsBetween(Window.unboundedPreceding, 0)
    x = xy.withColumn("position", F.when(F.abs("returns_x") >= t, direction).otherwise(0.0)).withColumn("pnl", F.col("position") * F.col("returns_y"))
    x = x.withColumn("cumulative", F.sum("pnl").over(w))
    return x.withColumn("drawdown", F.col("cumulative") - F.max("cumulative").over(w))


def summary(tested: DataFrame, keys: tuple[str, ...] = ("symbol",), annual: float = 252.0) -> DataFrame:
    """Totals by key: mean and hit rate over all rows, population deviation, days traded."""
    sd = F.stddev_pop("pnl")
    g = tested.groupBy(*keys).agg(
        F.sum("pnl").alias("total_return"),
        F.avg("pnl").alias("mean_return"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("hit_rate"),
        (ratio(F.avg("pnl"), sd) * F.sqrt(F.lit(annual))).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        F.count_distinct(F.when(F.col("position") != 0, F.to_date("ts_decision"))).alias("trades"),
        F.count("*").alias("n_rows"),
    )
    return g.withColumn("ranking", F.when(F.col("max_drawdown") == 0, F.signum("total_return") * F.lit(float("inf"))).otherwise(F.col("total_return") / F.abs("max_drawdown")))


def sweep(xy: DataFrame, thresholds: list[float], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Summaries for many thresholds in one plan."""
    t = F.explode(F.array(*map(F.lit, thresholds)))
    many = xy.withColumn("threshold", t)
    return summary(backtest(many, F.col("threshold"), (*keys, "threshold")), (*keys, "threshold"))


def period_returns(tested: DataFrame, unit: str = "month", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return tested.groupBy(*keys, F.to_date(F.date_trunc(unit, "ts_decision")).alias(unit)).agg(F.sum("pnl").alias("pnl"), F.count("*").alias("n"))


def report(summaries: DataFrame, top: int = 5) -> DataFrame:
    """Best patterns of each symbol by return a trade, and the symbol's means."""
    score = F.when(F.col("trades") > 0, F.col("total_return") / F.col("trades"))
    w = Window.partitionBy("symbol")
    x = summaries.withColumn("score", score).withColumn("rank", F.row_number().over(w.orderBy(F.col("score").desc_nulls_last(), "gate")))
    return x.withColumn("mean_total", F.avg("total_return").over(w)).withColumn("mean_sharpe", F.avg("sharpe").over(w)).where(F.col("rank") <= top)


def feature_backtest(bars: DataFrame, trigger: Column, exit_bars: int = 5, bias: int = 1, ieee: bool = False) -> DataFrame:
    """Enter at the close of rows that trigger and leave `exit_bars` rows on, or at the last row; profit is booked at the exit."""
    w = by("symbol", "ts")
    last = Window.partitionBy("symbol")
    x = bars.withColumn("on", trigger).withColumn("exit_ts", F.coalesce(F.lead("ts", exit_bars).over(w), F.max("ts").over(last))).withColumn("exit_close", F.coalesce(F.lead("close", exit_bars).over(w), F.max_by("close", "ts").over(last)))
    x = x.where("on AND exit_ts > ts").withColumn("ret", bias * (log_change if ieee else log_ratio)("exit_close", "close"))
    return x.groupBy("symbol", "exit_ts").agg(F.sum("ret").alias("pnl"), F.count("*").alias("n_closed"))


def active_events(patterns: DataFrame, now: Column, hours: int) -> DataFrame:
    """Active patterns whose event falls within the coming hours, soonest first."""
    return patterns.where(F.col("active") & F.col("event_ts").between(now, now + F.make_interval(hours=F.lit(hours)))).orderBy("event_ts", "symbol", "pattern_key")


def tidy(entries: DataFrame, ids: list[str], metrics: list[str], scope: list[str]) -> DataFrame:
    """One row for each metric with p from t where it is missing, and q within the scope."""
    x = entries.withColumn("p_value", F.coalesce("p_value", t_pvalue("t_stat", (F.col("n") - 1).cast("double")))) if "p_value" in entries.columns else entries.withColumn("p_value", t_pvalue("t_stat", (F.col("n") - 1).cast("double")))
    long = x.unpivot([*ids, "p_value"], metrics, "metric", "value")
    return fdr(long, "p_value", scope, [*ids, "metric"])


def overlay(tested: DataFrame, bars: DataFrame, scale: float = 1.0) -> DataFrame:
    """Cumulative profit beside the price of the same symbol and time."""
    c = tested.select("symbol", F.col("ts_decision").alias("ts"), (F.col("cumulative") * scale).alias("cumulative"))
    return c.join(bars.select("symbol", "ts", "close"), ["symbol", "ts"])


def slug(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
