"""Patterns made from the tables of screens, their index, ranking and occurrences.

A pattern is a row: symbol, pattern_key, pattern_type, source (the screen), the conditions weekday, hour, wom and months
(null: none), n, mean, t_stat, correlation, strength, hit_rate, bias and a map of further numbers.  So one table holds
the patterns of all symbols and screens, and gates, ranks and series are joins with it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import by, log_change, log_ratio, t_of_r

#: Fixed value: |t| from which a screen's row becomes a pattern.
EDGE = 1.96

_NULLS = {
    "weekday": "int", "hour": "int", "wom": "int", "months": "array<int>", "n": "bigint", "mean": "double", "t_stat": "double", "p_value": "double", "correlation": "double",
    "strength": "double", "hit_rate": "double", "bias": "string", "payload": "map<string,double>",
}


def pattern(rows: DataFrame, source: str, pattern_type: str | Column, key: Column, **values: Column) -> DataFrame:
    """rows as patterns; what is not given is null."""
    kind = F.lit(pattern_type) if isinstance(pattern_type, str) else pattern_type
    columns = [values.get(c, F.lit(None)).cast(t).alias(c) for c, t in _NULLS.items()]
    return rows.select("symbol", key.alias("pattern_key"), kind.alias("pattern_type"), F.lit(source).alias("source"), *columns)


def _bias(mean: str) -> Column:
    return F.when(F.col(mean) > 0, "buy").when(F.col(mean) < 0, "sell")


def _numbers(*names: str) -> Column:
    return F.map_filter(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("double"))]), lambda _, v: v.isNotNull())


def weekday_patterns(stats: DataFrame, edge: float = EDGE, months: Column | None = None) -> DataFrame:
    """From a weekday table: the days whose mean return is far from zero."""
    return pattern(
        stats.where(F.abs("t_stat") > edge), "seasonality", "weekday_mean", F.concat(F.lit("wd_"), F.col("weekday")),
        weekday=F.col("weekday"), months=months if months is not None else F.lit(None), n=F.col("n"), mean=F.col("mean"), t_stat=F.col("t_stat"),
        strength=F.abs("t_stat"), hit_rate=F.col("positive"), bias=_bias("mean"), payload=_numbers("std", "sharpe", "skew"),
    )


def anova_patterns(tested: DataFrame, alpha: float = 0.05) -> DataFrame:
    """From an analysis of variance between weekdays: symbols whose days differ."""
    return pattern(tested.where(F.col("p_value") < alpha), "seasonality", "weekday_returns", F.lit("weekday_returns"), n=F.col("n"), p_value=F.col("p_value"), strength=F.abs("f_stat"), payload=_numbers("f_stat", "k"))


def time_patterns(predictability: DataFrame, edge: float = EDGE) -> DataFrame:
    """From a table of predictive clock hours: the hours whose return goes with the next day's, the next week's or the day's rest."""
    kinds = {"next_day": "time_predictive_nextday", "next_week": "time_predictive_nextweek", "to_close": "time_predictive_eod"}
    found = []
    for name, kind in kinds.items():
        n = F.col("n" if name == "to_close" else f"n_{name}")
        x = predictability.withColumn("t", t_of_r(F.col(f"r_{name}"), n)).where((n > 2) & (F.abs("t") > edge))
        key = F.concat(F.lit("hr_"), F.col("hour"), F.lit(f"_{name}"))
        found.append(pattern(x, "seasonality", kind, key, hour=F.col("hour"), n=n, mean=F.col("mean"), t_stat=F.col("t"), correlation=F.col(f"r_{name}"), strength=F.abs(f"r_{name}"), bias=F.when(F.col(f"r_{name}") > 0, "buy").otherwise("sell")))
    return reduce(DataFrame.unionByName, found)


def hour_pair_patterns(matrix: DataFrame, edge: float = EDGE) -> DataFrame:
    """From a matrix of hourly correlations within the day: pairs of hours that go together, gated at the first."""
    x = matrix.withColumn("t", t_of_r("r", "n")).where(F.abs("t") > edge)
    hours = [F.col(c).cast("int") for c in ("name_a", "name_b")]
    return pattern(x, "seasonality", "time_predictive_intraday", F.concat_ws("_", F.lit("hr"), "name_a", "name_b"), hour=hours[0], n=F.col("n"), t_stat=F.col("t"), correlation=F.col("r"), strength=F.abs("r"), payload=F.create_map(F.lit("hour_to"), hours[1].cast("double")))


def momentum_patterns(by_weekday: DataFrame, edge: float = EDGE) -> DataFrame:
    """From session returns by weekday: kinds of momentum that lean to one side on a weekday."""
    x = by_weekday.where(F.abs("t_stat") > edge)
    return pattern(x, "momentum", "momentum_weekday", F.concat_ws("_", F.lit("mom"), "kind", F.col("weekday").cast("string")), weekday=F.col("weekday"), n=F.col("n"), mean=F.col("mean"), t_stat=F.col("t_stat"), strength=F.abs("t_stat"), bias=_bias("mean"), payload=_numbers("std", "skew"))


def momentum_correlation_patterns(correlations: DataFrame, edge: float = EDGE) -> DataFrame:
    """From a symbol's correlations between session parts, a column each: those that are far from zero."""
    names = [c for c in correlations.columns if c not in ("symbol", "n")]
    long = correlations.unpivot(["symbol", "n"], names, "kind", "r").withColumn("t", t_of_r("r", "n")).where(F.abs("t") > edge)
    return pattern(long, "momentum", "momentum_correlation", F.concat_ws("_", F.lit("mom"), "kind"), n=F.col("n"), t_stat=F.col("t"), correlation=F.col("r"), strength=F.abs("r"), bias=F.when(F.col("r") > 0, "buy").otherwise("sell"))


def weekend_patterns(hedging: DataFrame, edge: float = EDGE) -> DataFrame:
    """From the weekend table: symbols whose Friday goes with, or against, their Monday."""
    x = hedging.where(F.abs("t_stat") > edge)
    return pattern(x, "seasonality", "weekend_hedging", F.lit("weekend"), weekday=F.lit(4), n=F.col("n"), mean=F.coalesce("after_gain", "after_loss"), t_stat=F.col("t_stat"), correlation=F.col("r"), strength=F.abs("r"), payload=_numbers("after_gain", "after_loss"))


def orderflow_patterns(seasonality: DataFrame, edge: float | None = EDGE) -> DataFrame:
    """From an order-flow table by weekday, or by week of month and weekday: leaning metrics; edge None takes the rejected rows."""
    wom = "wom" in seasonality.columns
    x = seasonality.where("rejected" if edge is None else F.abs("t_stat") > edge)
    side = F.when(F.col("metric").contains("sell"), F.when(F.col("mean") > 0, "sell").otherwise("buy")).otherwise(F.when(F.col("mean") > 0, "buy").otherwise("sell"))
    parts = ["metric", *([F.concat(F.lit("w"), F.col("wom"))] if wom else []), F.col("weekday").cast("string")]
    return pattern(
        x, "orderflow", "oflow_wom" if wom else "oflow_weekly", F.concat_ws("_", F.lit("of"), *parts),
        weekday=F.col("weekday"), wom=F.col("wom") if wom else F.lit(None), n=F.col("n"), mean=F.col("mean"), t_stat=F.col("t_stat"), strength=F.abs("t_stat"), bias=side, payload=_numbers("std"),
    )


def month_patterns(abnormal: DataFrame, edge: float = EDGE) -> DataFrame:
    """From a table of calendar months: those whose mean is far from the overall mean."""
    x = abnormal.where(F.abs("t_stat") > edge)
    return pattern(x, "seasonality", "abnormal_month", F.concat(F.lit("month_"), F.col("month")), months=F.array(F.col("month")), n=F.col("n"), mean=F.col("mean"), t_stat=F.col("t_stat"), strength=F.abs("t_stat"), bias=_bias("mean"))


def index(*tables: DataFrame) -> DataFrame:
    """One pattern table of several; of repeated keys of a symbol the strongest row stays."""
    both = reduce(DataFrame.unionByName, tables)
    w = Window.partitionBy("symbol", "pattern_key").orderBy(F.col("strength").desc_nulls_last(), "pattern_type", "source")
    return both.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def chosen(patterns: DataFrame, symbols: list[str] | None = None, types: list[str] | None = None, sources: list[str] | None = None) -> DataFrame:
    """The patterns of these symbols, types and screens; None takes all.  The payload's numbers fill in for null columns."""
    out = patterns
    for column, values in (("symbol", symbols), ("pattern_type", types), ("source", sources)):
        out = out if values is None else out.where(F.col(column).isin(list(values)))
    promoted = {c: F.coalesce(F.col(c), F.col("payload")[c].cast(_NULLS[c])) for c in ("p_value", "t_stat", "n")}
    return out.withColumns(promoted)


def seasonal_ranking(patterns: DataFrame, top: int | None = None) -> DataFrame:
    """Each symbol's patterns by strength, then key, with their rank."""
    w = Window.partitionBy("symbol").orderBy(F.col("strength").desc_nulls_last(), "pattern_key")
    out = patterns.withColumn("rank", F.row_number().over(w))
    return out if top is None else out.where(F.col("rank") <= top)


def pattern_series(patterns: DataFrame, intraday: DataFrame, ieee: bool = False) -> DataFrame:
    """symbol, pattern_key, date, pattern_return: each pattern's occurrences.

    intraday: symbol, ts, date, hour, open, close.  Weekday and order-flow patterns have the day's return, close to
    close over the bars, on their days; hours their bar's return; months the return of each of their months (the day is
    its first); the weekend the open-to-close return of a Monday that follows a Friday in the table.
    """
    change = log_change if ieee else log_ratio
    w = by("symbol", "date")
    days = intraday.groupBy("symbol", "date").agg(F.min_by("open", "ts").alias("open"), F.max_by("close", "ts").alias("close"))
    days = days.withColumns({"ret": change("close", F.lag("close").over(w)), "oc": change("close", "open"), "day_weekday": F.weekday("date"), "before": F.lag("date").over(w), "month_of_year": F.month("date"), "month_start": F.trunc("date", "month")})
    days = days.withColumn("day_wom", (F.floor((F.day("date") + F.weekday("month_start") - 1) / 7) + 1).cast("int"))
    of = lambda *types: patterns.where(F.col("pattern_type").isin(*types)).select("symbol", "pattern_key", "weekday", F.col("hour").alias("at_hour"), "wom", "months")
    month_ok = F.col("months").isNull() | F.array_contains("months", F.col("month_of_year"))
    kinds = {
        "daily": days.join(of("weekday_mean", "weekday_returns", "momentum_weekday", "oflow_weekly", "oflow_wom"), "symbol").where((F.col("weekday").isNull() | (F.col("weekday") == F.col("day_weekday"))) & (F.col("wom").isNull() | (F.col("wom") == F.col("day_wom"))) & month_ok).select("symbol", "pattern_key", "date", F.col("ret").alias("pattern_return")),
        "weekend": days.where((F.col("day_weekday") == 0) & (F.weekday("before") == 4)).join(of("weekend_hedging"), "symbol").select("symbol", "pattern_key", "date", F.col("oc").alias("pattern_return")),
        "month": days.join(of("abnormal_month"), "symbol").where(month_ok).groupBy("symbol", "pattern_key", F.col("month_start").alias("date")).agg(F.sum("ret").alias("pattern_return")),
    }
    hours = of("time_predictive_nextday", "time_predictive_nextweek", "time_predictive_eod", "time_predictive_intraday")
    bars = intraday.select("symbol", "date", "hour", change("close", "open").alias("each"), F.month("date").alias("month_of_year"))
    kinds["hours"] = bars.join(hours, (bars["symbol"] == hours["symbol"]) & (bars["hour"] == hours["at_hour"])).where(month_ok).groupBy(bars["symbol"], "pattern_key", "date").agg(F.sum("each").alias("pattern_return"))
    return reduce(DataFrame.unionByName, kinds.values()).where("pattern_return IS NOT NULL")


def rebased(series: DataFrame, intraday: DataFrame) -> DataFrame:
    """series with the last close at or before each date and the value of one unit held through the occurrences so far."""
    w = by(["symbol", "pattern_key"], "date")
    days = intraday.groupBy("symbol", "date").agg(F.max_by("close", "ts").alias("close"))
    # an occurrence on a day without bars, such as a month's first, has the close before it
    marks = days.withColumn("pattern_key", F.lit(None).cast("string")).unionByName(series.withColumn("close", F.lit(None).cast("double")), allowMissingColumns=True)
    filled = marks.withColumn("close", F.last("close", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("date", F.col("pattern_key").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))).where("pattern_key IS NOT NULL")
    growth = F.sum(F.ln(F.lit(1.0) + F.col("pattern_return"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return filled.select("symbol", "pattern_key", "date", "pattern_return", "close", F.exp(growth).alias("rebased"))
