"""Bars, sessions and calendar projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import by, forward_fill

SEASONS = {"winter": [12, 1, 2], "spring": [3, 4, 5], "summer": [6, 7, 8], "autumn": [9, 10, 11]}


def resample(df: DataFrame, freq: str, keys: list[str] | None = None, ts: str = "ts", tiebreak: str | None = None, sums: tuple[str, ...] = ("volume", "num_trades", "bid_volume", "ask_volume")) -> DataFrame:
    """Bars of a fixed width: open first, high max, low min, close last, volumes summed; empty bins are not emitted."""
    keys = keys or ["symbol"]
    order = F.struct(ts, tiebreak) if tiebreak else F.col(ts)
    has = set(df.columns)
    first, last = ("open", "close") if "open" in has else ("price", "price") if "price" in has else ("close", "close")
    high, low = ("high", "low") if "high" in has else (first, first)
    aggs = [F.min_by(first, order).alias("open"), F.max(high).alias("high"), F.min(low).alias("low"), F.max_by(last, order).alias("close")]
    aggs += [F.sum(c).alias(c) for c in sums if c in has]
    return df.groupBy(*keys, F.window(ts, freq).alias("w")).agg(*aggs).select(*keys, F.col("w.start").alias(ts), "open", "high", "low", "close", *[c for c in sums if c in has])


def integral_volumes(bars: DataFrame, columns: tuple[str, ...] = ("volume",)) -> DataFrame:
    """Volumes rounded half to even as integers; bars without any price are dropped."""
    return bars.where("coalesce(open, high, low, close) IS NOT NULL").withColumns({c: F.rint(c).cast("bigint") for c in columns})


def week_end(date: Column | str, anchor: int) -> Column:
    """The week's last day, on the anchor weekday (Monday 0) at or after the date."""
    d = F.to_date(date)
    return F.date_add(d, F.pmod(F.lit(anchor) - F.weekday(d), F.lit(7)))


def resample_weekly(bars: DataFrame, anchor: int = 4, date: str = "date") -> DataFrame:
    """Weekly bars that end on the anchor weekday."""
    g = bars.groupBy("symbol", week_end(date, anchor).alias("week"))
    return g.agg(F.min_by("open", date).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", date).alias("close"), F.sum("volume").alias("volume"))


def fill_weekly(weekly: DataFrame, values: list[str], limit: int = 2) -> DataFrame:
    """Carry values over at most `limit` missing weeks."""
    w = by("symbol", "week")
    return weekly.withColumns({v: forward_fill(v, w, limit) for v in values})


def is_tick_data(df: DataFrame, keys: list[str] | None = None, ts: str = "ts", share: float = 0.8) -> DataFrame:
    """Whether a symbol's most common spacing covers less than `share` of its rows."""
    keys = keys or ["symbol"]
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(by(keys, ts)).cast("timestamp"))
    counts = df.withColumn("gap", gap).where("gap IS NOT NULL").groupBy(*keys, "gap").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg((F.max("n") / F.sum("n")).alias("modal_share")).withColumn("is_tick", F.col("modal_share") < share)


def seconds_of_day(ts: Column | str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def to_zone(ts: Column | str, zone: str, source: str = "UTC") -> Column:
    """Local wall-clock time in a zone."""
    return F.convert_timezone(F.lit(source), F.lit(zone), (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz"))


def in_session(ts: Column | str, start: str, end: str) -> Column:
    """Inclusive clock window; a start after the end spans midnight."""
    at = lambda hm: sum(int(x) * k for x, k in zip(hm.split(":"), (3600, 60, 1), strict=False))
    s, a, b = seconds_of_day(ts), at(start), at(end)
    return s.between(a, b) if a <= b else (s >= a) | (s <= b)


def session_date(ts: Column | str, open_clock: str) -> Column:
    """The local date from the open on, the day before until then."""
    h, m = map(int, open_clock.split(":"))
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.when(seconds_of_day(c) >= h * 3600 + m * 60, F.to_date(c)).otherwise(F.date_sub(F.to_date(c), 1))


def minutes_since_open(ts: Column | str, open_clock: str) -> Column:
    """Minutes from the same day's open, negative before it."""
    h, m = map(int, open_clock.split(":"))
    return F.floor((seconds_of_day(ts) - (h * 3600 + m * 60)) / 60)


def schedule(dates: DataFrame, open_clock: str = "08:30", close_clock: str = "15:00") -> DataFrame:
    """session_id, open_ts, close_ts of the weekdays among the dates (one column, date)."""
    days = dates.select(F.to_date("date").alias("session_id")).distinct().where(F.weekday("session_id") < 5)
    at = lambda c: F.to_timestamp_ntz(F.concat_ws(" ", F.col("session_id").cast("string"), F.lit(c + ":00")))
    return days.select("session_id", at(open_clock).alias("open_ts"), at(close_clock).alias("close_ts"))


def attach_sessions(df: DataFrame, sessions: DataFrame, keys: list[str] | None = None, ts: str = "ts", mode: str = "close") -> DataFrame:
    """session_id of the first session that closes after ts: rows before an open belong to the coming session.

    mode="reference" matches the first session that opens at or after ts instead, and leaves rows out that have none.
    Rows stay where they are: each meets the sessions of its own day and the first one of a later day, from a small table.
    """
    mark = F.col("close_ts") - F.expr("INTERVAL 1 MICROSECOND") if mode == "close" else F.col("open_ts")
    rows = df.withColumn(ts, F.col(ts).cast("timestamp_ntz"))
    marks = sessions.select(F.struct(mark.alias("at"), "session_id").alias("mark")).where("mark.at IS NOT NULL").groupBy("mark.at").agg(F.max("mark").alias("mark"))
    own = marks.groupBy(F.to_date("at").alias("mark_day")).agg(F.collect_list("mark").alias("marks"), F.min("mark").alias("first_mark"))
    # a row a day of the table or of the sessions, whatever the number of rows
    days = rows.select(F.to_date(ts).alias("mark_day")).distinct().join(own, "mark_day", "full")
    later = F.last("first_mark", ignorenulls=True).over(Window.orderBy(F.col("mark_day").desc()).rowsBetween(Window.unboundedPreceding, -1))
    days = days.select("mark_day", "marks", later.alias("later_mark"))
    same_day = F.array_min(F.filter("marks", lambda m: m["at"] >= F.col(ts)))
    out = rows.join(F.broadcast(days), F.to_date(ts) == F.col("mark_day"), "left")
    return out.select(*df.columns, F.coalesce(same_day, "later_mark")["session_id"].alias("session_id"))


def calendar_columns(df: DataFrame, ts: str = "ts") -> DataFrame:
    """month, weekday (Monday 0), both weeks of the month, clock time and default session of each row.

    wom_calendar counts rows of a month's calendar sheet; wom_days counts periods of seven days.
    """
    d = F.to_date(ts)
    first = F.weekday(F.trunc(d, "month"))
    return df.withColumns(
        {
            "month": F.month(d),
            "weekday": F.weekday(d),
            "wom_calendar": (F.floor((F.day(d) + first - 1) / 7) + 1).cast("int"),
            "wom_days": (F.floor((F.day(d) - 1) / 7) + 1).cast("int"),
            "clock_time": F.date_format(ts, "HH:mm:ss"),
            "local_date": d,
        }
    )


def months_of(months: list[int] | None = None, season: str | None = None) -> list[int]:
    """Months of a filter: given, or a season's; all twelve by default."""
    if months and any(not 1 <= m <= 12 for m in months):
        raise ValueError("months are 1 to 12")
    return sorted(months or (SEASONS[season.lower()] if season else range(1, 13)))


def month_mask(months: Column) -> Column:
    """Twelve characters, 1 for each month in an array."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.when(F.array_contains(months, m), "1").otherwise("0")), "")


def clean(df: DataFrame, values: list[str], policy: str = "ffill", order: str = "ts") -> DataFrame:
    """Missing values filled forward, their rows dropped, or zero."""
    if policy == "drop":
        return df.dropna(subset=values)
    if policy == "zero":
        return df.fillna(0, subset=values)
    w = by("symbol", order)
    return df.withColumns({v: forward_fill(v, w) for v in values})


def gaps(df: DataFrame, keys: list[str] | None = None, ts: str = "ts", factor: float = 3.0) -> DataFrame:
    """Spacings over `factor` times the most common one, with their kind: weekend, holiday, contract_roll or data_missing."""
    keys = keys or ["symbol"]
    w = by(keys, ts)
    steps = df.select(*keys, F.col(ts).alias("gap_end"), F.lag(ts).over(w).alias("gap_start")).where("gap_start IS NOT NULL")
    steps = steps.withColumn("seconds", F.unix_seconds(F.col("gap_end").cast("timestamp")) - F.unix_seconds(F.col("gap_start").cast("timestamp")))
    counts = steps.groupBy(*keys, "seconds").agg(F.count("*").alias("n"))
    modal = counts.groupBy(*keys).agg(F.max_by("seconds", F.struct("n", -F.col("seconds"))).alias("modal_seconds"))
    hours = F.col("seconds") / 3600
    a, b = F.weekday("gap_start"), F.weekday("gap_end")
    kind = (
        F.when((a == 4) & (b == 0) & (hours < 72), "weekend")
        .when(hours.between(24, 72), "holiday")
        .when((a >= 3) & (b <= 1) & (hours > 48), "contract_roll")
        .otherwise("data_missing")
    )
    return steps.join(F.broadcast(modal), keys).where(F.col("seconds") > factor * F.col("modal_seconds")).withColumn("gap_type", kind)


def gap_summary(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["symbol"]
    return found.groupBy(*keys, "gap_type").agg(F.count("*").alias("n_gaps"), F.sum("seconds").alias("total_seconds"), F.max("seconds").alias("longest_seconds"))
