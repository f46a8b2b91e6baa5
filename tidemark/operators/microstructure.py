"""Tick microstructure on a time grid, and the price levels of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import by, ratio


def trade_grid(ticks: DataFrame, step: int = 1) -> DataFrame:
    """Last price, trades, signed counts and volumes of each step (seconds) in which a symbol trades.

    Steps without trades have no row: sums over a time frame do not need them.  `second` is the step's start, in seconds
    since 1970.
    """
    second = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / step) * step).cast("bigint")
    buy, sell = F.col("side") == "B", F.col("side") == "S"
    size = F.col("ask_volume") + F.col("bid_volume")
    return ticks.groupBy("symbol", F.to_date("ts").alias("date"), second.alias("second")).agg(
        F.max_by("price", "tick_id").alias("price"),
        F.count("*").alias("n_trades"),
        F.count_if(buy).alias("buy_count"),
        F.count_if(sell).alias("sell_count"),
        F.sum(F.when(buy, size).otherwise(0.0)).alias("buy_vol"),
        F.sum(F.when(sell, size).otherwise(0.0)).alias("sell_vol"),
    )


def last_seconds(grid: DataFrame, sums: dict[str, Column], n: int) -> DataFrame:
    """grid with the columns `sums`, summed over the last n seconds of a symbol's day; a day has a second once.

    Spark sums a frame of time anew for every row, so long frames of busy symbols would cost rows times frame.  Here time is
    cut into blocks of n seconds: a frame is its row's block so far and the end of the block before, from the frame's first
    row on, and both are running sums.  Nothing is subtracted, so the sums are as exact as those of the frames.  A row is the
    first of the frames that end n seconds after the row before it, until the next row is; no task holds more than a
    symbol's day.
    """
    day, until_now = ["symbol", "date"], (Window.unboundedPreceding, 0)
    so_far, to_end = (by([*day, "frame_block"], order).rowsBetween(*until_now) for order in ("second", F.col("second").desc()))
    out = grid.withColumn("frame_block", F.floor(F.col("second") / n))
    out = out.withColumns({c: F.sum(v).over(so_far) for c, v in sums.items()} | {"frame_end": F.struct("frame_block", *[F.sum(v).over(to_end).alias(c) for c, v in sums.items()])})
    out = out.withColumn("frame_at", F.coalesce(F.lag("second").over(by(day, "second")) + n, "second"))
    out = out.withColumn("frame_event", F.explode(F.array(F.struct(F.col("frame_at").alias("at"), F.lit(0).alias("own")), F.struct(F.col("second").alias("at"), F.lit(1).alias("own")))))
    first = F.last(F.when(F.col("frame_event.own") == 0, F.col("frame_end")), ignorenulls=True)
    # at one time the next first row comes before the row that asks for it
    out = out.withColumn("frame_first", first.over(by(day, "frame_event").rowsBetween(*until_now))).where("frame_event.own = 1")
    earlier = {c: F.when(F.col("frame_first.frame_block") < F.col("frame_block"), F.col(f"frame_first.{c}")) for c in sums}
    out = out.withColumns({c: F.coalesce(F.col(c) + e, c, e) for c, e in earlier.items()})
    return out.drop("frame_block", "frame_end", "frame_at", "frame_event", "frame_first")


def arrival_rates(grid: DataFrame, window: int = 10, base: int = 60) -> DataFrame:
    """Buys and sells a second over `window` seconds, their Poisson z against the rate over `base`, and the rates' imbalance."""
    counts = {side: F.col(f"{side}_count") for side in ("buy", "sell")}
    out = last_seconds(grid, {f"near_{s}": c for s, c in counts.items()}, window)
    out = last_seconds(out, {f"usual_{s}": c for s, c in counts.items()}, base)
    for side in counts:
        usual = F.col(f"usual_{side}") / base
        out = out.withColumn(f"lam_{side}", F.col(f"near_{side}") / window).withColumn(f"z_{side}", (F.col(f"lam_{side}") - usual) / F.sqrt(F.greatest(usual, F.lit(1e-6))))
    out = out.drop(*[f"{name}_{s}" for name in ("near", "usual") for s in counts])
    return out.withColumn("imbalance", ratio(F.col("lam_buy") - F.col("lam_sell"), F.col("lam_buy") + F.col("lam_sell")))


def flow_features(grid: DataFrame, window: int = 10, step: int = 1) -> DataFrame:
    """Volume imbalance, cumulative flow of the day, and the Fano factor and variation of counts over the window's steps.

    Steps without trades count as zeros, from the day's first trade on.
    """
    day = Window.partitionBy("symbol", "date")
    n = F.col("n_trades")
    out = last_seconds(grid, {"last_buys": F.col("buy_vol"), "last_sells": F.col("sell_vol"), "last_trades": n, "last_squares": n * n}, window)
    buys, sells = F.col("last_buys"), F.col("last_sells")
    flow = F.sum(F.col("buy_vol") - F.col("sell_vol")).over(day.orderBy("second").rowsBetween(Window.unboundedPreceding, 0))
    steps = F.least(F.lit(window / step), (F.col("second") - F.min("second").over(day)) / step + 1)
    mean = F.col("last_trades") / steps
    variance = F.greatest(F.col("last_squares") / steps - mean * mean, F.lit(0.0))
    out = out.withColumn("trade_imbalance", ratio(buys - sells, buys + sells)).withColumn("flow", flow)
    out = out.withColumn("fano", ratio(variance, mean)).withColumn("variation", F.when(steps >= 2, ratio(F.sqrt(variance), mean)))
    return out.drop("last_buys", "last_sells", "last_trades", "last_squares")


def dense_grid(grid: DataFrame, step: int, before: int, after: int) -> DataFrame:
    """The grid with its empty steps near trades: `before` steps ahead of and `after` behind each step with trades.

    Empty steps have zero counts and volumes and the last price.  Only steps between a day's first and last trade are
    filled.  `live` marks steps with trades and the `after` steps behind them: a measure over frames of up to `before`
    steps is the same there as on a grid without gaps, which would have rows for every second of a quiet night.
    """
    day = Window.partitionBy("symbol", "date")
    sums = [c for c in grid.columns if c not in ("symbol", "date", "second", "price")]
    ends = grid.withColumns({"first_second": F.min("second").over(day), "last_second": F.max("second").over(day)})
    low, high = F.greatest("first_second", F.col("second") - before * step), F.least("last_second", F.col("second") + after * step)
    near = ends.withColumn("at", F.explode(F.sequence(low, high, F.lit(step).cast("bigint"))))
    own = F.col("at") == F.col("second")
    steps = near.groupBy("symbol", "date", "first_second", F.col("at").alias("second")).agg(
        F.max(F.when(own, F.col("price"))).alias("price"),
        *[F.sum(F.when(own, F.col(c)).otherwise(F.lit(0).cast(grid.schema[c].dataType))).alias(c) for c in sums],
        F.max(F.col("at") >= F.col("second")).alias("live"),
    )
    return steps.withColumn("price", F.last("price", ignorenulls=True).over(day.orderBy("second").rowsBetween(Window.unboundedPreceding, 0)))


def tick_impact(ticks: DataFrame, large: float | None = None, quantile: float = 0.95, step: int = 1) -> DataFrame:
    """symbol, date, second, impact (mean price change for each unit of signed size) and n_large (trades of the large sizes).

    Changes are from the trade before on the same day, by time and tick_id.  Large is a size given, or the day's quantile.
    """
    second = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / step) * step).cast("bigint")
    t = ticks.withColumns({"date": F.to_date("ts"), "second": second, "size": F.col("ask_volume") + F.col("bid_volume")})
    before = F.lag("price").over(Window.partitionBy("symbol", "date").orderBy("ts", "tick_id"))
    t = t.withColumn("each", ratio(F.col("price") - before, F.when(F.col("side") == "B", F.col("size")).otherwise(-F.col("size"))))
    if large is None:
        edge = t.groupBy("symbol", "date").agg(F.round(F.percentile("size", F.lit(quantile)), 6).alias("edge"))
        t = t.join(edge, ["symbol", "date"])
    else:
        t = t.withColumn("edge", F.lit(large))
    return t.groupBy("symbol", "date", "second").agg(F.avg("each").alias("impact"), F.count_if(F.col("size") >= F.col("edge")).alias("n_large"))


def impact_features(ticks: DataFrame, window: int = 10, base: int = 60, step: int = 1, autocorr_window: int = 10, large: float | None = None) -> DataFrame:
    """Impact elasticity, cluster intensity, sign autocorrelation, realised volatility, flow with its moves, and their product.

    symbol, date, second of every step with trades and those within `window` seconds after one.
    impact_elasticity: median over the window of the steps' mean impact, from three such steps on.
    cluster_intensity: large trades a second over the window.
    sign_autocorr: lag-one correlation of the flow's sign over `autocorr_window` (empty steps are zero, three steps at
    least), averaged over the window.
    realised_vol: population deviation of price changes from step to step.  flow_move: changes times the flow's sign, summed.
    flow_normalised: the day's flow over the absolute flow of `base` seconds, from ten steps on.
    pressure: (buys - sells a second) times realised_vol.
    """
    small = min(autocorr_window, window)
    grid = trade_grid(ticks, step).join(tick_impact(ticks, large, step=step), ["symbol", "date", "second"])
    means = grid.select("symbol", "date", "second", "impact")
    d = dense_grid(grid.drop("impact"), step, (window + small) // step, window // step - 1)
    d = d.join(means, ["symbol", "date", "second"], "left")
    w = Window.partitionBy("symbol", "date").orderBy("second")
    last = lambda c, n: F.sum(c).over(w.rangeBetween(-(n - 1), 0))
    flow = F.col("buy_vol") - F.col("sell_vol")
    # rows next to a gap have no row one step before: their change is zero, and no frame of a live step reaches them
    change = F.coalesce(F.col("price") - F.lag("price").over(w), F.lit(0.0))
    d = d.withColumns({"flow": flow, "sign": F.signum(flow), "change": change, "steps": (F.col("second") - F.col("first_second")) / step + 1})
    d = d.withColumn("sign_before", F.when(F.lag("second").over(w) == F.col("second") - step, F.lag("sign").over(w)))
    x, y = F.when(F.col("sign_before").isNotNull(), F.col("sign")), F.col("sign_before")
    n, sx, sy, sxx, syy, sxy = (last(c, small - step) for c in (F.when(y.isNotNull(), 1), x, y, x * x, y * y, x * y))
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    d = d.withColumn("ac", F.when((F.least(F.col("steps"), F.lit(small // step)) >= 3) & (vx > 0) & (vy > 0), (n * sxy - sx * sy) / F.sqrt(vx * vy)))
    frame = w.rangeBetween(-(window - 1), 0)
    held = F.least(F.col("steps"), F.lit(window // step))
    moved = F.when(F.col("steps") > 1, F.col("change"))
    d = d.withColumns(
        {
            "impact_elasticity": F.when(F.count("impact").over(frame) >= 3, F.percentile("impact", F.lit(0.5)).over(frame)),
            "cluster_intensity": last(F.col("n_large"), window) / window,
            "sign_autocorr": F.avg("ac").over(frame),
            "realised_vol": F.when(held >= 2, F.stddev_pop(moved).over(frame)),
            "flow_move": last(F.col("sign") * F.col("change"), window),
            "flow_normalised": F.when(F.least(F.col("steps"), F.lit(base // step)) >= 10, ratio(F.sum("flow").over(w.rowsBetween(Window.unboundedPreceding, 0)), last(F.abs("flow"), base))),
            "rate_gap": (last(F.col("buy_count"), window) - last(F.col("sell_count"), window)) / window,
        }
    )
    names = ["impact_elasticity", "cluster_intensity", "sign_autocorr", "realised_vol", "flow_move", "flow_normalised"]
    return d.where("live").select("symbol", "date", "second", *names, (F.col("rate_gap") * F.col("realised_vol")).alias("pressure"))


#: The number of each kind of level, in the order in which equally near levels are taken.
LEVELS = {"first_high": 1, "first_low": 2, "vwap": 3, "prior_high": 4, "prior_low": 5, "prior_close": 6, "point_of_control": 7, "value_area_low": 9, "value_area_high": 8}


def mark_sessions(ticks: DataFrame, open_minute: int = 510, close_minute: int = 900) -> DataFrame:
    """ticks with date, is_regular (from open_minute to before close_minute) and part: 0 before, 1 in, 2 after regular hours.

    Regular and overnight hours alternate, so a session is a part of a date.
    """
    minute = F.hour("ts") * 60 + F.minute("ts")
    part = F.when(minute < open_minute, 0).when(minute < close_minute, 1).otherwise(2)
    return ticks.withColumns({"date": F.to_date("ts"), "part": part, "is_regular": (part == 1).cast("int")})


def value_area(profile: DataFrame, keys: list[str], share: float = 0.7, scale: int = 1_000_000) -> DataFrame:
    """keys, poc_bin, low_bin, high_bin: the bin with the most volume, and the range grown from it until it holds the share.

    profile: keys, bin, volume.  The range takes the neighbouring bin with more volume; the upper one wins only if it
    has strictly more.  Bins without trades between the lowest and the highest count as zero.  The growth is a fold over
    one array of a session's bins; volumes are whole millionths, so that it does not depend on the order of sums.
    """
    units = F.round(F.col("volume") * scale).cast("bigint")
    ends = profile.groupBy(*keys).agg(F.min("bin").alias("low"), F.max("bin").alias("high"))
    every = ends.select(*keys, F.explode(F.sequence("low", "high")).alias("bin"))
    filled = every.join(profile.select(*keys, "bin", units.alias("units")), [*keys, "bin"], "left").withColumn("units", F.coalesce("units", F.lit(0).cast("bigint")))
    session = filled.groupBy(*keys).agg(F.min("bin").alias("first_bin"), F.transform(F.sort_array(F.collect_list(F.struct("bin", "units"))), lambda b: b["units"]).alias("v"), F.sum("units").alias("total"))
    session = session.where("total > 0").withColumn("top", (F.array_position("v", F.array_max("v")) - 1).cast("int"))
    none = F.lit(-1).cast("bigint")

    def grow(s, _):
        left, right = F.coalesce(F.get("v", s["lo"] - 1), none), F.coalesce(F.get("v", s["hi"] + 1), none)
        done = (F.lit(1.0) * s["held"] >= F.lit(share) * F.col("total")) | ((left < 0) & (right < 0))
        up = right > left
        more = lambda a, b, c: F.when(done, a).when(up, b).otherwise(c)
        return F.struct(more(s["lo"], s["lo"], s["lo"] - 1).alias("lo"), more(s["hi"], s["hi"] + 1, s["hi"]).alias("hi"), more(s["held"], s["held"] + right, s["held"] + left).alias("held"))

    start = F.struct(F.col("top").alias("lo"), F.col("top").alias("hi"), F.get("v", F.col("top")).alias("held"))
    grown = session.withColumn("area", F.aggregate("v", start, grow))
    return grown.select(*keys, (F.col("first_bin") + F.col("top")).alias("poc_bin"), (F.col("first_bin") + F.col("area.lo")).alias("low_bin"), (F.col("first_bin") + F.col("area.hi")).alias("high_bin"))


def session_levels(ticks: DataFrame, open_minute: int = 510, close_minute: int = 900, first_minutes: int = 60, bin_size: float = 10.0, parts: tuple[int, ...] = (1,), share: float = 0.7) -> DataFrame:
    """symbol, date, part, level, level_type, price: first-hour range, volume-weighted mean, the day before's range and close, point of control, value area.

    Sessions are the parts of a day asked for, by default regular hours.  Levels of the profile are the middles of price
    bins; a session's highest price, where it is a bin's edge, counts to the bin below.  The point of control is the
    lowest of equal ones.  Levels without a value are left out.
    """
    keys = ["symbol", "date", "part"]
    t = mark_sessions(ticks, open_minute, close_minute).withColumn("size", F.col("ask_volume") + F.col("bid_volume"))
    day = t.groupBy("symbol", "date").agg(F.max("price").alias("prior_high"), F.min("price").alias("prior_low"), F.max_by("price", F.struct("ts", "tick_id")).alias("prior_close"))
    s = t.where(F.col("part").isin(*parts))
    start = s.groupBy(*keys).agg(F.min("ts").alias("start"), F.floor(F.min("price") / bin_size).alias("low"), (F.ceil(F.max("price") / bin_size) - 1).alias("top"))
    s = s.join(start, keys)
    early = F.unix_seconds(F.col("ts").cast("timestamp")) <= F.unix_seconds(F.col("start").cast("timestamp")) + 60 * first_minutes
    g = s.groupBy(*keys).agg(
        F.max(F.when(early, F.col("price"))).alias("first_high"),
        F.min(F.when(early, F.col("price"))).alias("first_low"),
        ratio(F.sum(F.col("price") * F.col("size")), F.sum("size")).alias("vwap"),
    )
    bin_ = F.least(F.floor(F.col("price") / bin_size), F.greatest("low", "top"))
    profile = s.groupBy(*keys, bin_.alias("bin")).agg(F.sum("size").alias("volume")).where("bin IS NOT NULL")
    middle = lambda b: (F.col(b) + 0.5) * bin_size
    area = value_area(profile, keys, share).select(*keys, middle("poc_bin").alias("point_of_control"), middle("low_bin").alias("value_area_low"), middle("high_bin").alias("value_area_high"))
    wide = g.join(area, keys, "left").join(day.withColumn("date", F.date_add("date", 1)), ["symbol", "date"], "left")
    long = wide.unpivot(keys, list(LEVELS), "level", "price").where("price IS NOT NULL")
    return long.select(*keys, "level", F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("level")].alias("level_type"), "price")


def nearest_level(prices: DataFrame, levels: DataFrame, band: float, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """Each row of prices with its session's nearest level within the band and the distance; null if there is none.

    A session's levels travel as one array, so each row is joined once and repeated rows stay.  Of equally near levels the
    first in the order of LEVELS is taken.
    """
    order = F.create_map(*[F.lit(x) for i, name in enumerate(LEVELS) for x in (name, i)])
    near = levels.groupBy(*keys).agg(F.collect_list(F.struct(F.coalesce(order[F.col("level")], F.lit(len(LEVELS))).alias("place"), "level", F.col("price").alias("level_price"))).alias("session_levels"))
    apart = lambda v: F.abs(F.col("price") - v["level_price"])
    found = F.filter(F.transform("session_levels", lambda v: F.struct(apart(v).alias("apart"), v["place"].alias("place"), v["level"].alias("level"), v["level_price"].alias("level_price"))), lambda v: v["apart"] <= band)
    out = prices.join(near, list(keys), "left").withColumn("near", F.array_min(found))
    return out.select(*prices.columns, "near.level", "near.level_price", (F.col("price") - F.col("near.level_price")).alias("distance"))


def auction_signals(ticks: DataFrame, levels: DataFrame, tick: float, band_ticks: float = 2, threshold: float = 2.0, window: int = 5, base: int = 120, step: int = 1, open_minute: int = 510, close_minute: int = 900) -> DataFrame:
    """Entries: steps whose price is within the band of a session level while buys or sells arrive unusually fast.

    symbol, date, part, second, price, level, level_price, dist_ticks, lam_buy, lam_sell, z_buy, z_sell, imbalance,
    is_regular, direction (1 where buys are at least as unusual as sells, else -1).  Steps without trades count, with the
    session's last price; they can pass the threshold only within `window` seconds of a trade, so only those are made.
    """
    marked = mark_sessions(ticks, open_minute, close_minute)
    second = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / step) * step).cast("bigint")
    n = marked.groupBy("symbol", "date", second.alias("second")).agg(
        F.count_if(F.col("ask_volume") > 0).alias("buy_count"), F.count_if(F.col("bid_volume") > 0).alias("sell_count"), F.max_by("price", F.struct("ts", "tick_id")).alias("price")
    )
    rates = arrival_rates(dense_grid(n, step, 0, window // step - 1), window, base)
    minute = F.floor((F.col("second") % 86400) / 60)
    part = F.when(minute < open_minute, 0).when(minute < close_minute, 1).otherwise(2)
    unusual = F.greatest("z_buy", "z_sell")
    rates = rates.withColumns({"part": part, "is_regular": (part == 1).cast("int")}).where(unusual >= threshold)
    near = nearest_level(rates, levels, band_ticks * tick, ("symbol", "date", "part")).where("level IS NOT NULL")
    return near.select(
        "symbol", "date", "part", "second", "price", "level", "level_price", (F.col("distance") / tick).alias("dist_ticks"), "lam_buy", "lam_sell", "z_buy", "z_sell", "imbalance", "is_regular",
        F.when(F.col("z_buy") >= F.col("z_sell"), 1).otherwise(-1).alias("direction"),
    )


def auction_labels(entries: DataFrame, ticks: DataFrame, tick: float, target_ticks: float = 8, stop_ticks: float = 6, horizon: int = 180, open_minute: int = 510, close_minute: int = 900) -> DataFrame:
    """entries with y, the result in ticks, exit_ts and exit_kind: the first tick at the target or the stop within the horizon.

    entries: symbol, date, part, second, price, direction.  Ticks from the entry's second to `horizon` seconds later count,
    of the same session.  Target and stop at the same time are a target; without either the entry leaves at the last tick,
    and without any tick y is null.  An entry meets the ticks of the two bins of time that its horizon can touch.
    """
    keys = ["symbol", "date", "part"]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    span = horizon * 1_000_000
    path = mark_sessions(ticks, open_minute, close_minute).select(*keys, at.alias("at"), F.col("price").alias("tick_price"), "tick_id", F.floor(at / span).alias("time_bin"))
    e = entries.select(*keys, "second", "direction", F.col("price").alias("entry"), (F.col("second") * 1_000_000).alias("start")).distinct()
    e = e.withColumn("time_bin", F.explode(F.array(F.floor(F.col("start") / span), F.floor(F.col("start") / span) + 1)))
    met = e.join(path, [*keys, "time_bin"]).where(F.col("at").between(F.col("start"), F.col("start") + span))
    up = F.col("direction") > 0
    gain, loss = target_ticks * tick, stop_ticks * tick
    hit = F.when(up, F.col("tick_price") >= F.col("entry") + gain).otherwise(F.col("tick_price") <= F.col("entry") - gain)
    stopped = F.when(up, F.col("tick_price") <= F.col("entry") - loss).otherwise(F.col("tick_price") >= F.col("entry") + loss)
    first = met.groupBy(*keys, "second", "direction", "entry").agg(
        F.min(F.when(hit, F.col("at"))).alias("hit_at"), F.min(F.when(stopped, F.col("at"))).alias("stop_at"), F.max(F.struct("at", "tick_id", "tick_price")).alias("last")
    )
    won = F.col("hit_at").isNotNull() & (F.col("stop_at").isNull() | (F.col("hit_at") <= F.col("stop_at")))
    moved = (F.col("last.tick_price") - F.col("entry")) * F.col("direction") / tick
    kind = F.when(won, "target").when(F.col("stop_at").isNotNull(), "stop").otherwise("time")
    y = F.when(won, F.lit(float(target_ticks))).when(F.col("stop_at").isNotNull(), F.lit(-float(stop_ticks))).otherwise(moved)
    exit_at = F.when(won, F.col("hit_at")).otherwise(F.coalesce("stop_at", "last.at"))
    out = first.select(*keys, "second", "direction", F.col("entry").alias("price"), y.alias("y"), F.timestamp_micros(exit_at).alias("exit_ts"), kind.alias("exit_kind"))
    return entries.join(out, [*keys, "second", "direction", "price"], "left")


def auction_features(entries: DataFrame) -> DataFrame:
    """Columns for a model of the entries: zmax, imbalance (0 if none), distance, session, kind of level, direction."""
    of = lambda *names: F.col("level").isin(*names).cast("int")
    return entries.withColumns(
        {
            "zmax": F.greatest("z_buy", "z_sell"),
            "imb": F.coalesce("imbalance", F.lit(0.0)),
            "is_vwap": of("vwap"),
            "is_first_hour": of("first_high", "first_low"),
            "is_prior": of("prior_high", "prior_low", "prior_close"),
            "is_profile": of("point_of_control", "value_area_low", "value_area_high"),
        }
    )
