"""Futures curves: expiry rules, sequencing, spreads, term structure, synthetic symbols, and path measures.

A curve is long: symbol, date, contract, price, volume, oi, expiry, dte.  A sequential curve adds seq, 0 for the front.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import backward_fill, by, col, corr, expanding, forward_fill, log_ratio, ratio, rolling, scan
from tidemark.operators.features import returns

DAYS = 365.25


def last_business_day(date: Column | str) -> Column:
    d = F.last_day(col(date))
    return F.date_sub(d, F.greatest(F.weekday(d) - 4, F.lit(0)))


def business_days_before(date: Column | str, n: int) -> Column:
    """The n-th business day before a date."""
    d = col(date)
    days = F.filter(F.transform(F.sequence(F.lit(1), F.lit(2 * n + 5)), lambda k: F.date_sub(d, k)), lambda x: F.weekday(x) < 5)
    return F.element_at(days, n)


def expiry(delivery: Column | str, rule: str = "month_end_before") -> Column:
    """Expiry of the contract that delivers in a month (any date in it).

    crude: three business days before the 25th of the month before; gas: three before the first of the month;
    month_end_before: the last business day of the month before; twentieth: the 20th of the month.
    """
    first = F.trunc(col(delivery), "month")
    before = F.add_months(first, -1)
    if rule == "crude":
        return business_days_before(F.date_add(before, 24), 3)
    if rule == "gas":
        return business_days_before(first, 3)
    if rule == "twentieth":
        return F.date_add(first, 19)
    return last_business_day(before)


def front(curve: DataFrame) -> DataFrame:
    """The priced contract with the least days to expiry from zero on, else the one that expired last within 30 days."""
    ok = curve.where("price IS NOT NULL AND dte >= -30")
    order = F.struct((F.col("dte") < 0).alias("gone"), F.abs("dte").alias("far"), F.col("contract").alias("contract"))
    return ok.groupBy("symbol", "date").agg(F.min_by(F.struct("contract", "price", "dte", "volume"), order).alias("front")).select("symbol", "date", "front.*")


def sequentialise(curve: DataFrame, most: int = 48) -> DataFrame:
    """seq from 0 by days to expiry among priced contracts that have not expired."""
    w = Window.partitionBy("symbol", "date").orderBy("dte", "contract")
    return curve.where("price IS NOT NULL AND dte > 0").withColumn("seq", F.row_number().over(w) - 1).where(F.col("seq") < most)


def spreads_vs_front(seq: DataFrame) -> DataFrame:
    """Each price less the front's, and the next contract's less this one's, with the legs' least volume and interest."""
    w = Window.partitionBy("symbol", "date").orderBy("seq")
    return seq.withColumns(
        {
            "vs_front": F.col("price") - F.first("price").over(w),
            "adjacent": F.lead("price").over(w) - F.col("price"),
            "spread_volume": F.when(F.lead("volume").over(w).isNotNull(), F.least("volume", F.lead("volume").over(w))),
            "spread_oi": F.when(F.lead("oi").over(w).isNotNull(), F.least("oi", F.lead("oi").over(w))),
        }
    )


def synthetic_spot(seq: DataFrame) -> DataFrame:
    """exp of the mean log price weighted by volume over days to expiry plus one."""
    ok = seq.where("volume > 0 AND dte > 0 AND price > 0").withColumn("weight", F.col("volume") / (F.col("dte") + 1))
    return ok.groupBy("symbol", "date").agg(F.exp(F.sum(F.col("weight") * F.ln("price")) / F.sum("weight")).alias("spot"))


def convenience_yield(seq: DataFrame, spot: DataFrame) -> DataFrame:
    """(F - S) / S over the years to expiry."""
    return seq.join(spot, ["symbol", "date"]).withColumn("yield", ratio((F.col("price") - F.col("spot")) / F.col("spot") * DAYS, "dte"))


def maturity_buckets(seq: DataFrame, targets: tuple[int, ...] = (3, 6, 12, 24)) -> DataFrame:
    """Prices nearest to target months and the spreads between neighbouring targets; needs two priced contracts."""
    months = F.col("dte") / 30.4375
    best = [F.min_by("price", F.struct(F.abs(months - t), F.col("seq"))).alias(f"m{t}") for t in targets]
    g = seq.groupBy("symbol", "date").agg(F.count("*").alias("n"), *best).where("n >= 2")
    return g.withColumns({f"spread_{b}_{a}": F.col(f"m{b}") - F.col(f"m{a}") for a, b in zip(targets, targets[1:], strict=False)})


def shape(seq: DataFrame) -> DataFrame:
    """Statistics of each date's curve: slope on position, moments, contango share, convexity, concentration, entropy, roll yield."""
    w = Window.partitionBy("symbol", "date").orderBy("seq")
    x = seq.withColumn("step", F.lead("price").over(w) - F.col("price")).withColumn("bend", F.lead("price").over(w) - 2 * F.col("price") + F.lag("price").over(w))
    x = x.withColumn("share", ratio("volume", F.sum("volume").over(Window.partitionBy("symbol", "date"))))
    second = F.max(F.when(F.col("seq") == 1, F.col("price")))
    first = F.max(F.when(F.col("seq") == 0, F.col("price")))
    gap = F.max(F.when(F.col("seq") == 1, F.col("dte"))) - F.max(F.when(F.col("seq") == 0, F.col("dte")))
    return x.groupBy("symbol", "date").agg(
        F.count("*").alias("n"),
        F.avg("price").alias("mean_price"),
        F.stddev_pop("price").alias("std_price"),
        F.when(F.stddev_pop("price") > 0, F.skewness("price")).alias("skew"),
        F.when(F.stddev_pop("price") > 0, F.kurtosis("price")).alias("kurtosis"),
        F.regr_slope("price", "seq").alias("slope"),
        F.avg((F.col("step") > 0).cast("double")).alias("contango_ratio"),
        F.avg("bend").alias("convexity"),
        F.sum(F.col("share") * F.col("share")).alias("hhi"),
        (-F.sum(F.when(F.col("share") > 0, F.col("share") * F.ln("share")))).alias("entropy"),
        (ratio(first - second, second) * ratio(F.lit(DAYS), gap)).alias("roll_yield"),
    )


def market_structure(slope: Column | str, edge: float = 0.01) -> Column:
    s = col(slope)
    return F.when(s.isNull(), "Unknown").when(s > edge, "Contango").when(s < -edge, "Backwardation").otherwise("Flat")


def spread_series(seq: DataFrame, near: int = 0, far: int = 1) -> DataFrame:
    """Far less near price a date."""
    g = seq.groupBy("symbol", "date").agg(F.max(F.when(F.col("seq") == near, F.col("price"))).alias("near"), F.max(F.when(F.col("seq") == far, F.col("price"))).alias("far"), F.max(F.when(F.col("seq") == near, F.col("dte"))).alias("dte"), F.sum("volume").alias("volume"))
    return g.where("near IS NOT NULL AND far IS NOT NULL").withColumn("spread", F.col("far") - F.col("near"))


def spread_features(spread: DataFrame, window: int = 10) -> DataFrame:
    """Rolling mean and deviation of the available rows."""
    w = by("symbol", "date")
    return spread.withColumn("spread_ma", rolling(F.avg, "spread", w, window, 1)).withColumn("spread_vol", rolling(F.stddev, "spread", w, window, 2))


def spread_pnl(spread: DataFrame, window: int = 20, step: int = 5, size: float = 1.0, multiplier: float = 1.0, fee: float = 0.0, rolls: DataFrame | None = None) -> DataFrame:
    """Profit of holding the spread over windows of `window` rows that start every `step` rows.

    Fees are four a unit; each roll within the holding (symbol, date, confidence, dte) costs
    .01 / max(confidence, .1) * max(1, (15 - dte) / 10) * size * multiplier.
    """
    w = by("symbol", "date")
    x = spread.withColumn("row", F.row_number().over(w) - 1).withColumn("exit_date", F.lead("date", window - 1).over(w)).withColumn("exit_spread", F.lead("spread", window - 1).over(w))
    x = x.where((F.col("row") % step == 0) & F.col("exit_date").isNotNull()).select("symbol", F.col("date").alias("entry_date"), "exit_date", F.col("spread").alias("entry_spread"), "exit_spread")
    cost = F.lit(0.0)
    if rolls is not None:
        each = 0.01 / F.greatest(F.col("confidence"), F.lit(0.1)) * F.greatest(F.lit(1.0), (15 - F.col("roll_dte")) / 10) * size * multiplier
        paid = x.join(rolls.select("symbol", F.col("date").alias("roll_date"), "confidence", F.col("dte").alias("roll_dte")), "symbol").where(F.col("roll_date").between(F.col("entry_date"), F.col("exit_date")))
        paid = paid.groupBy("symbol", "entry_date").agg(F.sum(each).alias("roll_cost"))
        x, cost = x.join(paid, ["symbol", "entry_date"], "left"), F.coalesce(F.col("roll_cost"), F.lit(0.0))
    x = x.withColumn("gross", (F.col("exit_spread") - F.col("entry_spread")) * size * multiplier).withColumn("net", F.col("gross") - 4 * fee * abs(size) - cost)
    days = F.greatest(F.datediff("exit_date", "entry_date"), F.lit(1))
    return x.withColumn("return", ratio("net", F.abs("entry_spread") * abs(size) * multiplier)).withColumn("annualised", F.col("return") * 252 / days)


def snapshots(seq: DataFrame) -> DataFrame:
    """One row a date with the curve as an array in sequence."""
    points = F.sort_array(F.collect_list(F.struct("seq", "contract", "price", "dte", "volume", "oi")))
    return seq.groupBy("symbol", "date").agg(points.alias("points"))


def roll_dates(seq: DataFrame) -> DataFrame:
    """Dates on which the front contract changes, with the days since the last change."""
    w = by("symbol", "date")
    f = seq.where("seq = 0").withColumn("from_contract", F.lag("contract").over(w))
    r = f.where("from_contract IS NOT NULL AND contract <> from_contract").select("symbol", "date", "from_contract", F.col("contract").alias("to_contract"), "dte", F.concat_ws("->", F.col("from_contract").cast("string"), F.col("contract").cast("string")).alias("pattern"))
    return r.withColumn("interval_days", F.datediff("date", F.lag("date").over(w)))


def roll_summary(rolls: DataFrame) -> DataFrame:
    return rolls.groupBy("symbol").agg(F.count("*").alias("n_rolls"), F.avg("interval_days").alias("mean_interval"), F.stddev("interval_days").alias("std_interval"), F.min("interval_days").alias("min_interval"), F.max("interval_days").alias("max_interval"))


def match_front(seq: DataFrame, prices: DataFrame, tolerance: float) -> DataFrame:
    """The contract whose price is nearest to a series' (symbol, date, close) within a relative tolerance, gaps filled both ways."""
    x = prices.join(seq.select("symbol", "date", "contract", "price"), ["symbol", "date"], "left").withColumn("miss", F.abs(F.col("price") - F.col("close")))
    g = x.groupBy("symbol", "date", "close").agg(F.min_by("contract", F.struct("miss", "contract")).alias("contract"), F.min("miss").alias("miss"))
    w = by("symbol", "date")
    g = g.withColumn("contract", F.when(F.col("miss") <= tolerance * F.abs("close"), F.col("contract")))
    return g.withColumn("contract", F.coalesce(forward_fill("contract", w), backward_fill("contract", "symbol", ["date"])))


def confirmed_rolls(fronts: DataFrame, persistence: int = 3, gap_days: int = 5) -> DataFrame:
    """The front after hysteresis: a change holds once it persists, and not within gap_days of the last one."""
    ahead = by("symbol", "date").rowsBetween(0, persistence - 1)
    lasts = (F.count("contract").over(ahead) == persistence) & (F.min("contract").over(ahead) == F.max("contract").over(ahead))
    seen = fronts.select("symbol", "date", "contract").withColumn("lasts", lasts)

    def step(state, contract, day, stays):
        now, last = state
        if now is None:
            now = contract
        elif contract != now and stays and (last is None or (day - last).days >= gap_days):
            now, last = contract, day
        return (now, last), (now,)

    kind = fronts.schema["contract"].dataType.simpleString()
    return scan(seen, ["symbol"], ["date"], ["contract", "date", "lasts"], lambda: (None, None), step, f"confirmed {kind}").drop("lasts")


def continuous(curve: DataFrame, fronts: DataFrame | None = None, method: str = "ratio") -> DataFrame:
    """One unbroken series a symbol: symbol, date, contract, price, adjusted, rolled.

    fronts (symbol, date, contract; by default `front`) tells whose price counts on a date.  Where the contract changes,
    the earlier history is carried over by the quotient of the new contract's price and the old one's on the last date
    of the old ("ratio"), or by their difference ("difference"); with no such price, by those of the date of the change,
    else not at all.  So the latest prices stay as they are and rolls leave no jump.
    """
    w = by("symbol", "date")
    prices = curve.where("price IS NOT NULL").groupBy("symbol", "date", "contract").agg(F.min("price").alias("price"))
    held = (front(curve) if fronts is None else fronts).select("symbol", "date", "contract").join(prices, ["symbol", "date", "contract"])
    held = held.withColumns({"old": F.lag("contract").over(w), "old_date": F.lag("date").over(w), "old_price": F.lag("price").over(w)})
    held = held.withColumn("rolled", F.coalesce(F.col("old") != F.col("contract"), F.lit(False)))
    rolls = held.where("rolled").select("symbol", "date", "contract", "old", "old_date", "old_price", F.col("price").alias("new_price"))
    at_old = prices.select("symbol", F.col("date").alias("old_date"), "contract", F.col("price").alias("new_then"))
    at_new = prices.select("symbol", "date", F.col("contract").alias("old"), F.col("price").alias("old_now"))
    rolls = rolls.join(at_old, ["symbol", "old_date", "contract"], "left").join(at_new, ["symbol", "date", "old"], "left")
    if method == "ratio":
        step = F.coalesce(log_ratio("new_then", "old_price"), log_ratio("new_price", "old_now"), F.lit(0.0))
    else:
        step = F.coalesce(F.col("new_then") - F.col("old_price"), F.col("new_price") - F.col("old_now"), F.lit(0.0))
    out = held.join(rolls.select("symbol", "date", step.alias("step")), ["symbol", "date"], "left")
    later = F.coalesce(F.sum("step").over(by("symbol", F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    adjusted = F.col("price") * F.exp("later") if method == "ratio" else F.col("price") + F.col("later")
    return out.withColumn("later", later).select("symbol", "date", "contract", "price", adjusted.alias("adjusted"), "rolled")


def synthetic(bars: DataFrame, legs: list[tuple[str, float]], columns: tuple[str, ...] = ("close",), align: str = "intersection", keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """Weighted sum of legs' columns; with "intersection" only at times that all legs have, with "union" a missing leg counts zero."""
    dim = bars.sparkSession.createDataFrame(legs, "symbol string, weight double")
    g = bars.join(F.broadcast(dim), "symbol").groupBy(*keys).agg(F.count_distinct("symbol").alias("n_legs"), *[F.sum(F.col("weight") * F.col(c)).alias(c) for c in columns])  # a row a leg
    return (g.where(F.col("n_legs") == len(legs)) if align == "intersection" else g).drop("n_legs")


def price_ratio(bars: DataFrame, numerator: str, denominator: str) -> DataFrame:
    a = bars.where(F.col("symbol") == numerator).select("date", F.col("close").alias("a"))
    b = bars.where(F.col("symbol") == denominator).select("date", F.col("close").alias("b"))
    return a.join(b, "date").select("date", ratio("a", "b").alias("ratio")).where("ratio IS NOT NULL")


def aligned_tenors(seq: DataFrame, legs: list[tuple[str, float]], months: list[int]) -> DataFrame:
    """A spread across symbols at target months: each leg's contract nearest to the target, null legs leave the date out."""
    targets = seq.sparkSession.createDataFrame([(m,) for m in months], "target int")
    dim = seq.sparkSession.createDataFrame(legs, "symbol string, weight double")
    x = seq.join(F.broadcast(dim), "symbol").crossJoin(F.broadcast(targets))  # a row a leg and a row a target
    miss = F.struct(F.abs(F.col("dte") / 30.4375 - F.col("target")), F.col("seq"))
    g = x.groupBy("symbol", "weight", "date", "target").agg(F.min_by("price", miss).alias("price"))
    return g.groupBy("date", "target").agg(F.count("price").alias("n"), F.sum(F.col("weight") * F.col("price")).alias("value")).where(F.col("n") == len(legs)).drop("n")


#: Pounds in a bushel, and metric tons in a unit.
BUSHEL_POUNDS = {"corn": 56.0, "soybeans": 60.0, "wheat": 60.0, "oats": 32.0}
TONS = {"pound": 0.00045359237, "kilogram": 0.001, "short_ton": 0.90718474, "metric_ton": 1.0}


def convert_units(df: DataFrame, value: str, from_unit: str, to_unit: str, commodity: str | None = None) -> DataFrame:
    """A value in other mass units; bushels by the commodity's weight."""
    tons = lambda u: BUSHEL_POUNDS[commodity] * TONS["pound"] if u == "bushel" else TONS[u]
    return df.withColumn(value, F.col(value) * (tons(from_unit) / tons(to_unit)))


def constant_maturity(curve: DataFrame, taus: list[float], method: str = "linear") -> DataFrame:
    """ln price at each tau, in years to expiry: linear between points, or a cubic through the four around tau.

    "cubic" is the natural spline over the two points on either side of tau, three points at the ends of the curve; with
    fewer than four points in all it is linear.  Beyond the ends the outer segment goes on, its line or its cubic; one
    point is flat.  Of points with the same time to expiry the lowest price counts.
    """
    t = F.col("dte") / DAYS
    priced = curve.where("price > 0 AND dte > 0").groupBy("symbol", "date", t.alias("t")).agg(F.ln(F.min("price")).alias("y"))
    points = priced.groupBy("symbol", "date").agg(F.sort_array(F.collect_list(F.struct("t", "y"))).alias("p"))
    x = points.select("symbol", "date", "p", F.size("p").alias("n"), F.explode(F.array(*map(F.lit, taus))).alias("tau"))
    # the segment that holds tau, or the outer one: its upper point, counted from 0
    k = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.size(F.filter("p", lambda q: q["t"] < F.col("tau")))))
    x = x.withColumn("k", k.cast("int")).withColumns({f"q{i}": F.get("p", F.col("k") + i - 2) for i in range(4)})
    t0, t1, t2, t3 = (F.col(f"q{i}.t") for i in range(4))
    y0, y1, y2, y3 = (F.col(f"q{i}.y") for i in range(4))
    h0, h1, h2 = t1 - t0, t2 - t1, t3 - t2
    d0, d1, d2 = (y1 - y0) / h0, (y2 - y1) / h1, (y3 - y2) / h2
    at = F.col("tau")
    line = y1 + d1 * (at - t1)
    # second derivatives at the segment's ends; those at the outermost points are zero
    first, last = F.col("k") == 1, F.col("k") == F.col("n") - 1
    whole = (h0 + h1) * (h1 + h2) / 9 - h1 * h1 / 36
    m1 = F.when(first, 0.0).when(last, 3 * (d1 - d0) / (h0 + h1)).otherwise(((d1 - d0) * (h1 + h2) / 3 - (d2 - d1) * h1 / 6) / whole)
    m2 = F.when(last, 0.0).when(first, 3 * (d2 - d1) / (h1 + h2)).otherwise(((d2 - d1) * (h0 + h1) / 3 - (d1 - d0) * h1 / 6) / whole)
    left, right = t2 - at, at - t1
    cubic = (m1 * left * left * left + m2 * right * right * right) / (6 * h1) + (y1 / h1 - m1 * h1 / 6) * left + (y2 / h1 - m2 * h1 / 6) * right
    value = F.when(F.col("n") == 1, F.col("p")[0]["y"])
    value = value.when(F.col("n") >= 4, cubic).otherwise(line) if method == "cubic" else value.otherwise(line)
    return x.select("symbol", "date", "tau", value.alias("ln_f"))


def tenor_breaks(panel: DataFrame, most: float = 0.2) -> DataFrame:
    """Rows whose log price jumps by more than `most` from the row before of the same tenor."""
    w = by(["symbol", "tau"], "date")
    return panel.withColumn("jump", F.col("ln_f") - F.lag("ln_f").over(w)).where(F.abs("jump") > most)


def carry(seq: DataFrame, spot: DataFrame, rate: float = 0.03, storage: float = 0.01) -> DataFrame:
    """Implied carry ln(F / S) / tau, what it leaves after financing and storage, and the roll yield to the next contract."""
    w = Window.partitionBy("symbol", "date").orderBy("seq")
    tau = F.col("dte") / DAYS
    x = seq.join(spot, ["symbol", "date"]).withColumn("carry", ratio(log_ratio("price", "spot"), tau))
    x = x.withColumn("convenience", rate + storage - F.col("carry"))
    return x.withColumn("roll_yield", ratio(log_ratio("price", F.lead("price").over(w)), (F.lead("dte").over(w) - F.col("dte")) / DAYS))


def levy_area(pairs: DataFrame, x: str, y: str, window: int) -> DataFrame:
    """Signed area between two log paths over the `window` rows before each row: half the sum of Xm dY - Ym dX; null with gaps.

    X and Y count from the window's first row, so the sum over increments takes three window sums and the first values.
    """
    w = by("symbol", "date")
    z = pairs.withColumns({"lx": F.ln(x), "ly": F.ln(y)})
    z = z.withColumns({"dx": F.col("lx") - F.lag("lx").over(w), "dy": F.col("ly") - F.lag("ly").over(w)})
    # mid point times increment, taken from the path before centring
    z = z.withColumn("xdy", (F.col("lx") - F.col("dx") / 2) * F.col("dy")).withColumn("ydx", (F.col("ly") - F.col("dy") / 2) * F.col("dx"))
    frame = w.rowsBetween(-(window - 1), -1)
    x0, y0 = F.lag("lx", window).over(w), F.lag("ly", window).over(w)
    area = 0.5 * (F.sum("xdy").over(frame) - x0 * F.sum("dy").over(frame) - F.sum("ydx").over(frame) + y0 * F.sum("dx").over(frame))
    return z.withColumn("levy_area", F.when((F.count("xdy").over(frame) == window - 1) & x0.isNotNull(), area)).drop("xdy", "ydx")


def path_variation(pairs: DataFrame, x: str, y: str, window: int) -> DataFrame:
    """Length of the two-dimensional log path over the `window` rows before each row."""
    w = by("symbol", "date")
    z = pairs.withColumns({"dx": log_ratio(x, F.lag(x).over(w)), "dy": log_ratio(y, F.lag(y).over(w))})
    frame = w.rowsBetween(-(window - 1), -1)
    step = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    z = z.withColumn("step", step)
    return z.withColumn("path_length", F.when(F.count("step").over(frame) == window - 1, F.sum("step").over(frame))).drop("step")


def signature_levels(pairs: DataFrame, x: str, y: str, window: int, levels: int = 3) -> DataFrame:
    """pairs with level_1 .. level_n of the two log paths over the `window` rows before each row.

    Level 1 is the change of y less that of x, level 2 the signed area of `levy_area`, each later one the product of the
    level before it with its own previous row.  Null with gaps.
    """
    w = by("symbol", "date")
    z = levy_area(pairs, x, y, window).withColumn("gap", F.ln(y) - F.ln(x))
    frame = w.rowsBetween(-window, -1)
    z = z.withColumn("level_1", F.when(F.count("gap").over(frame) == window, F.lag("gap", 1).over(w) - F.lag("gap", window).over(w))).withColumn("level_2", F.col("levy_area"))
    for n in range(3, levels + 1):
        z = z.withColumn(f"level_{n}", F.col(f"level_{n - 1}") * F.lag(f"level_{n - 1}").over(w))
    return z.drop("gap", "levy_area", "lx", "ly", "dx", "dy")


def leadership(seq: DataFrame, window: int, split: int) -> tuple[DataFrame, DataFrame]:
    """Which end of the curve leads: by symbol and date front_area, back_area and their difference, and each symbol's shares.

    The signed area between neighbouring contracts (seq and seq + 1, on dates that have both) is positive where the
    nearer one leads; front_area is its mean over pairs below `split`, back_area over those from it on.  The second
    table has the share of dates on which the front leads, and the back.
    """
    w = Window.partitionBy("symbol", "date").orderBy("seq")
    pairs = seq.withColumns({"far": F.lead("price").over(w), "far_seq": F.lead("seq").over(w)}).where((F.col("far_seq") == F.col("seq") + 1) & (F.col("price") > 0) & (F.col("far") > 0))
    keyed = pairs.select(F.concat_ws("|", "symbol", F.col("seq").cast("string")).alias("symbol"), F.col("symbol").alias("name"), "seq", "date", F.col("price").alias("near"), "far")
    areas = levy_area(keyed, "near", "far", window).where("levy_area IS NOT NULL")
    by_date = areas.groupBy(F.col("name").alias("symbol"), "date").agg(F.avg(F.when(F.col("seq") < split, F.col("levy_area"))).alias("front_area"), F.avg(F.when(F.col("seq") >= split, F.col("levy_area"))).alias("back_area"))
    by_date = by_date.withColumn("leadership", F.col("front_area") - F.col("back_area"))
    shares = by_date.where("leadership IS NOT NULL").groupBy("symbol").agg(F.avg((F.col("leadership") > 0).cast("double")).alias("front_leads"), F.avg((F.col("leadership") < 0).cast("double")).alias("back_leads"), F.count("*").alias("n"))
    return by_date, shares


def regime_transitions(states: DataFrame, state: str) -> DataFrame:
    """symbol, from_state, to_state, n and share of the moves out of from_state, from one row a symbol and date to the next."""
    w = by("symbol", "date")
    moves = states.withColumn("from_state", F.lag(state).over(w)).where("from_state IS NOT NULL").groupBy("symbol", "from_state", F.col(state).alias("to_state")).agg(F.count("*").alias("n"))
    return moves.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("symbol", "from_state")))


def sign_changes(df: DataFrame, value: str, confirm: int = 3) -> DataFrame:
    """Rows where the sign changes and no row of the next `confirm` has the old sign (zeros allowed)."""
    w = by("symbol", "date")
    s = F.signum(value)
    x = df.withColumn("sign", s).withColumn("before", F.lag("sign").over(w))
    ahead = w.rowsBetween(0, confirm - 1)
    up = F.min("sign").over(ahead) >= 0
    down = F.max("sign").over(ahead) <= 0
    full = F.count("sign").over(ahead) == confirm
    x = x.withColumn("changed", (F.col("sign") != 0) & (F.col("before") * F.col("sign") < 0) & full & F.when(F.col("sign") > 0, up).otherwise(down))
    return x.where("changed").drop("changed")


def slope_flips(shapes: DataFrame, threshold: float = 2.0, least: int = 60, least_days: int = 5) -> DataFrame:
    """Islands of |slope change| whose expanding z exceeds the threshold, of at least least_days; the open last one is left out."""
    w = by("symbol", "date")
    x = shapes.withColumn("move", F.abs(F.col("slope") - F.lag("slope").over(w)))
    z = ratio(F.col("move") - expanding(F.avg, "move", w, least), expanding(F.stddev, "move", w, least))
    x = x.withColumn("hot", F.coalesce(z > threshold, F.lit(False)))
    x = x.withColumn("island", F.sum((F.col("hot") != F.coalesce(F.lag("hot").over(w), F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max("date").over(Window.partitionBy("symbol"))
    g = x.withColumn("last", last).where("hot").groupBy("symbol", "island").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n"), F.first("last").alias("last"))
    return g.where((F.datediff("end", "start") >= least_days) & (F.col("end") < F.col("last"))).select("symbol", "start", "end", "n")


def seasonal_statistics(df: DataFrame, value: str, key: Column, name: str = "season") -> DataFrame:
    g = df.where(F.col(value).isNotNull()).withColumn(name, key).groupBy("symbol", name)
    q = lambda p: F.percentile(value, F.lit(p))
    return g.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), q(0.5).alias("median"), F.min(value).alias("low"), F.max(value).alias("high"), F.stddev(value).alias("std"), q(0.25).alias("q25"), q(0.75).alias("q75"))


def seasonal_driver(df: DataFrame, value: str, month_least: int = 10, all_least: int = 50) -> DataFrame:
    """|z| of a magnitude against strictly earlier rows of its calendar month, else against all earlier ones."""
    m = Window.partitionBy("symbol", F.month("date")).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    a = by("symbol", "date").rowsBetween(Window.unboundedPreceding, -1)
    z = lambda f: F.abs(ratio(F.col(value) - F.avg(value).over(f), F.stddev(value).over(f)))
    return df.withColumn("driver", F.when(F.count(value).over(m) >= month_least, z(m)).when(F.count(value).over(a) >= all_least, z(a)).otherwise(0.0))


def seasonal_strength(df: DataFrame, value: str, lags: tuple[int, ...] = (21, 63, 126, 252)) -> DataFrame:
    """Correlations of a series with itself at seasonal lags, and the largest in size."""
    w = by("symbol", "date")
    x = df.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in lags})
    g = x.groupBy("symbol").agg(F.count(value).alias("n"), *[corr(value, f"lag_{k}").alias(f"ac_{k}") for k in lags]).where(F.col("n") >= 252)
    return g.withColumn("strength", F.greatest(*[F.abs(f"ac_{k}") for k in lags]))


def liquidity_measures(spread: DataFrame, price: str = "near") -> DataFrame:
    """Roll's spread 2 sqrt(-cov of neighbouring changes), Amihud's mean |return| over volume, Kyle's slope on volume."""
    w = by("symbol", "date")
    x = spread.withColumn("change", F.col(price) - F.lag(price).over(w)).withColumn("before", F.lag("change").over(w)).withColumn("ret", log_ratio(price, F.lag(price).over(w)))
    cov = F.covar_samp("change", "before")
    return x.groupBy("symbol").agg(F.when(cov < 0, 2 * F.sqrt(-cov)).otherwise(0.0).alias("roll_spread"), F.avg(F.abs("ret") / (F.col("volume") + 1)).alias("amihud"), F.when(F.count("ret") > 20, F.regr_slope(F.abs("change"), F.col("volume"))).alias("kyle"))


def pca(panel: DataFrame, components: int = 3) -> DataFrame:
    """Loadings and explained shares of each symbol's constant-maturity panel, months' means removed.

    The sums of cross products are aggregated in Spark; a symbol's tenor-by-tenor matrix, small by construction, is
    decomposed in a group.
    """
    x = panel.withColumn("v", F.col("ln_f") - F.avg("ln_f").over(Window.partitionBy("symbol", "tau", F.month("date"))))
    a, b = x.select("symbol", "date", F.col("tau").alias("ta"), F.col("v").alias("va")), x.select("symbol", "date", F.col("tau").alias("tb"), F.col("v").alias("vb"))
    cov = a.join(b, ["symbol", "date"]).groupBy("symbol", "ta", "tb").agg(F.covar_samp("va", "vb").alias("c"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="ta", columns="tb", values="c").sort_index().sort_index(axis=1).fillna(0.0)
        values, vectors = np.linalg.eigh(m.to_numpy())
        rows = []
        for k, i in enumerate(np.argsort(-values)[:components]):
            v = vectors[:, i] * (1 if vectors[np.argmax(np.abs(vectors[:, i])), i] > 0 else -1)
            rows += [(pdf["symbol"].iloc[0], k, float(t), float(x), float(values[i] / max(values.sum(), 1e-300))) for t, x in zip(m.index, v, strict=True)]
        return pd.DataFrame(rows, columns=["symbol", "component", "tau", "loading", "explained"])

    return cov.groupBy("symbol").applyInPandas(run, "symbol string, component int, tau double, loading double, explained double")


def curve_returns(seq: DataFrame) -> DataFrame:
    """Log change of each sequential contract's price."""
    x = seq.select(F.concat_ws("_", "symbol", F.col("seq").cast("string")).alias("symbol"), "date", F.col("price").alias("close"))
    return returns(x)


#: The kinds of curve tables.  Those of the second row have one number a contract in sequence, of the third one a date.
CURVE_TYPES = [
    "curve", "volume_curve", "oi_curve", "dte",
    "seq_curve", "seq_volume", "seq_oi", "seq_labels", "seq_dte", "seq_spreads",
    "front", "spot", "roll_dates",
]


def curve_tables(curve: DataFrame, types: list[str] | None = None, start: str | None = None, end: str | None = None, symbols: list[str] | None = None) -> DataFrame:
    """The curve tables asked for (all by default) as one: symbol, date, curve_type, seq, contract, value.

    seq is null outside the tables in sequence, contract is text, value is null for labels.  Days `start` and `end` count.
    Contracts are put in sequence by one window and dealt to their tables by one explode; only spot and roll dates take more.
    Roll dates need the day before, so the first day of the span is none.
    """
    types = CURVE_TYPES if types is None else types
    unknown = sorted(set(types) - set(CURVE_TYPES))
    if unknown:
        raise ValueError(f"No such curve tables: {unknown}; there are {CURVE_TYPES}")
    x = curve if symbols is None else curve.where(F.col("symbol").isin(symbols))
    x = x if start is None else x.where(F.col("date") >= F.lit(start).cast("date"))
    x = x if end is None else x.where(F.col("date") <= F.lit(end).cast("date"))
    live = F.col("price").isNotNull() & (F.col("dte") > 0)
    w = Window.partitionBy("symbol", "date", live).orderBy("dte", "contract")
    x = x.withColumn("seq", F.when(live, F.row_number().over(w) - 1)).withColumn("adjacent", F.when(live, F.lead("price").over(w) - F.col("price")))
    number = {"curve": "price", "volume_curve": "volume", "oi_curve": "oi", "dte": "dte", "seq_curve": "price", "seq_volume": "volume", "seq_oi": "oi", "seq_dte": "dte", "seq_spreads": "adjacent"}

    def row(kind: str) -> Column:
        seq = F.col("seq") if kind.startswith("seq_") else F.lit(None).cast("int")
        value = F.col(number[kind]).cast("double") if kind in number else F.lit(None).cast("double")
        have = F.col("seq").isNotNull() if kind == "seq_labels" else value.isNotNull() & (seq.isNotNull() if kind.startswith("seq_") else F.lit(True))
        return F.when(have, F.struct(F.lit(kind).alias("curve_type"), seq.alias("seq"), F.col("contract").cast("string").alias("contract"), value.alias("value")))

    shape = ["symbol", "date", "curve_type", "seq", "contract", "value"]
    tables = []
    if dealt := [row(t) for t in types if t in number or t == "seq_labels"]:
        tables.append(x.select("symbol", "date", F.explode(F.array_compact(F.array(*dealt))).alias("p")).select("symbol", "date", "p.*"))
    none = F.lit(None).cast("int").alias("seq")
    if "front" in types:
        tables.append(front(x).select("symbol", "date", F.lit("front").alias("curve_type"), none, F.col("contract").cast("string").alias("contract"), "price"))
    if "spot" in types:
        tables.append(synthetic_spot(x.where("seq IS NOT NULL")).select("symbol", "date", F.lit("spot").alias("curve_type"), none, F.lit(None).cast("string").alias("contract"), "spot"))
    if "roll_dates" in types:
        tables.append(roll_dates(x).select("symbol", "date", F.lit("roll_dates").alias("curve_type"), none, F.col("pattern").alias("contract"), F.col("interval_days").cast("double")))
    out = tables[0].toDF(*shape)
    for t in tables[1:]:
        out = out.union(t.toDF(*shape))
    return out


def curve_summary(tables: DataFrame) -> DataFrame:
    """Rows, days and span of each symbol's curve tables."""
    return tables.groupBy("symbol", "curve_type").agg(F.count("*").alias("n_rows"), F.count_distinct("date").alias("n_days"), F.min("date").alias("first"), F.max("date").alias("last"))
