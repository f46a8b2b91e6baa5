"""Queries: futures curves and spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import curves
from tidemark.plans.registry import R, query, r, rounded
from tidemark.sources.tables import BARS, CURVE, curve, daily_bars

SEQ = f"""{CURVE}, seq AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol, date ORDER BY dte, contract) - 1 AS INTEGER) AS seq FROM curve WHERE price IS NOT NULL AND dte > 0)"""
SPREAD = f"""{SEQ}, sp0 AS (SELECT symbol, date, max(CASE WHEN seq = 0 THEN price END) AS near, max(CASE WHEN seq = 1 THEN price END) AS far, max(CASE WHEN seq = 0 THEN dte END) AS dte, sum(volume) AS volume FROM seq GROUP BY 1, 2),
    sp AS (SELECT *, far - near AS spread FROM sp0 WHERE near IS NOT NULL AND far IS NOT NULL)"""
SPOT = f"""{SEQ}, spot AS (SELECT symbol, date, exp(sum(volume / (dte + 1) * ln(price)) / sum(volume / (dte + 1))) AS spot FROM seq WHERE volume > 0 AND price > 0 GROUP BY 1, 2)"""
W = "OVER (PARTITION BY symbol ORDER BY date)"


def _seq(spark, sf):
    return curves.sequentialise(curve(spark, sf))


def _spread(spark, sf):
    return curves.spread_series(_seq(spark, sf))


@query("""WITH d AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders),
    x AS (SELECT m, CAST(m - INTERVAL 1 DAY AS DATE) AS e FROM d) SELECT m AS month, e - CAST(greatest(isodow(e) - 5, 0) AS INTEGER) AS month_end_before, m + 19 AS twentieth,
    (SELECT day FROM (SELECT CAST(m - k AS DATE) AS day, row_number() OVER (ORDER BY k) AS n FROM (SELECT unnest(range(1, 12))::INTEGER AS k) WHERE isodow(m - k) <= 5) WHERE n = 3) AS gas FROM x""")
def expiry_rules(spark: SparkSession, sf: str) -> DataFrame:
    m = spark.read.parquet(f"{sf}/orders.parquet").select(F.trunc("o_orderdate", "month").alias("month")).distinct()
    return m.select("month", curves.expiry("month").alias("month_end_before"), curves.expiry("month", "twentieth").alias("twentieth"), curves.expiry("month", "gas").alias("gas"))


@query(f"WITH {CURVE} SELECT symbol, date, contract, expiry, CAST(dte AS INTEGER) AS dte FROM curve")
def days_to_expiry(spark: SparkSession, sf: str) -> DataFrame:
    return curve(spark, sf).select("symbol", "date", "contract", "expiry", "dte")


@query(f"WITH {SEQ} SELECT symbol, date, contract, {R('price', 9)} AS price FROM seq WHERE seq = 0")
def front_contract(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.front(curve(spark, sf)).select("symbol", "date", "contract", "price"), "price", digits=9)


@query(f"WITH {SEQ} SELECT symbol, date, contract, seq, {R('price', 9)} AS price FROM seq")
def sequential_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_seq(spark, sf).select("symbol", "date", "contract", "seq", "price"), "price", digits=9)


@query(f"""WITH {SEQ} SELECT symbol, date, seq, {R("price - first_value(price) OVER w", 9)} AS vs_front, {R("lead(price) OVER w - price", 9)} AS adjacent, least(volume, lead(volume) OVER w) + 0.0 * lead(volume) OVER w AS spread_volume FROM seq WINDOW w AS (PARTITION BY symbol, date ORDER BY seq)""")
def curve_spreads(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.spreads_vs_front(_seq(spark, sf)).select("symbol", "date", "seq", "vs_front", "adjacent", "spread_volume"), "vs_front", "adjacent", digits=9)


@query(f"WITH {SPOT} SELECT symbol, date, {R('spot')} AS spot FROM spot")
def synthetic_spot(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.synthetic_spot(_seq(spark, sf)), "spot")


@query(f"""WITH {SPOT} SELECT symbol, date, seq, {R("(price - spot) / spot * 365.25 / dte")} AS "yield", {R("ln(price / spot) / (dte / 365.25)")} AS carry FROM seq JOIN spot USING (symbol, date)""")
def carry_and_convenience(spark: SparkSession, sf: str) -> DataFrame:
    s = _seq(spark, sf)
    spot = curves.synthetic_spot(s)
    a = curves.convenience_yield(s, spot).select("symbol", "date", "seq", "yield")
    return rounded(a.join(curves.carry(s, spot).select("symbol", "date", "seq", "carry"), ["symbol", "date", "seq"]), "yield", "carry")


@query(f"""WITH {SEQ}, m AS (SELECT symbol, date, count(*) AS n, arg_min(price, abs(dte / 30.4375 - 3) * 1000 + seq * 1e-6) AS m3, arg_min(price, abs(dte / 30.4375 - 6) * 1000 + seq * 1e-6) AS m6 FROM seq GROUP BY 1, 2)
    SELECT symbol, date, {R("m3", 9)} AS m3, {R("m6", 9)} AS m6, {R("m6 - m3", 9)} AS spread_6_3 FROM m WHERE n >= 2""")
def maturity_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.maturity_buckets(_seq(spark, sf), (3, 6)).drop("n"), "m3", "m6", "spread_6_3", digits=9)


@query(f"""WITH {SEQ}, x AS (SELECT *, lead(price) OVER w - price AS step, lead(price) OVER w - 2 * price + lag(price) OVER w AS bend, volume / sum(volume) OVER (PARTITION BY symbol, date) AS share FROM seq WINDOW w AS (PARTITION BY symbol, date ORDER BY seq))
    SELECT symbol, date, count(*) AS n, {R("avg(price)")} AS mean_price, {R("stddev_pop(price)")} AS std_price, {R("CASE WHEN count(*) > 1 THEN regr_slope(price, seq) END", 5)} AS slope, {R("avg(CASE WHEN step > 0 THEN 1.0 WHEN step IS NOT NULL THEN 0.0 END)")} AS contango_ratio, {R("avg(bend)", 5)} AS convexity,
           {R("sum(share * share)")} AS hhi, {R("-sum(share * ln(share))")} AS entropy FROM x GROUP BY 1, 2""")
def curve_shape(spark: SparkSession, sf: str) -> DataFrame:
    out = curves.shape(_seq(spark, sf)).drop("skew", "kurtosis", "roll_yield")
    return rounded(rounded(out, "mean_price", "std_price", "contango_ratio", "hhi", "entropy"), "slope", "convexity", digits=5)


@query(f"""WITH {SEQ}, s AS (SELECT symbol, date, CASE WHEN count(*) > 1 THEN regr_slope(price, seq) END AS slope FROM seq GROUP BY 1, 2)
    SELECT symbol, CASE WHEN slope IS NULL THEN 'Unknown' WHEN slope > 0.01 THEN 'Contango' WHEN slope < -0.01 THEN 'Backwardation' ELSE 'Flat' END AS structure, count(*) AS n_days FROM s GROUP BY 1, 2""")
def market_structure_days(spark: SparkSession, sf: str) -> DataFrame:
    s = curves.shape(_seq(spark, sf)).select("symbol", curves.market_structure("slope").alias("structure"))
    return s.groupBy("symbol", "structure").agg(F.count("*").alias("n_days"))


_R10 = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query(f"WITH {SPREAD} SELECT symbol, date, {R('spread')} AS spread, {R(f'avg(spread) {_R10}')} AS spread_ma, {R(f'stddev(spread) {_R10}')} AS spread_vol FROM sp")
def spread_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.spread_features(_spread(spark, sf)).select("symbol", "date", "spread", "spread_ma", "spread_vol"), "spread", "spread_ma", "spread_vol")


@query(f"""WITH {SPREAD}, x AS (SELECT symbol, date, spread, row_number() {W} - 1 AS row, lead(date, 19) {W} AS exit_date, lead(spread, 19) {W} AS exit_spread FROM sp)
    SELECT symbol, date AS entry_date, exit_date, {R("(exit_spread - spread) * 1000")} AS gross, {R("(exit_spread - spread) * 1000 - 10")} AS net FROM x WHERE row % 5 = 0 AND exit_date IS NOT NULL""")
def spread_pnl(spark: SparkSession, sf: str) -> DataFrame:
    out = curves.spread_pnl(_spread(spark, sf), 20, 5, multiplier=1000.0, fee=2.5)
    return rounded(out.select("symbol", "entry_date", "exit_date", "gross", "net"), "gross", "net")


@query(f"""WITH {SEQ} SELECT symbol, date, count(*) AS n_points, max(seq) AS last_seq, {R("max(CASE WHEN seq = 0 THEN price END)", 9)} AS first_price FROM seq GROUP BY 1, 2""")
def curve_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    s = curves.snapshots(_seq(spark, sf))
    return s.select("symbol", "date", F.size("points").cast("bigint").alias("n_points"), F.element_at("points", -1)["seq"].alias("last_seq"), r(F.col("points")[0]["price"], 9).alias("first_price"))


_ROLLS = f"""{SEQ}, f AS (SELECT symbol, date, contract, dte, lag(contract) {W} AS b FROM seq WHERE seq = 0), rl AS (SELECT symbol, date, b AS from_contract, contract AS to_contract, CAST(dte AS INTEGER) AS dte, b || '->' || contract AS pattern FROM f WHERE b IS NOT NULL AND b <> contract),
    ri AS (SELECT *, CAST(date - lag(date) {W} AS INTEGER) AS interval_days FROM rl)"""


@query(f"WITH {_ROLLS} SELECT * FROM ri")
def roll_dates(spark: SparkSession, sf: str) -> DataFrame:
    return curves.roll_dates(_seq(spark, sf))


@query(f"WITH {_ROLLS} SELECT symbol, count(*) AS n_rolls, {R('avg(interval_days)')} AS mean_interval, {R('stddev(interval_days)')} AS std_interval, min(interval_days) AS min_interval, max(interval_days) AS max_interval FROM ri GROUP BY 1")
def roll_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.roll_summary(curves.roll_dates(_seq(spark, sf))), "mean_interval", "std_interval")


@query(f"""WITH RECURSIVE {SEQ}, f AS (SELECT symbol, date, contract, row_number() {W} AS i, count(*) OVER a = 3 AND min(contract) OVER a = max(contract) OVER a AS lasts FROM seq WHERE seq = 0
        WINDOW a AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
    c AS (SELECT symbol, date, contract, i, contract AS confirmed, NULL::DATE AS changed FROM f WHERE i = 1
        UNION ALL SELECT f.symbol, f.date, f.contract, f.i, CASE WHEN f.contract <> c.confirmed AND f.lasts AND (c.changed IS NULL OR f.date - c.changed >= 5) THEN f.contract ELSE c.confirmed END,
            CASE WHEN f.contract <> c.confirmed AND f.lasts AND (c.changed IS NULL OR f.date - c.changed >= 5) THEN f.date ELSE c.changed END FROM c JOIN f ON f.symbol = c.symbol AND f.i = c.i + 1)
    SELECT symbol, date, contract, confirmed FROM c""")
def confirmed_front(spark: SparkSession, sf: str) -> DataFrame:
    return curves.confirmed_rolls(_seq(spark, sf).where("seq = 0"))


@query(f"""WITH {SEQ}, h AS (SELECT symbol, date, contract, price, lag(contract) {W} AS old, lag(date) {W} AS od, lag(price) {W} AS op FROM seq WHERE seq = 0),
    r AS (SELECT h.*, CASE WHEN old <> h.contract THEN coalesce(a.price / op, h.price / b.price, 1) END AS q FROM h LEFT JOIN curve a ON a.symbol = h.symbol AND a.date = od AND a.contract = h.contract LEFT JOIN curve b ON b.symbol = h.symbol AND b.date = h.date AND b.contract = old)
    SELECT symbol, date, contract, coalesce(old <> contract, false) AS rolled, {R("ln(price * coalesce(exp(sum(ln(q)) OVER (PARTITION BY symbol ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1))", 5)} AS ln_adjusted FROM r""")
def continuous_series(spark: SparkSession, sf: str) -> DataFrame:
    c = curve(spark, sf)
    out = curves.continuous(c, curves.sequentialise(c).where("seq = 0"))
    return rounded(out.select("symbol", "date", "contract", "rolled", F.ln("adjusted").alias("ln_adjusted")), "ln_adjusted", digits=5)


@query(f"""WITH {BARS} SELECT date, {R("sum(CASE symbol WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN -2 ELSE -1 END * close)", 2)} AS close FROM bars WHERE symbol IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1 HAVING count(DISTINCT symbol) = 3""")
def synthetic_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.synthetic(daily_bars(spark, sf), [("1-URGENT", 3.0), ("2-HIGH", -2.0), ("5-LOW", -1.0)]), "close", digits=2)


@query(f"""WITH {BARS} SELECT a.date, {R("a.close / b.close")} AS ratio FROM bars a JOIN bars b USING (date) WHERE a.symbol = '1-URGENT' AND b.symbol = '2-HIGH'""")
def price_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.price_ratio(daily_bars(spark, sf), "1-URGENT", "2-HIGH"), "ratio")


@query(f"""WITH {SEQ}, p AS (SELECT symbol, date, arg_min(price, abs(dte / 30.4375 - 3) * 1000 + seq * 1e-6) AS price FROM seq WHERE symbol IN ('A', 'R') GROUP BY 1, 2)
    SELECT date, 3 AS target, {R("sum(CASE symbol WHEN 'A' THEN 1 ELSE -1 END * price)", 5)} AS value FROM p GROUP BY 1 HAVING count(*) = 2""")
def cross_symbol_tenor_spread(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.aligned_tenors(_seq(spark, sf), [("A", 1.0), ("R", -1.0)], [3]), "value", digits=5)


@query(f"""WITH {SEQ}, pts AS (SELECT symbol, date, dte / 365.25 AS t, ln(price) AS y, CAST(row_number() OVER (PARTITION BY symbol, date ORDER BY dte, ln(price)) AS INTEGER) AS k, count(*) OVER (PARTITION BY symbol, date) AS n FROM seq),
    u AS (SELECT symbol, date, any_value(n) AS n, greatest(2, least(any_value(n), count(*) FILTER (t < 0.25) + 1)) AS k FROM pts GROUP BY 1, 2)
    SELECT u.symbol, u.date, 0.25 AS tau, {R("CASE WHEN u.n = 1 THEN a.y ELSE a.y + (b.y - a.y) / (b.t - a.t) * (0.25 - a.t) END")} AS ln_f FROM u
    JOIN pts a ON a.symbol = u.symbol AND a.date = u.date AND a.k = CASE WHEN u.n = 1 THEN 1 ELSE u.k - 1 END LEFT JOIN pts b ON b.symbol = u.symbol AND b.date = u.date AND b.k = u.k""")
def constant_maturity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.constant_maturity(_seq(spark, sf), [0.25]), "ln_f").withColumn("tau", F.col("tau").cast("decimal(3,2)"))


@query(f"""WITH {SEQ}, raw AS (SELECT symbol, date, dte / 365.25 AS t, ln(min(price)) AS y FROM seq WHERE price > 0 GROUP BY 1, 2, 3), pts AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY symbol, date) AS n FROM raw),
    u AS (SELECT symbol, date, tau, any_value(n) AS n, greatest(1, least(any_value(n) - 1, count(*) FILTER (t < tau))) AS k FROM pts, (SELECT unnest([0.02, 0.2, 0.35, 0.9])::DOUBLE AS tau) GROUP BY 1, 2, 3),
    q AS (SELECT u.*, p0.t AS t0, p0.y AS y0, p1.t AS t1, p1.y AS y1, p2.t AS t2, p2.y AS y2, p3.t AS t3, p3.y AS y3 FROM u LEFT JOIN pts p0 ON p0.symbol = u.symbol AND p0.date = u.date AND p0.i = k - 2 LEFT JOIN pts p1 ON p1.symbol = u.symbol AND p1.date = u.date AND p1.i = k - 1
        LEFT JOIN pts p2 ON p2.symbol = u.symbol AND p2.date = u.date AND p2.i = k LEFT JOIN pts p3 ON p3.symbol = u.symbol AND p3.date = u.date AND p3.i = k + 1),
    g AS (SELECT *, (y1 - y0) / (t1 - t0) AS d0, (y2 - y1) / (t2 - t1) AS d1, (y3 - y2) / (t3 - t2) AS d2, CASE WHEN k = 1 THEN 0 END AS z1, CASE WHEN k = n - 1 THEN 0 END AS z2 FROM q),
    m AS (SELECT *, coalesce(z1, CASE WHEN k = n - 1 THEN (d1 - d0) / ((t2 - t0) / 3) ELSE ((d1 - d0) * (t3 - t1) / 3 - (d2 - d1) * (t2 - t1) / 6) / ((t2 - t0) * (t3 - t1) / 9 - (t2 - t1) * (t2 - t1) / 36) END) AS m1,
        coalesce(z2, CASE WHEN k = 1 THEN (d2 - d1) / ((t3 - t1) / 3) ELSE ((d2 - d1) * (t2 - t0) / 3 - (d1 - d0) * (t2 - t1) / 6) / ((t2 - t0) * (t3 - t1) / 9 - (t2 - t1) * (t2 - t1) / 36) END) AS m2, (tau - t1) / (t2 - t1) AS s FROM g)
    SELECT m.symbol, m.date, tau, {R("CASE WHEN m.n = 1 THEN p.y ELSE y1 + d1 * (tau - t1) END", 5)} AS linear, {R("CASE WHEN m.n = 1 THEN p.y WHEN m.n < 4 THEN y1 + d1 * (tau - t1) ELSE (1 - s) * y1 + s * y2 + (t2 - t1) * (t2 - t1) / 6 * ((power(1 - s, 3) - (1 - s)) * m1 + (power(s, 3) - s) * m2) END", 5)} AS cubic
    FROM m JOIN pts p ON p.symbol = m.symbol AND p.date = m.date AND p.i = 0""")
def constant_maturity_panel(spark: SparkSession, sf: str) -> DataFrame:
    taus = [0.02, 0.2, 0.35, 0.9]
    linear = curves.constant_maturity(_seq(spark, sf), taus).withColumnRenamed("ln_f", "linear")
    cubic = curves.constant_maturity(_seq(spark, sf), taus, "cubic").withColumnRenamed("ln_f", "cubic")
    return rounded(linear.join(cubic, ["symbol", "date", "tau"]), "linear", "cubic", digits=5)


_SIGNED = f"""{SPREAD}, z AS (SELECT symbol, date, ln(near) AS lx, ln(far) AS ly FROM sp WHERE near > 0 AND far > 0), i AS (SELECT *, row_number() {W} AS k, lx - lag(lx) {W} AS dx, ly - lag(ly) {W} AS dy FROM z),
    area AS (SELECT b.symbol, b.date, 0.5 * sum((a.lx - a.dx / 2 - s.lx) * a.dy - (a.ly - a.dy / 2 - s.ly) * a.dx) AS levy_area, any_value(s.ly - s.lx) AS g0 FROM i b JOIN i s ON s.symbol = b.symbol AND s.k = b.k - 10 JOIN i a ON a.symbol = b.symbol AND a.k BETWEEN b.k - 9 AND b.k - 1 GROUP BY 1, 2)"""


@query(f"""WITH {_SIGNED}, l AS (SELECT i.symbol, i.date, lag(ly - lx) {W.replace("symbol", "i.symbol").replace("date", "i.date")} - g0 AS level_1, levy_area AS level_2 FROM i LEFT JOIN area a ON a.symbol = i.symbol AND a.date = i.date),
    m AS (SELECT *, level_2 * lag(level_2) {W} AS level_3 FROM l)
    SELECT symbol, date, {R("level_1")} AS level_1, {R("level_2")} AS level_2, {R("level_3")} AS level_3, {R(f"level_3 * lag(level_3) {W}")} AS level_4 FROM m""")
def signature_levels(spark: SparkSession, sf: str) -> DataFrame:
    out = curves.signature_levels(_spread(spark, sf).where("near > 0 AND far > 0"), "near", "far", 10, 4)
    names = [f"level_{n}" for n in range(1, 5)]
    return rounded(out.select("symbol", "date", *names), *names)


_LEAD = f"""{SEQ}, pr AS (SELECT symbol, seq, date, ln(price) AS lx, ln(far) AS ly FROM (SELECT *, lead(price) OVER (PARTITION BY symbol, date ORDER BY seq) AS far FROM seq) WHERE far > 0 AND price > 0), i AS (SELECT *, row_number() OVER p AS k, lx - lag(lx) OVER p AS dx, ly - lag(ly) OVER p AS dy FROM pr WINDOW p AS (PARTITION BY symbol, seq ORDER BY date)),
    area AS (SELECT b.symbol, b.seq, b.date, 0.5 * sum((a.lx - a.dx / 2 - s.lx) * a.dy - (a.ly - a.dy / 2 - s.ly) * a.dx) AS a FROM i b JOIN i s ON s.symbol = b.symbol AND s.seq = b.seq AND s.k = b.k - 10 JOIN i a ON a.symbol = b.symbol AND a.seq = b.seq AND a.k BETWEEN b.k - 9 AND b.k - 1 GROUP BY ALL),
    lead AS (SELECT symbol, date, avg(a) FILTER (seq < 2) AS front_area, avg(a) FILTER (seq >= 2) AS back_area FROM area GROUP BY 1, 2)"""


@query(f"WITH {_LEAD} SELECT symbol, date, {R('front_area')} AS front_area, {R('back_area')} AS back_area, {R('front_area - back_area')} AS leadership FROM lead")
def curve_leadership(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.leadership(_seq(spark, sf), 10, 2)[0], "front_area", "back_area", "leadership")


@query(f"WITH {_LEAD}, d AS (SELECT symbol, front_area - back_area AS l FROM lead WHERE front_area IS NOT NULL AND back_area IS NOT NULL) SELECT symbol, {R('avg(CASE WHEN l > 0 THEN 1.0 ELSE 0 END)')} AS front_leads, {R('avg(CASE WHEN l < 0 THEN 1.0 ELSE 0 END)')} AS back_leads, count(*) AS n FROM d GROUP BY 1")
def curve_leadership_shares(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.leadership(_seq(spark, sf), 10, 2)[1], "front_leads", "back_leads")


@query(f"""WITH {SEQ}, s AS (SELECT symbol, date, CASE WHEN count(*) > 1 THEN regr_slope(price, seq) END AS slope FROM seq GROUP BY 1, 2), st AS (SELECT symbol, date, CASE WHEN slope IS NULL THEN 'Unknown' WHEN slope > 0.01 THEN 'Contango' WHEN slope < -0.01 THEN 'Backwardation' ELSE 'Flat' END AS structure FROM s),
    m AS (SELECT symbol, lag(structure) {W} AS from_state, structure AS to_state FROM st), c AS (SELECT symbol, from_state, to_state, count(*) AS n FROM m WHERE from_state IS NOT NULL GROUP BY ALL)
    SELECT *, {R("n / sum(n) OVER (PARTITION BY symbol, from_state)")} AS share FROM c""")
def structure_transitions(spark: SparkSession, sf: str) -> DataFrame:
    states = curves.shape(_seq(spark, sf)).select("symbol", "date", curves.market_structure("slope").alias("structure"))
    return rounded(curves.regime_transitions(states, "structure"), "share")


@query(f"""WITH {SPREAD}, z AS (SELECT symbol, date, ln(near) AS lx, ln(far) AS ly FROM sp WHERE near > 0 AND far > 0), i AS (SELECT *, row_number() {W} AS k, lx - lag(lx) {W} AS dx, ly - lag(ly) {W} AS dy FROM z)
    SELECT b.symbol, b.date, {R("0.5 * sum((a.lx - a.dx / 2 - s.lx) * a.dy - (a.ly - a.dy / 2 - s.ly) * a.dx)")} AS levy_area FROM i b JOIN i s ON s.symbol = b.symbol AND s.k = b.k - 10 JOIN i a ON a.symbol = b.symbol AND a.k BETWEEN b.k - 9 AND b.k - 1 GROUP BY 1, 2""")
def levy_area(spark: SparkSession, sf: str) -> DataFrame:
    out = curves.levy_area(_spread(spark, sf).where("near > 0 AND far > 0"), "near", "far", 10).where("levy_area IS NOT NULL")
    return rounded(out.select("symbol", "date", "levy_area"), "levy_area")


@query(f"""WITH {SPREAD}, z AS (SELECT symbol, date, sqrt(power(ln(near / lag(near) {W}), 2) + power(ln(far / lag(far) {W}), 2)) AS step FROM sp)
    SELECT symbol, date, {R("CASE WHEN count(step) OVER w = 9 THEN sum(step) OVER w END")} AS path_length FROM z WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)""")
def path_variation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.path_variation(_spread(spark, sf), "near", "far", 10).select("symbol", "date", "path_length"), "path_length")


@query(f"""WITH {SPREAD}, s AS (SELECT symbol, date, CAST(sign(spread) AS DOUBLE) AS sign, min(sign(spread)) OVER f AS lo, max(sign(spread)) OVER f AS hi, count(*) OVER f AS n, lag(sign(spread)) {W} AS b FROM sp WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
    SELECT symbol, date, sign FROM s WHERE sign <> 0 AND b * sign < 0 AND n = 3 AND CASE WHEN sign > 0 THEN lo >= 0 ELSE hi <= 0 END""")
def regime_sign_changes(spark: SparkSession, sf: str) -> DataFrame:
    return curves.sign_changes(_spread(spark, sf), "spread", 3).select("symbol", "date", "sign")


@query()
def curve_flips(spark: SparkSession, sf: str) -> DataFrame:
    return curves.slope_flips(curves.shape(_seq(spark, sf)), 1.5, 60, 0)


@query(f"""WITH {SPREAD} SELECT symbol, CAST(month(date) AS INTEGER) AS season, count(*) AS n, {R("avg(spread)")} AS mean, {R("quantile_cont(spread, 0.5)")} AS median, {R("min(spread)")} AS low, {R("max(spread)")} AS high, {R("stddev(spread)")} AS std,
    {R("quantile_cont(spread, 0.25)")} AS q25, {R("quantile_cont(spread, 0.75)")} AS q75 FROM sp GROUP BY 1, 2""")
def seasonal_statistics(spark: SparkSession, sf: str) -> DataFrame:
    out = curves.seasonal_statistics(_spread(spark, sf), "spread", F.month("date"))
    return rounded(out, "mean", "median", "low", "high", "std", "q25", "q75")


@query(f"""WITH {SPREAD}, m AS (SELECT symbol, date, spread, count(spread) OVER a AS na, abs((spread - avg(spread) OVER a) / stddev(spread) OVER a) AS za, count(spread) OVER b AS nb, abs((spread - avg(spread) OVER b) / stddev(spread) OVER b) AS zb FROM sp
        WINDOW a AS (PARTITION BY symbol, month(date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT symbol, date, {R("CASE WHEN na >= 10 THEN za WHEN nb >= 50 THEN zb ELSE 0 END", 5)} AS driver FROM m""")
def seasonal_driver(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.seasonal_driver(_spread(spark, sf), "spread").select("symbol", "date", "driver"), "driver", digits=5)


@query(f"""WITH {SPREAD}, l AS (SELECT symbol, spread, lag(spread, 21) {W} AS a, lag(spread, 63) {W} AS b, lag(spread, 126) {W} AS c, lag(spread, 252) {W} AS d FROM sp)
    SELECT symbol, count(spread) AS n, {R("corr(spread, a)", 5)} AS ac_21, {R("corr(spread, b)", 5)} AS ac_63, {R("corr(spread, c)", 5)} AS ac_126, {R("corr(spread, d)", 5)} AS ac_252 FROM l GROUP BY 1 HAVING count(spread) >= 252""")
def seasonal_strength(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.seasonal_strength(_spread(spark, sf), "spread").drop("strength"), "ac_21", "ac_63", "ac_126", "ac_252", digits=5)


@query(f"""WITH {SPREAD}, c AS (SELECT symbol, date, volume, near - lag(near) {W} AS ch, ln(near / lag(near) {W}) AS ret FROM sp), b AS (SELECT *, lag(ch) {W} AS before FROM c)
    SELECT symbol, {R("CASE WHEN covar_samp(ch, before) < 0 THEN 2 * sqrt(-covar_samp(ch, before)) ELSE 0 END", 4)} AS roll_spread, {R("avg(abs(ret) / (volume + 1))")} AS amihud, {R("CASE WHEN count(ret) > 20 THEN regr_slope(abs(ch), volume) END", 4)} AS kyle FROM b GROUP BY 1""")
def liquidity_measures(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(curves.liquidity_measures(_spread(spark, sf)), "amihud"), "roll_spread", "kyle", digits=4)


@query()
def curve_pca(spark: SparkSession, sf: str) -> DataFrame:
    return curves.pca(curves.constant_maturity(_seq(spark, sf), [0.1, 0.2, 0.3, 0.4, 0.5]))
