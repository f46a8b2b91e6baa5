"""Queries: tick microstructure, session levels, rank correlation, positioning by code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features, machine, microstructure, relational
from tidemark.plans.registry import R, query, rounded
from tidemark.sources.tables import BARS, HOURS, POSITIONS, TICKS, daily_bars, hourly_bars, positioning, ticks

_GRID = f"""{TICKS}, grid AS (SELECT symbol, CAST(ts AS DATE) AS date, CAST(floor(epoch(ts)) AS BIGINT) AS second, arg_max(price, tick_id) AS price, count(*) AS n_trades,
    count(*) FILTER (side = 'B') AS buy_count, count(*) FILTER (side = 'S') AS sell_count,
    sum(CASE WHEN side = 'B' THEN ask_volume + bid_volume ELSE 0 END) AS buy_vol, sum(CASE WHEN side = 'S' THEN ask_volume + bid_volume ELSE 0 END) AS sell_vol FROM ticks GROUP BY 1, 2, 3)"""


def _last(c: str, n: int) -> str:
    return f"(sum({c}) OVER (PARTITION BY symbol, date ORDER BY second RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW))"


@query(f"""WITH {_GRID}, r AS (SELECT symbol, date, second, {_last("buy_count", 600)} / 600 AS lam_buy, {_last("sell_count", 600)} / 600 AS lam_sell,
        {_last("buy_count", 7200)} / 7200 AS mu_buy, {_last("sell_count", 7200)} / 7200 AS mu_sell FROM grid)
    SELECT symbol, date, second, {R("lam_buy")} AS lam_buy, {R("lam_sell")} AS lam_sell, {R("(lam_buy - mu_buy) / sqrt(greatest(mu_buy, 1e-6))")} AS z_buy,
        {R("(lam_sell - mu_sell) / sqrt(greatest(mu_sell, 1e-6))")} AS z_sell, {R("(lam_buy - lam_sell) / nullif(lam_buy + lam_sell, 0)")} AS imbalance FROM r""")
def arrival_rates(spark: SparkSession, sf: str) -> DataFrame:
    names = ["lam_buy", "lam_sell", "z_buy", "z_sell", "imbalance"]
    return rounded(microstructure.arrival_rates(microstructure.trade_grid(ticks(spark, sf)), 600, 7200).select("symbol", "date", "second", *names), *names)


@query(f"""WITH {_GRID}, s AS (SELECT *, {_last("buy_vol", 3600)} AS b, {_last("sell_vol", 3600)} AS v, sum(buy_vol - sell_vol) OVER (PARTITION BY symbol, date ORDER BY second) AS q,
        {_last("n_trades", 3600)} AS n, {_last("n_trades * n_trades", 3600)} AS nn, least(3600.0, second - min(second) OVER (PARTITION BY symbol, date) + 1) AS k FROM grid),
    m AS (SELECT *, n / k AS mean, greatest(nn / k - (n / k) * (n / k), 0) AS var FROM s)
    SELECT symbol, date, second, {R("(b - v) / nullif(b + v, 0)")} AS trade_imbalance, {R("q", 4)} AS flow, {R("var / nullif(mean, 0)")} AS fano, CASE WHEN k >= 2 THEN {R("sqrt(var) / nullif(mean, 0)")} END AS variation FROM m""")
def flow_features(spark: SparkSession, sf: str) -> DataFrame:
    out = microstructure.flow_features(microstructure.trade_grid(ticks(spark, sf)), 3600).select("symbol", "date", "second", "trade_imbalance", "flow", "fano", "variation")
    return rounded(rounded(out, "trade_imbalance", "fano", "variation"), "flow", digits=4)


_LEVELS = f"""{TICKS}, t AS (SELECT *, CAST(ts AS DATE) AS date, ask_volume + bid_volume AS size, hour(ts) * 60 + minute(ts) AS minute, CASE WHEN hour(ts) * 60 + minute(ts) < 510 THEN 0 WHEN hour(ts) * 60 + minute(ts) < 900 THEN 1 ELSE 2 END AS part FROM ticks),
    d AS (SELECT symbol, CAST(date + INTERVAL 1 DAY AS DATE) AS date, max(price) AS h, min(price) AS l, arg_max(price, (ts, tick_id)) AS c FROM t GROUP BY ALL),
    s AS (SELECT *, min(ts) OVER p AS start, least(floor(price / 10), greatest(floor(min(price) OVER p / 10), ceil(max(price) OVER p / 10) - 1))::BIGINT AS bin FROM t WINDOW p AS (PARTITION BY symbol, date, part)),
    g AS (SELECT symbol, date, part, max(price) FILTER (floor(epoch(ts)) <= floor(epoch(start)) + 3600) AS fh, min(price) FILTER (floor(epoch(ts)) <= floor(epoch(start)) + 3600) AS fl, sum(price * size) / nullif(sum(size), 0) AS vw FROM s GROUP BY ALL),
    b AS (SELECT symbol, date, part, bin, round(sum(size) * 1000000)::BIGINT AS v FROM s GROUP BY ALL),
    bt AS (SELECT symbol, date, part, sum(v)::BIGINT AS total, min(bin) AS lb, max(bin) AS hb, arg_max(bin, (v, -bin)) AS poc FROM b GROUP BY ALL),
    grow AS (SELECT bt.symbol, bt.date, bt.part, total, lb, hb, poc, poc AS lo, poc AS hi, b.v AS held FROM bt JOIN b ON b.symbol = bt.symbol AND b.date = bt.date AND b.part = bt.part AND b.bin = poc
        UNION ALL SELECT symbol, date, part, total, lb, hb, poc, CASE WHEN r > l THEN lo ELSE lo - 1 END, CASE WHEN r > l THEN hi + 1 ELSE hi END, held + greatest(CASE WHEN r > l THEN r ELSE l END, 0) FROM (
            SELECT g.*, CASE WHEN lo > lb THEN coalesce(x.v, 0) ELSE -1 END AS l, CASE WHEN hi < hb THEN coalesce(y.v, 0) ELSE -1 END AS r FROM grow g
            LEFT JOIN b x ON x.symbol = g.symbol AND x.date = g.date AND x.part = g.part AND x.bin = g.lo - 1 LEFT JOIN b y ON y.symbol = g.symbol AND y.date = g.date AND y.part = g.part AND y.bin = g.hi + 1
            WHERE held < 0.7 * total::DOUBLE AND (lo > lb OR hi < hb))),
    area AS (SELECT symbol, date, part, (poc + 0.5) * 10 AS poc, (min(lo) + 0.5) * 10 AS val, (max(hi) + 0.5) * 10 AS vah FROM grow GROUP BY ALL),
    w AS (SELECT g.symbol, g.date, g.part, g.fh, g.fl, g.vw, d.h, d.l, d.c, p.poc, p.val, p.vah FROM g LEFT JOIN area p USING (symbol, date, part) LEFT JOIN d ON g.symbol = d.symbol AND g.date = d.date),
    levels AS (SELECT symbol, date, part, unnest(['first_high', 'first_low', 'vwap', 'prior_high', 'prior_low', 'prior_close', 'point_of_control', 'value_area_low', 'value_area_high']) AS level, unnest([1, 2, 3, 4, 5, 6, 7, 9, 8]) AS level_type, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS place, unnest([fh, fl, vw, h, l, c, poc, val, vah]) AS price FROM w)"""


@query(f"WITH RECURSIVE {_LEVELS} SELECT symbol, date, part, level, level_type, {R('price', 4)} AS price FROM levels WHERE price IS NOT NULL")
def session_levels(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(microstructure.session_levels(ticks(spark, sf), parts=(0, 1, 2)), "price", digits=4)


@query(f"""WITH RECURSIVE {_LEVELS}, x AS (SELECT t.tick_id, t.symbol, t.date, t.price, l.level, l.place, l.price AS lp, abs(t.price - l.price) AS a FROM t LEFT JOIN levels l ON t.symbol = l.symbol AND t.date = l.date AND l.part = 1 AND abs(t.price - l.price) <= 2),
    y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY tick_id ORDER BY a, place) = 1)
    SELECT y.tick_id % 977 AS tick_group, y.symbol, y.date, y.price, level, {R("lp", 4)} AS level_price, {R("y.price - lp", 4)} AS distance FROM y""")
def nearest_level(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf)
    prices = t.select((F.col("tick_id") % 977).alias("tick_group"), "symbol", F.to_date("ts").alias("date"), "price")
    return rounded(microstructure.nearest_level(prices, microstructure.session_levels(t), 2.0), "level_price", "distance", digits=4)


#: Every ten minutes of each symbol's days, from its first trade to its last, with the trades of a grid of that step.
_DENSE = f"""fine AS (SELECT symbol, CAST(ts AS DATE) AS date, CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS second, arg_max(price, tick_id) AS price0, count(*) FILTER (side = 'B') AS buys, count(*) FILTER (side = 'S') AS sells,
        sum(CASE WHEN side = 'B' THEN ask_volume + bid_volume ELSE 0 END) AS bv, sum(CASE WHEN side = 'S' THEN ask_volume + bid_volume ELSE 0 END) AS sv, count(*) FILTER (ask_volume > 0) AS asks, count(*) FILTER (bid_volume > 0) AS bids FROM ticks GROUP BY 1, 2, 3),
    every AS (SELECT symbol, date, unnest(range(min(second), max(second) + 1, 600)) AS second FROM fine GROUP BY 1, 2),
    dense AS (SELECT e.*, last_value(price0 IGNORE NULLS) OVER w AS price, coalesce(buys, 0) AS buys, coalesce(sells, 0) AS sells, coalesce(bv, 0) AS bv, coalesce(sv, 0) AS sv, coalesce(asks, 0) AS asks, coalesce(bids, 0) AS bids, f.second AS traded,
        row_number() OVER w AS k FROM every e LEFT JOIN fine f USING (symbol, date, second) WINDOW w AS (PARTITION BY symbol, date ORDER BY second))"""


def _steps(e: str, n: int, back: int = 0) -> str:
    return f"({e} OVER (PARTITION BY symbol, date ORDER BY second ROWS BETWEEN {n - 1} PRECEDING AND {back} PRECEDING))"


@query(f"""WITH {TICKS}, {_DENSE}, each AS (SELECT symbol, CAST(ts AS DATE) AS date, CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS second, ask_volume + bid_volume AS size,
        (price - lag(price) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, tick_id)) / nullif(CASE WHEN side = 'B' THEN ask_volume + bid_volume ELSE -(ask_volume + bid_volume) END, 0) AS each FROM ticks),
    edges AS (SELECT symbol, date, round(quantile_cont(size, 0.95), 6) AS edge FROM each GROUP BY 1, 2),
    imp AS (SELECT symbol, date, second, avg(each) AS impact, count(*) FILTER (size >= edge) AS n_large FROM each JOIN edges USING (symbol, date) GROUP BY 1, 2, 3),
    a AS (SELECT d.*, impact, coalesce(n_large, 0) AS n_large, bv - sv AS flow, CAST(sign(bv - sv) AS INTEGER) AS sg, price - lag(price) OVER (PARTITION BY d.symbol, d.date ORDER BY d.second) AS ch FROM dense d LEFT JOIN imp USING (symbol, date, second)),
    c AS (SELECT *, lag(sg) OVER (PARTITION BY symbol, date ORDER BY second) AS sb FROM a),
    r AS (SELECT *, CASE WHEN {_steps("count(*)", 6)} >= 3 AND {_steps("var_pop(CASE WHEN sb IS NOT NULL THEN sg END)", 5)} > 1e-9 AND {_steps("var_pop(sb)", 5)} > 1e-9 THEN {_steps("corr(sg, sb)", 5)} END AS ac FROM c),
    f AS (SELECT symbol, date, second, CASE WHEN {_steps("count(impact)", 6)} >= 3 THEN {_steps("quantile_cont(impact, 0.5)", 6)} END AS impact_elasticity, {_steps("sum(n_large)", 6)} / 3600 AS cluster_intensity, {_steps("avg(ac)", 6)} AS sign_autocorr,
        CASE WHEN {_steps("count(*)", 6)} >= 2 THEN {_steps("stddev_pop(ch)", 6)} END AS realised_vol, {_steps("sum(sg * coalesce(ch, 0))", 6)} AS flow_move,
        CASE WHEN {_steps("count(*)", 12)} >= 10 THEN sum(flow) OVER (PARTITION BY symbol, date ORDER BY second) / nullif({_steps("sum(abs(flow))", 12)}, 0) END AS flow_normalised, {_steps("sum(buys - sells)", 6)} / 3600 AS gap, {_steps("count(traded)", 6)} AS near FROM r)
    SELECT symbol, date, second, {R("impact_elasticity", 5)} AS impact_elasticity, {R("cluster_intensity")} AS cluster_intensity, {R("sign_autocorr")} AS sign_autocorr, {R("realised_vol", 4)} AS realised_vol, {R("flow_move", 4)} AS flow_move, {R("flow_normalised", 5)} AS flow_normalised,
        {R("gap * realised_vol", 5)} AS pressure FROM f WHERE near > 0""")
def impact_features(spark: SparkSession, sf: str) -> DataFrame:
    out = microstructure.impact_features(ticks(spark, sf), window=3600, base=7200, step=600, autocorr_window=3600)
    out = rounded(rounded(out, "cluster_intensity", "sign_autocorr"), "realised_vol", "flow_move", digits=4)
    return rounded(out, "impact_elasticity", "flow_normalised", "pressure", digits=5)


_SIGNALS = f"""{_LEVELS}, {_DENSE}, v AS (SELECT *, CASE WHEN second % 86400 < 30600 THEN 0 WHEN second % 86400 < 54000 THEN 1 ELSE 2 END AS part, {_steps("sum(asks)", 6)} / 3600 AS lam_buy, {_steps("sum(bids)", 6)} / 3600 AS lam_sell, {_steps("sum(asks)", 24)} / 14400 AS mb, {_steps("sum(bids)", 24)} / 14400 AS ms FROM dense),
    z AS (SELECT *, (lam_buy - mb) / sqrt(greatest(mb, 1e-6)) AS z_buy, (lam_sell - ms) / sqrt(greatest(ms, 1e-6)) AS z_sell FROM v),
    entries AS (SELECT z.symbol, z.date, z.part, z.second, z.price, l.level, l.price AS level_price, (z.price - l.price) / 0.5 AS dist_ticks, lam_buy, lam_sell, z_buy, z_sell, (lam_buy - lam_sell) / nullif(lam_buy + lam_sell, 0) AS imbalance, CASE WHEN z_buy >= z_sell THEN 1 ELSE -1 END AS direction
        FROM z JOIN levels l ON l.symbol = z.symbol AND l.date = z.date AND l.part = z.part AND abs(z.price - l.price) <= 4.0 WHERE greatest(z_buy, z_sell) >= 0.004
        QUALIFY row_number() OVER (PARTITION BY z.symbol, z.date, z.part, z.second ORDER BY abs(z.price - l.price), l.place) = 1)"""


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf)
    return microstructure.auction_signals(t, microstructure.session_levels(t, parts=(0, 1, 2)), tick=0.5, band_ticks=8, threshold=0.004, window=3600, base=14400, step=600)


@query(f"""WITH RECURSIVE {_SIGNALS} SELECT symbol, date, part, second, level, {R("dist_ticks", 4)} AS dist_ticks, {R("greatest(z_buy, z_sell)")} AS zmax, {R("coalesce(imbalance, 0)")} AS imb, direction,
    CAST(level = 'vwap' AS INTEGER) AS is_vwap, CAST(level IN ('first_high', 'first_low') AS INTEGER) AS is_first_hour, CAST(level IN ('prior_high', 'prior_low', 'prior_close') AS INTEGER) AS is_prior, CAST(level IN ('point_of_control', 'value_area_low', 'value_area_high') AS INTEGER) AS is_profile, CAST(part = 1 AS INTEGER) AS is_regular FROM entries""")
def auction_signals(spark: SparkSession, sf: str) -> DataFrame:
    out = microstructure.auction_features(_entries(spark, sf)).select("symbol", "date", "part", "second", "level", "dist_ticks", "zmax", "imb", "direction", "is_vwap", "is_first_hour", "is_prior", "is_profile", "is_regular")
    return rounded(rounded(out, "zmax", "imb"), "dist_ticks", digits=4)


@query(f"""WITH RECURSIVE {_SIGNALS}, path AS (SELECT e.symbol, e.date, e.part, e.second, e.direction, e.price AS entry, t.price, t.ts, t.tick_id, e.direction * (t.price - e.price) AS gain FROM entries e LEFT JOIN t ON t.symbol = e.symbol AND t.date = e.date AND t.part = e.part
        AND epoch_us(t.ts) BETWEEN e.second * 1000000 AND (e.second + 10800) * 1000000),
    f AS (SELECT symbol, date, part, second, direction, entry, min(ts) FILTER (CASE WHEN direction > 0 THEN price >= entry + 10.0 ELSE price <= entry - 10.0 END) AS hit, min(ts) FILTER (CASE WHEN direction > 0 THEN price <= entry - 7.5 ELSE price >= entry + 7.5 END) AS stop,
        arg_max(price, (ts, tick_id)) AS last_price, max(ts) AS last_ts FROM path GROUP BY ALL)
    SELECT symbol, date, part, second, direction, {R("CASE WHEN hit IS NOT NULL AND (stop IS NULL OR hit <= stop) THEN 20 WHEN stop IS NOT NULL THEN -15 ELSE direction * (last_price - entry) / 0.5 END", 4)} AS y,
        CASE WHEN last_ts IS NULL THEN NULL WHEN hit IS NOT NULL AND (stop IS NULL OR hit <= stop) THEN 'target' WHEN stop IS NOT NULL THEN 'stop' ELSE 'time' END AS exit_kind,
        {R("epoch_us(CASE WHEN hit IS NOT NULL AND (stop IS NULL OR hit <= stop) THEN hit ELSE coalesce(stop, last_ts) END) / 1000000 - second", 3)} AS seconds_held FROM f""")
def auction_labels(spark: SparkSession, sf: str) -> DataFrame:
    out = microstructure.auction_labels(_entries(spark, sf), ticks(spark, sf), tick=0.5, target_ticks=20, stop_ticks=15, horizon=10800)
    return rounded(out.select("symbol", "date", "part", "second", "direction", "y", "exit_kind", (F.unix_micros("exit_ts") / 1_000_000 - F.col("second")).alias("seconds_held")), "seconds_held", digits=3).transform(lambda x: rounded(x, "y", digits=4))


@query(f"""WITH RECURSIVE {HOURS}, n AS (SELECT symbol, ts, high, low, close, volume, epoch(ts) AS sec, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM hours),
    m AS (SELECT DISTINCT symbol, 0::BIGINT AS i, NULL::TIMESTAMP AS ts, NULL::DOUBLE AS close, 0 AS state, 0 AS quiet, NULL::DOUBLE AS hi, NULL::DOUBLE AS lo, NULL::DOUBLE AS lvl, 0::BIGINT AS nv, 0::DOUBLE AS sv, NULL::DOUBLE AS entered, NULL::VARCHAR AS kind, 0 AS was, NULL::DOUBLE AS told FROM n
        UNION ALL SELECT symbol, i, ts, close, CASE kind WHEN 'stay' THEN state WHEN 'advance' THEN state + 1 ELSE 0 END, CASE WHEN kind IN ('stay', 'advance') THEN q2 ELSE 0 END, CASE WHEN kind IN ('stay', 'advance') THEN hi2 END, CASE WHEN kind IN ('stay', 'advance') THEN lo2 END,
            CASE WHEN kind IN ('stay', 'advance') THEN CASE WHEN state = 0 AND kind = 'advance' THEN hi2 ELSE lvl END END, CASE WHEN kind IN ('stay', 'advance') THEN nv + 1 ELSE 0 END, CASE WHEN kind IN ('stay', 'advance') THEN sv + volume ELSE 0 END,
            CASE WHEN kind IN ('stay', 'advance') THEN CASE WHEN state = 1 AND kind = 'advance' THEN sec ELSE entered END END, kind, state, CASE WHEN state = 0 AND kind = 'advance' THEN hi2 ELSE lvl END FROM (
            SELECT *, CASE WHEN entered IS NOT NULL AND sec - entered > 36000 THEN 'timeout' WHEN state = 0 THEN CASE WHEN q2 >= 2 THEN 'advance' ELSE 'stay' END WHEN state = 1 THEN CASE WHEN close > lvl AND volume > sv / nv THEN 'advance' WHEN close < lvl * 0.1 THEN 'reset' ELSE 'stay' END
                WHEN state = 2 THEN CASE WHEN abs(close - lvl) / lvl < 0.4 THEN 'advance' WHEN close < lvl * 0.05 OR close > lvl * 5 THEN 'reset' ELSE 'stay' END WHEN close > lvl * 1.05 THEN 'signal' ELSE 'stay' END AS kind FROM (
                SELECT m.symbol, n.i, n.ts, n.sec, n.close, n.volume, state, lvl, nv, sv, entered, CASE WHEN state > 0 THEN quiet WHEN hi IS NULL THEN 0 WHEN (n.high - n.low) / n.close < 1.0 THEN quiet + 1 ELSE 0 END AS q2,
                    CASE WHEN state > 0 THEN hi WHEN hi IS NULL OR (n.high - n.low) / n.close >= 1.0 THEN n.high ELSE greatest(hi, n.high) END AS hi2, CASE WHEN state > 0 THEN lo WHEN hi IS NULL OR (n.high - n.low) / n.close >= 1.0 THEN n.low ELSE least(lo, n.low) END AS lo2
                FROM m JOIN n ON n.symbol = m.symbol AND n.i = m.i + 1)))
    SELECT symbol, ts, kind, was AS from_state, CASE WHEN kind = 'advance' THEN was + 1 ELSE 0 END AS to_state, {R("told", 2)} AS level, {R("CASE WHEN kind = 'signal' THEN close END", 2)} AS entry_price, {R("CASE WHEN kind = 'signal' THEN told * 0.995 END", 5)} AS stop_loss FROM m WHERE kind <> 'stay'""")
def breakout_transitions(spark: SparkSession, sf: str) -> DataFrame:
    setup = machine.Breakout(quiet_range=1.0, quiet_bars=2, spike=1.0, failed=0.1, near=0.4, lost=(0.05, 5.0), away=1.05, timeout_seconds=36000)
    out = machine.transitions(hourly_bars(spark, sf), setup).select("symbol", "ts", "kind", "from_state", "to_state", "level", "entry_price", "stop_loss")
    return rounded(rounded(out, "level", "entry_price", digits=2), "stop_loss", digits=5)


@query(f"""WITH {BARS}, r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS ret FROM bars), f AS (SELECT symbol, ret, volume FROM r WHERE ret IS NOT NULL),
    k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY ret) + (count(*) OVER (PARTITION BY symbol, ret) - 1) / 2 AS x, rank() OVER (PARTITION BY symbol ORDER BY volume) + (count(*) OVER (PARTITION BY symbol, volume) - 1) / 2 AS y FROM f)
    SELECT symbol, count(*) AS n, {R("CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) END")} AS rank_correlation FROM k GROUP BY 1""")
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(relational.spearman(features.returns(daily_bars(spark, sf)), ["symbol"], "ret", "volume"), "rank_correlation")


@query(f"WITH {POSITIONS} SELECT * FROM cot WHERE upper(trim(symbol)) IN ('1-URGENT', '3-MEDIUM') AND week >= DATE '1995-01-01' AND week < DATE '1996-01-01'")
def positioning_by_code(spark: SparkSession, sf: str) -> DataFrame:
    return features.positions_of(positioning(spark, sf), [" 1-urgent", "3-MEDIUM"], "1995-01-01", "1996-01-01")
