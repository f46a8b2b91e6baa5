import re
import struct

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import numeric
from tidemark.operators import relational
from tidemark.sources import files
from tidemark.streaming import flow

TICK = "symbol string, ts timestamp, price double, ask_volume double, bid_volume double, tick_id bigint"


def test_false_discovery_rates_by_hand(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.002, 0.5])], "i int, p double")
    q = {r.i: round(r.q, 6) for r in numeric.fdr(df, "p", [], ["i"], q_col="q").collect()}
    assert q == {0: 0.025, 1: 0.05, 2: 0.05, 3: 0.01, 4: 0.5}


def test_asof_takes_the_last_at_or_before_and_keeps_unmatched_rows(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 5, 3), ("a", None, 4)], "k string, t int, i int").withColumn("ts", F.timestamp_seconds("t"))
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 9, 90)], "k string, t int, v int").select("k", F.timestamp_seconds("t").alias("ts"), "v")
    found = {r.i: r.v for r in relational.asof_join(left, right, ["k"], "ts", ["v"]).collect()}
    assert found[1] == 50 and found[2] is None and found[3] is None
    assert {r.i: r.v for r in relational.asof_join(left, right, ["k"], "ts", ["v"], "forward", 1.5).collect()}[2] == 20


def test_range_join_has_both_ends(spark):
    points = spark.createDataFrame([("a", t) for t in range(0, 100, 10)], "k string, t int").select("k", F.timestamp_seconds("t").alias("ts"))
    spans = spark.createDataFrame([("a", 20, 50, "x"), ("a", 45, 45, "y")], "k string, s int, e int, n string").select("k", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"), "n")
    assert sorted(r.n for r in relational.range_join(points, spans, ["k"], "ts", "s", "e", 7).collect()) == ["x"] * 4


def test_csv_with_aliases(spark, tmp_path):
    (tmp_path / "ES.csv").write_text("Date, Time, Open, High, Low, Last, Volume, # of Trades, Bid Volume\n2024/1/2, 08:30:00.5, 1, 3, 0.5, 2, 10, 4, 6\nbad, x, 1, 1, 1, 1, 1, 1, 1\n2024/1/3, 08:30:00, 1, 3, 0.5, n/a, 10, 4, 6\n")
    first, second = files.read_bars_csv(spark, str(tmp_path)).orderBy("ts").collect()
    assert (first.symbol, first.close, first.num_trades, first.bid_volume, first.ask_volume) == ("ES", 2.0, 4.0, 6.0, 0.0)
    assert second.close is None and str(first.ts) == "2024-01-02 08:30:00"


def test_binary_ticks(spark, tmp_path):
    start = int((pd.Timestamp("2024-01-02 08:30") - pd.Timestamp("1899-12-30")) / pd.Timedelta("1us"))
    body = b"".join(struct.pack("<q4f4I", start + i, 1, 2, 0.5, 1.5, 1, 3, 1, 2) for i in range(3))
    (tmp_path / "CL.scid").write_bytes(b"SCID" + struct.pack("<I", 56) + bytes(48) + body + b"cut")
    (tmp_path / "other.scid").write_bytes(b"no")
    found = files.read_binary_ticks(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r.symbol, r.close, r.volume, r.ask_volume) for r in found] == [("CL", 1.5, 3, 2)] * 3
    assert str(found[0].ts) == "2024-01-02 08:30:00"


def test_report_dates(spark):
    df = spark.createDataFrame([(240105,), (991231,), (50301,), (241399,)], "d int").select(files.report_date("d").alias("d"))
    assert [str(r.d) for r in df.collect()] == ["2024-01-05", "1999-12-31", "2005-03-01", "None"]


def market_rows(spark, rows):
    return spark.createDataFrame(rows, "symbol string, t int, close double").select("symbol", F.timestamp_seconds("t").alias("ts"), "close")


def test_market_table_upserts_and_prunes(spark, tmp_path):
    table = files.MarketTable(spark, str(tmp_path / "market"))
    table.upsert(market_rows(spark, [("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 5.0)]))
    table.upsert(market_rows(spark, [("a", 2, 9.0), ("a", 3, 3.0)]))
    assert sorted((r.symbol, r.close) for r in table.read().collect()) == [("a", 1.0), ("a", 3.0), ("a", 9.0), ("b", 5.0)]
    assert [r.close for r in table.tail("a", 2).collect()] == [3.0, 9.0]
    assert {r.symbol: r.n_rows for r in table.summary().collect()} == {"a": 3, "b": 1} and table.symbols() == ["a", "b"]
    plan = table.read(["a"], where="close > 2")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\n]*symbol", plan) and "GreaterThan(close,2.0)" in plan


def test_only_touched_months_are_rewritten(spark, tmp_path):
    table, day = files.MarketTable(spark, str(tmp_path / "market")), 86_400
    table.upsert(market_rows(spark, [(s, d * day, float(d)) for s in ("a", "b/c") for d in range(0, 400, 5)]))

    def versions():
        return {f"{p.parent.parent.name}/{p.parent.name}": p.name for p in (tmp_path / "market").rglob("*.parquet")}

    before = versions()
    assert len(before) == 26
    table.upsert(market_rows(spark, [("a", 35 * day, -1.0), ("a", 36 * day, -2.0)]))
    after = versions()
    assert {k for k in after if before.get(k) != after[k]} == {"symbol=a/month=1970_02"}
    assert table.read(["a"]).count() == 81 and [r.close for r in table.read(["a"], where="close < 0").orderBy("ts").collect()] == [-1.0, -2.0]
    plan = table.read(["a"], start="1970-03-02", end="1970-04-20")
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    shown = plan._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert plan.count() == 10 and re.search(r"PartitionFilters: \[[^\n]*month#\d+ >= 1970_03\)[^\n]*month#\d+ <= 1970_04\)", shown)
    assert {r.m for r in table.read(months=[2]).selectExpr("month(ts) AS m").collect()} == {2}
    table.write(market_rows(spark, [("b/c", 10, 7.0)]))
    assert [r.close for r in table.read(["b/c"]).collect()] == [7.0] and table.read(["a"]).count() == 81
    assert [p.name for p in tmp_path.iterdir()] == ["market"]


def test_contract_files_to_a_series_without_jumps(spark, tmp_path):
    from tidemark.operators import curves

    days = [str(d.date()) for d in pd.bdate_range("2025-01-02", "2025-05-16")]
    for i, (code, gap) in enumerate([("G", 0.0), ("H", 5.0), ("J", 12.0), ("K", 20.0)]):
        rows = [f"{d}, {100 + 0.1 * k + gap}, {10 + i}, {k}" for k, d in enumerate(days)]
        head = "Date, Settle, Volume, Open Interest" if code != "J" else "Volume,date,LAST"
        if code == "J":
            rows = [f"{10 + i},{d},{100 + 0.1 * k + gap}" for k, d in enumerate(days)]
        (tmp_path / f"CL{code}25-NYM.dly").write_text("\n".join([head, *rows, "bad, x, y, z", ""]))
    (tmp_path / "NGZ99-NYM.dly").write_text("19991001 2.5 7 8\n19991001 2.6 7 9\n")
    (tmp_path / "notes.csv").write_text("Date,Close\n2025-01-02,1\n")
    curve = files.read_contracts(spark, str(tmp_path))
    found = curve.where("symbol = 'NG'").first()
    assert (found.contract, found.price, found.oi, str(found.expiry)) == ("Z1999", 2.6, 9.0, "1999-12-20")
    cl = curve.where("symbol = 'CL'").cache()
    assert cl.count() == 4 * len(days) and {r.contract for r in cl.collect()} == {"G2025", "H2025", "J2025", "K2025"}
    assert cl.where("contract = 'J2025' AND oi IS NULL AND volume = 12").count() == len(days)
    fronts = curves.sequentialise(cl).where("seq = 0")
    for method in ("ratio", "difference"):
        series = curves.continuous(cl, fronts, method).orderBy("date").collect()
        assert sum(r.rolled for r in series) == 3 and len(series) == len(days)
        moves = [b.adjusted - a.adjusted for a, b in zip(series, series[1:], strict=False)]
        assert max(abs(m - 0.1) for m in moves) < 0.03 and max(abs(m) for m in moves) < 0.2
        assert series[-1].adjusted == series[-1].price
    cl.unpersist()


def ticks(spark, folder):
    rows = [("a", 10 * i, 100.0 + i, 3.0 * (i % 2), 3.0 * (1 - i % 2), i) for i in range(12)]
    df = spark.createDataFrame(rows, "symbol string, t int, price double, ask_volume double, bid_volume double, tick_id bigint")
    df.withColumn("ts", F.timestamp_seconds("t")).drop("t").write.parquet(folder)
    return flow.read_ticks(spark, folder, TICK)


def run(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_streamed_bars_and_sessions(spark, tmp_path):
    stream = ticks(spark, str(tmp_path / "t"))
    bars = sorted(run(flow.bars(stream, "1 minute"), "bars", "complete"), key=lambda r: r.ts)
    assert [(r.open, r.close, r.volume) for r in bars] == [(100.0, 105.0, 18.0), (106.0, 111.0, 18.0)]
    assert [(r.n, r.volume) for r in run(flow.sessions(stream), "sessions", "complete")] == [(12, 36.0)]


def test_streamed_volume_buckets(spark, tmp_path):
    found = run(flow.volume_buckets(ticks(spark, str(tmp_path / "t")), 9.0), "buckets")
    assert [(r.bucket, r.n_ticks, r.ask_volume + r.bid_volume) for r in sorted(found, key=lambda r: r.bucket)] == [(k, 3, 9.0) for k in range(4)]


def test_streamed_ingest(spark, tmp_path):
    table = files.MarketTable(spark, str(tmp_path / "market"))
    stream = ticks(spark, str(tmp_path / "t")).select("symbol", "ts", F.col("price").alias("close"))
    flow.ingest(stream, table, str(tmp_path / "c")).awaitTermination(120)
    assert table.read().count() == 12


def test_correlation_of_constant_and_tiny_groups_is_null(spark):
    from tidemark.functions.numeric import corr

    rows = [("c", 1.0, 2.0), ("c", 1.0, 3.0), ("one", 1.0, 2.0), ("two", 1.0, 2.0), ("two", 2.0, 4.0), ("gap", None, 1.0), ("gap", 2.0, 2.0), ("gap", 2.0, 5.0)]
    found = spark.createDataFrame(rows, "k string, x double, y double").groupBy("k").agg(corr("x", "y").alias("r")).collect()
    assert {r.k: r.r and round(r.r, 9) for r in found} == {"c": None, "one": None, "two": 1.0, "gap": None}


def test_rates_by_brute_force(spark):
    from tidemark.functions.numeric import fdr

    rows = [(k, i, None if i % 7 == 0 else ((i * 37 + k) % 23) / 23) for k in range(3) for i in range(40)]
    found = fdr(spark.createDataFrame(rows, "k int, i int, p double"), "p", ["k"], ["i"]).collect()
    for k in range(3):
        p = sorted((v, i) for g, i, v in rows if g == k and v is not None)
        q = {}
        low = 1.0
        for rank in range(len(p), 0, -1):
            low = min(low, p[rank - 1][0] * len(p) / rank)
            q[p[rank - 1][1]] = low
        assert all(r.q_value is None if r.p is None else abs(r.q_value - q[r.i]) < 1e-12 for r in found if r.k == k)


def test_buckets_do_not_depend_on_days(spark):
    from tidemark.operators import orderflow

    rows = [("a", f"2024-01-{1 + i // 5:02d} 10:00:{i % 5:02d}", float(i % 4), 1.0) for i in range(60)]
    ticks = spark.createDataFrame(rows, "symbol string, ts string, ask_volume double, bid_volume double").selectExpr("symbol", "to_timestamp(ts) AS ts", "ask_volume", "bid_volume")
    total, truth = 0.0, {}
    for _, _, ask, bid in rows:
        total += ask + bid
        truth.setdefault(int((total - 1e-9) // 10), []).append(ask + bid)
    found = {r.bucket: (r.n_ticks, r.total_volume) for r in orderflow.volume_buckets(ticks, 10).collect()}
    assert found == {b: (len(v), sum(v)) for b, v in truth.items()}


def test_levels_and_nearest_by_hand(spark):
    from tidemark.operators import microstructure

    rows = [(1, "2024-01-01 09:00:00", 10.0, 2.0), (2, "2024-01-02 08:30:00", 12.0, 1.0), (3, "2024-01-02 09:10:00", 31.0, 3.0), (4, "2024-01-02 14:00:00", 55.0, 1.0), (5, "2024-01-02 15:00:00", 99.0, 9.0)]
    t = spark.createDataFrame(rows, "tick_id int, ts string, price double, size double").selectExpr("'a' AS symbol", "to_timestamp(ts) AS ts", "price", "size AS ask_volume", "0D AS bid_volume", "'B' AS side", "tick_id")
    levels = microstructure.session_levels(t)
    second = {r.level: r.price for r in levels.collect() if r.date.day == 2}
    area = {"point_of_control": 35.0, "value_area_low": 15.0, "value_area_high": 35.0}
    assert second == {"first_high": 31.0, "first_low": 12.0, "vwap": (12 + 93 + 55) / 5, "prior_high": 10.0, "prior_low": 10.0, "prior_close": 10.0} | area
    prices = t.selectExpr("tick_id", "symbol", "to_date(ts) AS date", "price")
    near = {r.tick_id: r.level for r in microstructure.nearest_level(prices, levels, 1.5).collect()}
    assert near == {1: "first_high", 2: "first_low", 3: "first_high", 4: None, 5: None}
    again = prices.drop("tick_id")
    assert microstructure.nearest_level(again.union(again).union(again.selectExpr("symbol", "date", "CAST(NULL AS DOUBLE)")), levels, 1.5).count() == 15


def brute_area(volumes, share=0.7):
    top = max(range(len(volumes)), key=lambda i: (volumes[i], -i))
    lo = hi = top
    held = volumes[top]
    while held < share * sum(volumes) and (lo or hi + 1 < len(volumes)):
        left, right = volumes[lo - 1] if lo else -1, volumes[hi + 1] if hi + 1 < len(volumes) else -1
        lo, hi, held = (lo, hi + 1, held + right) if right > left else (lo - 1, hi, held + left)
    return top, lo, hi


def test_value_area_by_brute_force(spark):
    import random

    from tidemark.operators import microstructure

    r = random.Random(3)
    sessions = {k: [float(r.choice([0, 0, 1, 2, 5, 9])) for _ in range(r.randint(1, 30))] + [1.0] for k in range(40)}
    rows = [(k, b - 5, v) for k, vs in sessions.items() for b, v in enumerate([1.0, *vs]) if v]
    found = microstructure.value_area(spark.createDataFrame(rows, "k int, bin bigint, volume double"), ["k"]).collect()
    assert {r.k: (r.poc_bin + 5, r.low_bin + 5, r.high_bin + 5) for r in found} == {k: brute_area([1.0, *vs]) for k, vs in sessions.items()}


def test_labels_take_the_first_hit(spark):
    from tidemark.operators import microstructure

    at = lambda s: f"2024-01-02 10:00:{s:02d}"
    path = [(0, 100.0), (5, 101.0), (6, 98.0), (20, 103.0), (21, 97.0), (40, 100.5)]
    ticks = spark.createDataFrame([(i, at(s), p) for i, (s, p) in enumerate(path)], "tick_id int, ts string, price double").selectExpr("'a' AS symbol", "to_timestamp(ts) AS ts", "price", "1D AS ask_volume", "0D AS bid_volume", "'B' AS side", "tick_id")
    start = 1704189600
    entries = spark.createDataFrame([("a", start, 100.0, 1), ("a", start, 100.0, -1), ("a", start + 7, 100.0, 1), ("a", start + 22, 100.0, -1), ("a", start + 50, 100.0, 1)], "symbol string, second bigint, price double, direction int")
    entries = entries.selectExpr("symbol", "DATE'2024-01-02' AS date", "1 AS part", "second", "price", "direction")
    found = microstructure.auction_labels(entries, ticks, 1.0, target_ticks=2, stop_ticks=3, horizon=30).collect()
    assert {(r.second - start, r.direction): (r.y, r.exit_kind) for r in found} == {(0, 1): (2.0, "target"), (0, -1): (2.0, "target"), (7, 1): (2.0, "target"), (22, -1): (-0.5, "time"), (50, 1): (None, None)}
