"""The state machine: by hand, streamed in batches cut anywhere, with late bars, and after a restart."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import machine
from tidemark.operators.machine import Bar, Breakout, Context
from tidemark.streaming import machine as streamed

#: Minutes since 1970 of the first bar.
FIRST = 28_000_000
SCHEMA = "symbol string, at bigint, high double, low double, close double, volume double"
QUICK = Breakout(quiet_range=0.02, quiet_bars=3, spike=1.2, near=0.01, lost=(0.95, 1.06), away=1.002, timeout_seconds=3600)


def test_a_breakout_by_hand():
    c, seen = Context(), []
    prices = [(100, 10)] * 5 + [(101.5, 30), (101.6, 10), (100.5, 10), (100.9, 10)]
    for i, (p, v) in enumerate(prices):
        c, event = QUICK(c, Bar(i * 60_000_000, p + 0.4, p - 0.4, p, v))
        seen += [(i, event[0], event[1])] if event else []
    assert seen == [(3, "advance", 0), (5, "advance", 1), (7, "advance", 2), (8, "signal", 3)]
    assert c == Context()
    c = Context(state=2, level=100.0, high=100.0, low=99.0, entered=0)
    assert QUICK(c, Bar(3_700_000_000, 1, 1, 100.0, 1))[1][0] == "timeout"


def bars(seed, n):
    r = random.Random(seed)
    rows = []
    for s in "ab":
        p = 100.0
        for i in range(n):
            p *= 1 + r.choice([0, 0, 0.0005, -0.0005, 0.012, -0.004])
            rows.append((s, (FIRST + i) * 60_000_000, p * 1.001, p * 0.999, p, float(r.choice([5, 10, 10, 40]))))
    return rows


def by_hand(rows, m=QUICK):
    out, contexts = [], {}
    for s, *b in sorted(rows):
        contexts[s], event = m(contexts.get(s, Context()), Bar(*b))
        out += [(s, b[0], event[0], event[1], event[2])] if event else []
    return sorted(out)


def plain(found, at):
    return sorted((r.symbol, r[at] if at == "at" else int(r.ts.timestamp() * 1_000_000), r.kind, r.from_state, r.to_state) for r in found)


def test_one_pass_equals_the_loop(spark):
    rows = bars(1, 400)
    df = spark.createDataFrame([*rows, ("a", 5, None, 1.0, 1.0, 1.0)], SCHEMA).withColumn("ts", F.timestamp_micros("at"))
    truth = by_hand(rows)
    assert plain(machine.transitions(df, QUICK).collect(), "ts") == truth
    assert {t[2] for t in truth} >= {"advance", "reset", "signal"}


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def write(spark, folder, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("at")).drop("at")
    df.coalesce(1).write.mode("append").parquet(folder)


def read(spark, folder):
    return spark.readStream.schema("symbol string, ts timestamp, high double, low double, close double, volume double").option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, source, checkpoint, out, late="5 minutes"):
    q = streamed.transitions(read(spark, source), QUICK, late).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.read.parquet(out).collect()


def test_batches_restarts_and_late_bars(rocks, tmp_path):
    spark, rows = rocks, bars(2, 150)
    source, checkpoint, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    cut = (FIRST + 70) * 60_000_000
    first, second = [r for r in rows if r[1] < cut], [r for r in rows if r[1] >= cut]
    # out of order within the watermark's delay
    by_time = sorted(first, key=lambda r: r[1])
    swapped = [by_time[i ^ 2] if (i ^ 2) < len(by_time) else by_time[i] for i in range(len(by_time))]
    write(spark, source, swapped[:60])
    write(spark, source, swapped[60:])
    run(spark, source, checkpoint, out)
    # after a restart: the rest, a bar that is too late, and bars that move the watermark past everything
    write(spark, source, second)
    write(spark, source, [("a", (FIRST + 3) * 60_000_000 + 7, 900.0, 1.0, 500.0, 9e9)])
    write(spark, source, [(s, (FIRST + 1_000) * 60_000_000, 1.0, 1.0, 1.0, 1.0) for s in "ab"])
    found = [r for r in run(spark, source, checkpoint, out) if r.ts.timestamp() < (FIRST + 1_000) * 60]
    assert plain(found, "ts") == by_hand(rows)


def test_idle_symbols_are_forgotten(rocks, tmp_path):
    spark = rocks
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    quiet = [("a", (FIRST + i) * 60_000_000, 100.1, 99.9, 100.0, 10.0) for i in range(4)]
    write(spark, source, quiet)
    write(spark, source, [("b", (FIRST + 500) * 60_000_000, 1.0, 1.0, 1.0, 1.0)])
    write(spark, source, [("a", (FIRST + 600 + i) * 60_000_000, 100.1, 99.9, 100.0, 10.0) for i in range(3)])
    write(spark, source, [("b", (FIRST + 2_000) * 60_000_000, 1.0, 1.0, 1.0, 1.0)])
    q = streamed.transitions(read(spark, source), QUICK, "1 minute", idle_seconds=3600).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert [(r.symbol, r.kind, r.from_state) for r in spark.read.parquet(out).collect()] == [("a", "advance", 0)]
