"""Structured Streaming forms of the tick operators: windows with watermarks, and state kept for each symbol."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.files import MarketTable


def read_ticks(spark: SparkSession, path: str, schema, files_a_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def bars(ticks: DataFrame, length: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """symbol, ts (the window's start), open, high, low, close, volume, bid_volume, ask_volume; rows later than `late` go."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    place = F.struct("ts", "tick_id")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", window.alias("w"))
        .agg(
            F.min_by("price", place).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", place).alias("close"),
            F.sum(F.col("ask_volume") + F.col("bid_volume")).alias("volume"),
            F.sum("bid_volume").alias("bid_volume"),
            F.sum("ask_volume").alias("ask_volume"),
        )
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "bid_volume", "ask_volume")
    )


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of ticks without a gap: symbol, start, end, n, volume."""
    grouped = ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.sum(F.col("ask_volume") + F.col("bid_volume")).alias("volume")).select("symbol", "w.start", "w.end", "n", "volume")


BUCKETS = "symbol string, bucket bigint, ts_start timestamp, ts_end timestamp, ask_volume double, bid_volume double, n_ticks bigint"
_STATE = "bucket bigint, filled double, ts_start timestamp, ts_end timestamp, ask double, bid double, n bigint"


def volume_buckets(ticks: DataFrame, size: float, late: str = "10 minutes") -> DataFrame:
    """Buckets of `size` traded volume for each symbol, emitted when full; a tick belongs to the bucket that it fills.

    Ticks of a batch are taken in order of (ts, tick_id).  The state of a symbol is its one open bucket.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket, filled, first, last, ask, bid, n = state.get if state.exists else (0, 0.0, None, None, 0.0, 0.0, 0)
        out = []
        for t in pd.concat(list(frames)).sort_values(["ts", "tick_id"]).itertuples():
            first, last = first if first is not None else t.ts, t.ts
            ask, bid, n, filled = ask + t.ask_volume, bid + t.bid_volume, n + 1, filled + t.ask_volume + t.bid_volume
            if filled >= size - 1e-9:
                out.append((key[0], bucket, first, last, ask, bid, n))
                bucket += max(1, int((filled + 1e-9) // size))
                filled = max(0.0, filled - int((filled + 1e-9) // size) * size)
                first, last, ask, bid, n = None, None, 0.0, 0.0, 0
        state.update((bucket, filled, first, last, ask, bid, n))
        yield pd.DataFrame(out, columns=["symbol", "bucket", "ts_start", "ts_end", "ask_volume", "bid_volume", "n_ticks"])

    kept = ticks.withWatermark("ts", late).select("symbol", "ts", "tick_id", "ask_volume", "bid_volume")
    return kept.groupBy("symbol").applyInPandasWithState(step, BUCKETS, _STATE, "append", GroupStateTimeout.NoTimeout)


def ingest(stream: DataFrame, table: MarketTable, checkpoint: str):
    """Upsert what is new into a market table, then stop; a batch that is run again gives the same table."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: table.upsert(batch)).start()
