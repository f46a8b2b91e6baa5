"""State machines over streamed bars: typed state for each symbol, bars held until the watermark has passed them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.machine import EVENT, STATE, Bar, Breakout, Context, known

OUTPUT = f"symbol string, ts timestamp, close double, {EVENT}"
_NAMES = ["symbol", "ts", "close", "kind", "from_state", "to_state", "level", "entry_price", "stop_loss", "take_profit"]


class MachineState(StatefulProcessor):
    """A symbol's state is its machine's context and the bars that the watermark has not passed.

    Bars wait in a map by time, each with a timer; when a timer fires, all bars up to the watermark go through the
    machine in order.  So transitions do not depend on how bars are cut into batches, nor on their order within the
    watermark's delay.  A bar behind the watermark is too late and is left out.  With `idle_seconds` a symbol without
    bars for that long is forgotten: its machine starts over.
    """

    def __init__(self, machine: Breakout, idle_seconds: int | None = None):
        self.machine, self.idle_seconds = machine, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.context = handle.getValueState("context", STATE)
        self.waiting = handle.getMapState("waiting", "at bigint", "high double, low double, close double, volume double")
        self.seen = handle.getValueState("seen", "at bigint")

    def _pass(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Send the bars up to the watermark through the machine."""
        ready = sorted((k[0], *v) for k, v in self.waiting.iterator() if k[0] <= watermark_ms * 1000)
        if not ready:
            return
        context = Context(*self.context.get()) if self.context.exists() else Context()
        out = []
        for at, *numbers in ready:
            if known(tuple(numbers)):
                context, event = self.machine(context, Bar(at, *numbers))
                if event:
                    out.append((key[0], pd.Timestamp(at, unit="us"), numbers[2], *event))
            self.waiting.removeKey((at,))
        self.context.update(tuple(context))
        if out:
            frame = pd.DataFrame(out, columns=_NAMES)
            floats = ["level", "entry_price", "stop_loss", "take_profit"]
            yield frame.astype(dict.fromkeys(floats, float))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        newest = self.seen.get()[0] if self.seen.exists() else None
        for frame in rows:
            for at, *numbers in zip(*(frame[c] for c in ("at", "high", "low", "close", "volume")), strict=True):
                if at <= watermark * 1000:
                    continue
                self.waiting.updateValue((int(at),), tuple(None if v != v else float(v) for v in numbers))
                self.handle.registerTimer(-(-int(at) // 1000))
                newest = int(at) if newest is None else max(newest, int(at))
        if newest is not None:
            self.seen.update((newest,))
            if self.idle_seconds is not None:
                self.handle.registerTimer(-(-newest // 1000) + self.idle_seconds * 1000)
        yield from self._pass(key, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        yield from self._pass(key, watermark)
        if self.idle_seconds is not None and self.seen.exists() and watermark * 1000 >= self.seen.get()[0] + self.idle_seconds * 1_000_000:
            for state in (self.context, self.waiting, self.seen):
                state.clear()

    def close(self) -> None:
        pass


def transitions(bars: DataFrame, machine: Breakout, late: str = "10 minutes", idle_seconds: int | None = None) -> DataFrame:
    """The transitions of `operators.machine.transitions`, as a stream of appended rows.

    bars: symbol, ts, high, low, close, volume; of bars of one symbol and time the last to arrive counts.  Bars more than
    `late` behind the newest are left out; a transition comes once the watermark has passed its bar.  The session needs
    the RocksDB state store: `spark.sql.streaming.stateStore.providerClass`.
    """
    numbers = [F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "volume")]
    rows = bars.withWatermark("ts", late).select("symbol", "ts", F.unix_micros("ts").alias("at"), *numbers)
    return rows.groupBy("symbol").transformWithStateInPandas(MachineState(machine, idle_seconds), OUTPUT, "append", "eventTime")
