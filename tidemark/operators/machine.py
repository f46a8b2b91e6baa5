"""Trading setups as state machines over the bars of each symbol, in one pass or streamed."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import scan

#: The columns of a transition, and those of a machine's state between two bars.
EVENT = "kind string, from_state int, to_state int, level double, entry_price double, stop_loss double, take_profit double"
STATE = "state int, quiet int, high double, low double, level double, n_volumes bigint, sum_volumes double, entered bigint"


class Context(NamedTuple):
    """What a machine knows: the stage, quiet bars so far, their range, the level to break, volumes since the start, the time of entry (microseconds)."""

    state: int = 0
    quiet: int = 0
    high: float | None = None
    low: float | None = None
    level: float | None = None
    n_volumes: int = 0
    sum_volumes: float = 0.0
    entered: int | None = None


class Bar(NamedTuple):
    at: int
    high: float
    low: float
    close: float
    volume: float


@dataclass(frozen=True)
class Breakout:
    """Wait for a quiet range, for its break upwards on volume, for a return to the level, and for the move away from it.

    `machine(context, bar)` gives the next context and an event or None; nothing else is kept, so bars can arrive in
    batches cut anywhere.  Subclasses override `stages`, whose functions give "stay", "advance", "reset" or "exit".
    A bar that a timeout, a reset or an exit consumes starts nothing new.  A spike is a volume above `spike` times the
    mean of the volumes since the machine started over.
    """

    quiet_range: float = 0.005
    quiet_bars: int = 10
    spike: float = 1.5
    failed: float = 0.995
    near: float = 0.002
    lost: tuple[float, float] = (0.99, 1.02)
    away: float = 1.001
    stop: float = 0.995
    take: float = 1.01
    timeout_seconds: int | None = None

    def stages(self):
        return (self._quiet, self._break, self._retest, self._leave)

    def _quiet(self, c: Context, b: Bar) -> tuple[str, Context]:
        if c.high is None:
            return "stay", c._replace(quiet=0, high=b.high, low=b.low)
        if b.close and (b.high - b.low) / b.close < self.quiet_range:
            c = c._replace(quiet=c.quiet + 1, high=max(c.high, b.high), low=min(c.low, b.low))
        else:
            c = c._replace(quiet=0, high=b.high, low=b.low)
        return ("advance", c._replace(level=c.high)) if c.quiet >= self.quiet_bars else ("stay", c)

    def _break(self, c: Context, b: Bar) -> tuple[str, Context]:
        if b.close > c.level and c.n_volumes and b.volume > self.spike * c.sum_volumes / c.n_volumes:
            return "advance", c._replace(entered=b.at)
        return ("reset" if b.close < c.level * self.failed else "stay"), c

    def _retest(self, c: Context, b: Bar) -> tuple[str, Context]:
        if abs(b.close - c.level) / c.level < self.near:
            return "advance", c
        return ("reset" if b.close < c.level * self.lost[0] or b.close > c.level * self.lost[1] else "stay"), c

    def _leave(self, c: Context, b: Bar) -> tuple[str, Context]:
        return ("exit" if b.close > c.level * self.away else "stay"), c

    def __call__(self, c: Context, b: Bar) -> tuple[Context, tuple | None]:
        if self.timeout_seconds is not None and c.entered is not None and b.at - c.entered > self.timeout_seconds * 1_000_000:
            return Context(), ("timeout", c.state, 0, c.level, None, None, None)
        verdict, after = self.stages()[c.state](c, b)
        after = after._replace(n_volumes=after.n_volumes + 1, sum_volumes=after.sum_volumes + b.volume)
        if verdict == "stay":
            return after, None
        if verdict == "reset":
            return Context(), ("reset", c.state, 0, c.level, None, None, None)
        if verdict == "exit":
            return Context(), ("signal", c.state, 0, c.level, b.close, c.level * self.stop, b.close * self.take)
        if c.state + 1 == len(self.stages()):
            return Context(), ("overrun", c.state, 0, c.level, None, None, None)
        return after._replace(state=c.state + 1), ("advance", c.state, c.state + 1, after.level, None, None, None)


def known(b: tuple) -> bool:
    """Whether a bar has all its numbers; others are passed over."""
    return all(v is not None and v == v for v in b)


def transitions(bars: DataFrame, machine: Breakout, order: str = "ts") -> DataFrame:
    """symbol, the bar's time, close and the columns of EVENT, for each bar that changes its symbol's machine.

    bars: symbol, `order`, high, low, close, volume, one row a symbol and time.  Bars with a null in any of them change
    nothing.  A symbol's bars stream through one machine in order.
    """

    def step(state: Context, *values):
        if not known(values):
            return state, (None,) * 7
        state, event = machine(state, Bar(*values))
        return state, event or (None,) * 7

    at = F.unix_micros(F.col(order).cast("timestamp"))
    numbers = [F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "volume")]
    narrow = bars.select("symbol", order, at.alias("at"), *numbers)
    found = scan(narrow, ["symbol"], ["at"], ["at", "high", "low", "close", "volume"], Context, step, EVENT)
    return found.where("kind IS NOT NULL").drop("at", "high", "low", "volume")
