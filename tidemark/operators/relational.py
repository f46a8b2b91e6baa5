"""Joins and reshapes over (symbol, ts) tables that Spark has no single operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import backward_fill, corr, forward_fill


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str], direction: str = "backward", tolerance_seconds: float | None = None, suffix: str = "") -> DataFrame:
    """For each left row the values of the last right row at or before its ts (forward: the first at or after).

    Both sides are unioned and the right values carried along one window, so there is one shuffle on the keys and no
    range join.  Of right rows with the same keys and ts the largest values in their order are taken.  Unmatched values
    are null.
    """
    carried = [f"{v}{suffix}" for v in values]
    packed = F.struct(F.col(ts).alias("at"), *[F.col(v).alias(c) for v, c in zip(values, carried, strict=True)])
    lefts = left.withColumn("asof_side", F.lit(1)).withColumn("asof_value", F.lit(None))
    rights = right.select(*keys, ts, F.lit(0 if direction == "backward" else 2).alias("asof_side"), packed.alias("asof_value"))
    both = lefts.drop("asof_value").unionByName(rights, allowMissingColumns=True)
    if direction == "backward":
        found = forward_fill("asof_value", Window.partitionBy(*keys).orderBy(ts, "asof_side", "asof_value"))
    else:
        ahead = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col("asof_side").desc(), "asof_value")
        found = forward_fill("asof_value", ahead)
    both = both.withColumn("asof_value", found).where("asof_side = 1")
    gap = F.abs(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("asof_value.at").cast("timestamp"))) / 1e6
    near = F.lit(True) if tolerance_seconds is None else gap <= tolerance_seconds
    out = [F.when(near, F.col(f"asof_value.{c}")).alias(c) for c in carried]
    return both.select(*left.columns, *out)


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str], tolerance_seconds: float) -> DataFrame:
    """For each left row the values of the right row nearest in time within the tolerance; the earlier one of a tie."""
    back = asof_join(left, right.withColumn("near_ts", F.col(ts)), keys, ts, ["near_ts", *values], "backward", tolerance_seconds, "_b")
    both = asof_join(back, right.withColumn("near_ts", F.col(ts)), keys, ts, ["near_ts", *values], "forward", tolerance_seconds, "_f")

    def seconds(c: str) -> Column:
        return F.abs(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(c).cast("timestamp")))

    first = F.coalesce(seconds("near_ts_b") <= seconds("near_ts_f"), F.col("near_ts_b").isNotNull())
    return both.select(*left.columns, *[F.when(first, F.col(f"{v}_b")).otherwise(F.col(f"{v}_f")).alias(v) for v in values])


def range_join(points: DataFrame, intervals: DataFrame, keys: list[str], ts: str, start: str, end: str, bin_seconds: int) -> DataFrame:
    """Points with every interval of their keys that holds them (both ends count), as an equi-join on time bins.

    An interval is copied to each bin that it touches, so choose bins about as long as the intervals.
    """
    to_bin = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / bin_seconds)
    binned = intervals.withColumn("range_bin", F.explode(F.sequence(to_bin(start), to_bin(end))))
    return points.withColumn("range_bin", to_bin(ts)).join(binned, [*keys, "range_bin"]).where(F.col(ts).between(F.col(start), F.col(end))).drop("range_bin")


def shifted_join(df: DataFrame, keys: list[str], ts: str, value: str, seconds: int, into: str) -> DataFrame:
    """The value at exactly ts + seconds, by an equi-join; never a row offset."""
    later = df.select(*keys, (F.col(ts) - F.make_interval(secs=F.lit(seconds))).alias(ts), F.col(value).alias(into))
    return df.join(later, [*keys, ts], "left")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last in order."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("keep_rank", F.row_number().over(w)).where("keep_rank = 1").drop("keep_rank")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def common_times(df: DataFrame, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """Rows at the times that every symbol has."""
    n = df.select(symbol).distinct().agg(F.count("*").alias("n_symbols"))
    times = df.groupBy(ts).agg(F.count_distinct(symbol).alias("n_here")).crossJoin(F.broadcast(n)).where("n_here = n_symbols").select(ts)  # n is one row
    return df.join(times, ts, "left_semi")


def all_times(df: DataFrame, values: list[str], fill: str = "ffill", symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """A row for each symbol at every time that any symbol has, gaps filled forward or backward within the symbol."""
    spine = df.select(ts).distinct().crossJoin(F.broadcast(df.select(symbol).distinct()))
    joined = spine.join(df.select(symbol, ts, *values), [symbol, ts], "left")
    w = Window.partitionBy(symbol).orderBy(ts)
    return joined.select(symbol, ts, *[(forward_fill(v, w) if fill == "ffill" else backward_fill(v, symbol, [ts])).alias(v) for v in values])


def alignment_report(df: DataFrame, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """Of each symbol its rows, how many are at common times, and their share."""
    common = common_times(df, symbol, ts).groupBy(symbol).agg(F.count("*").alias("n_common"))
    return df.groupBy(symbol).agg(F.count("*").alias("n_rows")).join(common, symbol, "left").select(symbol, "n_rows", F.coalesce("n_common", F.lit(0)).alias("n_common"), (F.coalesce("n_common", F.lit(0)) / F.col("n_rows")).alias("efficiency"))


def islands(df: DataFrame, keys: list[str], order: list[str], flag: str, into: str = "island") -> DataFrame:
    """A number for each run of equal flags in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.coalesce((~F.col(flag).eqNullSafe(F.lag(flag).over(w))).cast("int"), F.lit(1))
    return df.withColumn("island_change", F.when(F.row_number().over(w) == 1, 0).otherwise(change)).withColumn(into, F.sum("island_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("island_change")


def pairs(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """Pairwise Pearson correlations of named series that share keys, each pair once: name_a < name_b."""
    a = df.select(*keys, F.col(name).alias("name_a"), F.col(value).alias("x"))
    b = df.select(*keys, F.col(name).alias("name_b"), F.col(value).alias("y"))
    both = a.join(b, keys).where("name_a < name_b AND x IS NOT NULL AND y IS NOT NULL")
    return both.groupBy("name_a", "name_b").agg(F.count("*").alias("n"), corr("x", "y").alias("correlation"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation of the rows that have both values, by key; equal values share their mean rank."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def rank(c: str) -> Column:
        ties = F.count("*").over(Window.partitionBy(*keys, c))
        return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (ties - 1) / 2

    ranked = both.select(*keys, rank(x).alias("rank_x"), rank(y).alias("rank_y"))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), corr("rank_x", "rank_y").alias("rank_correlation"))
