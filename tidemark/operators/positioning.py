"""Positioning reports by instrument, trader category and metric.

Reports are long tables: symbol, week, code, name, category, longs, shorts, spreads, open_interest.  An instrument is a row of a
small dimension: symbol, commodity, code and the kind of report that it is in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import col

#: Commodities whose positions are in the report on traders in financial futures; all others are in the disaggregated one.
FINANCIAL = [
    "TREASURY_BONDS", "TREASURY_NOTES_10Y", "TREASURY_NOTES_5Y", "TREASURY_NOTES_2Y",
    "EURODOLLAR",
    "SP_500", "NASDAQ_100", "DOW_JONES", "RUSSELL_2000", "VIX",
    "EUR_USD", "GBP_USD", "JPY_USD", "CAD_USD", "AUD_USD", "CHF_USD",
]

#: Words in a metric's name that put it into a group of metrics.
GROUPS = {
    "positioning": ["position", "net", "long", "short"],
    "flows": ["flow", "change", "delta"],
    "extremes": ["extreme", "percentile", "zscore", "outlier"],
    "market_structure": ["concentration", "ratio", "structure", "dominance"],
}


def code_of(c: Column | str) -> Column:
    """A contract code as it is compared: no outer blanks, upper case."""
    return F.upper(F.trim(col(c).cast("string")))


def _number(df: DataFrame, name: str) -> Column:
    """A column as a number; text that is none is null."""
    return F.col(name).try_cast("double") if df.schema[name].dataType.typeName() == "string" else F.col(name)


def report_of(commodity: Column | str, financial: list[str] | None = None) -> Column:
    """tff for financial instruments, disaggregated for all others, also for unknown ones."""
    known = [c.upper() for c in (FINANCIAL if financial is None else financial)]
    return F.when(code_of(commodity).isin(known), "tff").otherwise("disaggregated")


def instruments(df: DataFrame, symbol: Column | str, commodity: Column | str, code: Column | str, financial: list[str] | None = None) -> DataFrame:
    """One row an instrument; of rows of one symbol the smallest code and its commodity."""
    rows = df.select(code_of(symbol).alias("symbol"), F.struct(code_of(code).alias("code"), code_of(commodity).alias("commodity")).alias("best"))
    found = rows.where("symbol IS NOT NULL").groupBy("symbol").agg(F.min("best").alias("best")).select("symbol", "best.commodity", "best.code")
    return found.withColumn("report", report_of("commodity", financial))


def of_instruments(df: DataFrame, dimension: DataFrame, wanted: list[str], field: str = "symbol", code: str = "code") -> DataFrame:
    """Rows whose code is that of a wanted symbol (or commodity), in any case, with the instrument's symbol, commodity and report.

    A code that several wanted instruments share gives a row for each; see `unmapped` for names without a code.
    """
    names = [w.strip().upper() for w in wanted]
    rows = dimension.where(F.col(field).isin(names)).select(F.col("code").alias("instrument_code"), *[F.col(c).alias(c if c not in df.columns else f"instrument_{c}") for c in ("symbol", "commodity", "report")])
    # at most a row a wanted name and its codes
    return df.join(F.broadcast(rows), code_of(code) == F.col("instrument_code")).drop("instrument_code")


def unmapped(dimension: DataFrame, wanted: list[str], field: str = "symbol") -> DataFrame:
    """The wanted names that no instrument has."""
    names = dimension.sparkSession.createDataFrame([(w.strip().upper(),) for w in wanted], f"{field} string")
    return names.join(dimension.select(field).distinct(), field, "left_anti")


def find(df: DataFrame, codes: list[str] | None = None, names: list[str] | None = None, start: str | None = None, end: str | None = None, least_open_interest: float | None = None, categories: list[str] | None = None, columns: list[str] | None = None, limit: int | None = None, where: str | None = None) -> DataFrame:
    """Rows that meet every condition given; all of them are plain filters, so those on stored columns reach the scan.

    Names are parts of the market's name, of which one has to be in it, in any case and literally.  Both days count.  A row
    whose open interest is no number is left out if a least one is asked for.  `limit` takes the first rows by week and code.
    """
    out = df
    if codes is not None:
        out = out.where(code_of("code").isin([c.strip().upper() for c in codes]))
    if start is not None:
        out = out.where(F.col("week") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col("week") <= F.lit(end).cast("date"))
    if where is not None:
        out = out.where(where)
    if names is not None:
        inside = [F.coalesce(F.contains(F.lower("name"), F.lit(n.lower())), F.lit(False)) for n in names]
        out = out.where(F.array_contains(F.array(*inside), True) if inside else F.lit(False))
    if least_open_interest is not None:
        out = out.where(_number(out, "open_interest") >= least_open_interest)
    if categories is not None:
        out = out.where(F.lower("category").isin([c.lower() for c in categories]))
    out = out.orderBy("week", "code").limit(limit) if limit is not None else out
    return out.select(*columns) if columns else out


def side_by_category(df: DataFrame, categories: list[str], fields: tuple[str, ...] = ("longs", "shorts", "spreads"), keys: tuple[str, ...] = ("symbol", "week")) -> DataFrame:
    """A row a report with the columns <category>_<field> of the categories asked for and the open interest of all; null where a report lacks a category."""
    of = lambda c, f: F.sum(F.when(F.lower("category") == c.lower(), _number(df, f))).alias(f"{c.lower()}_{f}")
    return df.groupBy(*keys).agg(F.sum(_number(df, "open_interest")).alias("open_interest"), *[of(c, f) for c in categories for f in fields])


def codes_listed(df: DataFrame) -> DataFrame:
    """The distinct codes with the names of their markets."""
    return df.select(code_of("code").alias("code"), "name").distinct()


def summary(df: DataFrame) -> DataFrame:
    """Rows, codes and first and last week of each kind of report, and of all (report null)."""
    g = df.select("report", code_of("code").alias("code"), "week").rollup("report")
    return g.agg(F.grouping("report").alias("is_total"), F.count("*").alias("n_rows"), F.count_distinct("code").alias("n_codes"), F.min("week").alias("first"), F.max("week").alias("last"))


def groups_of(metric: Column | str) -> Column:
    """The groups of a metric by words in its name, comma-joined; "other" if none."""
    name = F.lower(metric)
    named = F.concat_ws(",", *[F.when(name.rlike("|".join(words)), F.lit(g)) for g, words in GROUPS.items()])
    return F.when(named == "", "other").otherwise(named)


def metrics(features: DataFrame, keys: tuple[str, ...] = ("symbol", "week"), groups: list[str] | None = None) -> DataFrame:
    """The numeric columns of a feature table as rows: keys, metric, value, of the groups asked for; nulls take no row."""
    numeric = [f.name for f in features.schema if f.name not in keys and f.dataType.typeName() in ("double", "float", "long", "integer", "short", "byte", "decimal")]
    long = features.select(*keys, *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot([*keys], numeric, "metric", "value").where("value IS NOT NULL")
    return long if groups is None else long.where(F.arrays_overlap(F.split(groups_of("metric"), ","), F.array(*map(F.lit, groups))))


def metrics_info(long: DataFrame) -> DataFrame:
    """Of each symbol's metric its groups, number of values and first and last week."""
    g = long.groupBy("symbol", "metric").agg(F.count("*").alias("n_values"), F.min("week").alias("first"), F.max("week").alias("last"))
    return g.withColumn("groups", groups_of("metric"))


def side_by_side(df: DataFrame, symbols: list[str], fields: list[str], order: str = "week") -> DataFrame:
    """Outer alignment on time: the columns <symbol>_<field> of the symbols; a time that only some have leaves the others null.

    Of repeated rows of one symbol and time the largest value of each field.
    """
    of = lambda s, f: F.max(F.when(F.col("symbol") == s, F.col(f))).alias(f"{s}_{f}")
    return df.where(F.col("symbol").isin(symbols)).groupBy(order).agg(*[of(s, f) for s in symbols for f in fields])
