"""Reading tick, bar and positioning files into the canonical columns, and a market table kept as partitioned Parquet."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.operators.curves import expiry, synthetic

#: Headers under which files have the canonical columns (fixed values).
ALIASES = {
    "open": ["open"],
    "high": ["high"],
    "low": ["low"],
    "close": ["close", "last", "lastprice", "settle"],
    "volume": ["volume", "totalvolume", "vol"],
    "num_trades": ["numtrades", "numberoftrades", "oftrades", "trades"],
    "bid_volume": ["bidvolume", "bidvol", "bidtradevolume"],
    "ask_volume": ["askvolume", "askvol", "asktradevolume"],
}


def _plain(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def read_bars_csv(spark: SparkSession, path: str, symbol: str | None = None, date_col: str = "Date", time_col: str | None = "Time", pattern: str = "yyyy-M-d H:m:s") -> DataFrame:
    """symbol, ts and the canonical columns of bar files with any of the known headers; absent columns are 0, bad numbers null."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    known = {_plain(c): c for c in raw.columns}
    stamp = F.concat_ws(" ", F.col(f"`{date_col}`"), F.split_part(F.col(f"`{time_col}`"), F.lit("."), F.lit(1))) if time_col else F.col(f"`{date_col}`")
    columns = []
    for name, aliases in ALIASES.items():
        found = next((known[a] for a in aliases if a in known), None)
        columns.append((F.expr(f"try_cast(`{found}` as double)") if found else F.lit(0.0)).alias(name))
    ts = F.try_to_timestamp(F.translate(stamp, "/", "-"), F.lit(pattern)).alias("ts")
    return raw.select((F.lit(symbol) if symbol else F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1)).alias("symbol"), ts, *columns).where("ts IS NOT NULL")


#: The binary tick layout: a header of 56 bytes, records of 40; times in microseconds from 1899-12-30 (fixed values).
TICK_MAGIC, HEADER, RECORD = b"SCID", 56, 40
_RECORD = np.dtype([("t", "<i8"), ("open", "<f4"), ("high", "<f4"), ("low", "<f4"), ("close", "<f4"), ("num_trades", "<u4"), ("volume", "<u4"), ("bid_volume", "<u4"), ("ask_volume", "<u4")])
_EPOCH = pd.Timestamp("1899-12-30")
TICKS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, num_trades bigint, volume bigint, bid_volume bigint, ask_volume bigint"


def read_binary_ticks(spark: SparkSession, path: str) -> DataFrame:
    """Ticks of binary files, a file a task, decoded in slices; a file of another kind gives no rows, a cut last record is left out.

    Files are bounded by what Spark's binary source takes (2 GB); longer histories come as several files of a symbol.
    """
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("symbol"), "content")

    def decode(frames):
        for frame in frames:
            for symbol, content in zip(frame["symbol"], frame["content"], strict=True):
                if content[:4] != TICK_MAGIC or len(content) < HEADER:
                    continue
                start = struct.unpack_from("<I", content, 4)[0] or HEADER
                n = (len(content) - start) // RECORD
                for at in range(0, n, 100_000):
                    r = np.frombuffer(content, _RECORD, min(100_000, n - at), start + at * RECORD)
                    out = pd.DataFrame({c: r[c].astype(float if r[c].dtype.kind == "f" else np.int64) for c in _RECORD.names[1:]})
                    out.insert(0, "ts", (_EPOCH + pd.to_timedelta(r["t"], unit="us")).astype("datetime64[us]"))
                    out.insert(0, "symbol", symbol)
                    yield out

    return files.mapInPandas(decode, TICKS)


def report_date(c: Column | str, pivot: int = 29) -> Column:
    """A YYMMDD number as a date: years up to the pivot are of this century."""
    text = F.lpad((F.col(c) if isinstance(c, str) else c).cast("int").cast("string"), 6, "0")
    year = F.substring(text, 1, 2).cast("int")
    return F.try_make_date(year + F.when(year <= pivot, 2000).otherwise(1900), F.substring(text, 3, 2).cast("int"), F.substring(text, 5, 2).cast("int")) if hasattr(F, "try_make_date") else F.try_to_timestamp(
        F.concat((year + F.when(year <= pivot, 2000).otherwise(1900)).cast("string"), F.substring(text, 3, 4)), F.lit("yyyyMMdd")
    ).cast("date")


class MarketTable:
    """Bars as Parquet, partitioned by symbol and month.  A write replaces whole months of a symbol, so readers see one version of each."""

    def __init__(self, spark: SparkSession, path: str, ts: str = "ts"):
        self.spark, self.path, self.ts = spark, path.rstrip("/"), ts

    def _place(self, path: str):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _exists(self) -> bool:
        fs, place = self._place(self.path)
        return fs.exists(place)

    def _month(self) -> Column:
        return F.date_format(self.ts, "yyyy_MM")

    def read(self, symbols: list[str] | None = None, start=None, end=None, where: str | None = None, columns: list[str] | None = None, months: list[int] | None = None) -> DataFrame:
        """Filters reach the scan: symbols, the span of time and calendar months prune partitions, times and conditions are pushed to Parquet."""
        df = self.spark.read.parquet(self.path)
        if symbols is not None:
            df = df.where(F.col("symbol").isin(symbols))
        if start is not None:
            df = df.where((F.col(self.ts) >= start) & (F.col("month") >= F.date_format(F.lit(start).cast("timestamp"), "yyyy_MM")))
        if end is not None:
            df = df.where((F.col(self.ts) <= end) & (F.col("month") <= F.date_format(F.lit(end).cast("timestamp"), "yyyy_MM")))
        if months is not None:
            df = df.where(F.substring("month", 6, 2).isin([f"{m:02d}" for m in months]))
        df = df.where(where) if where else df
        return df.select("symbol", self.ts, *columns) if columns else df.drop("month")

    def _last(self, df: DataFrame, order: str) -> DataFrame:
        w = Window.partitionBy("symbol", self.ts).orderBy(F.col(order).desc())
        return df.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", order)

    def _put(self, df: DataFrame) -> None:
        spread = df.withColumn("month", self._month()).repartition("symbol", "month").sortWithinPartitions("symbol", "month", self.ts)
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "month").parquet(self.path)

    def write(self, df: DataFrame) -> None:
        """Replace the symbols of df, all their months included."""
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        with self._staged(df) as rows:
            for r in rows.select("symbol").distinct().collect():  # a row a symbol
                fs, place = self._place(f"{self.path}/symbol={escape(r.symbol)}")
                fs.delete(place, True)
            self._put(rows)

    @contextmanager
    def _staged(self, df: DataFrame) -> Iterator[DataFrame]:
        """The rows of df as a table beside this one, read before files that df may come from are replaced; it goes afterwards."""
        fs, place = self._place(f"{self.path}.staged-{uuid.uuid4().hex}")
        df.write.parquet(place.toString())
        try:
            yield self.spark.read.schema(df.schema).parquet(place.toString())
        finally:
            fs.delete(place, True)

    def upsert(self, df: DataFrame) -> None:
        """New rows win over old ones of the same symbol and time; only the months that df has are read and rewritten."""
        new = df.withColumn("is_new", F.lit(1))
        if self._exists():
            # a row a month and symbol that changes
            touched = F.broadcast(df.select("symbol", self._month().alias("month")).distinct())
            old = self.spark.read.parquet(self.path).join(touched, ["symbol", "month"], "left_semi").drop("month").withColumn("is_new", F.lit(0))
            new = old.unionByName(new, allowMissingColumns=True)
        with self._staged(self._last(new, "is_new")) as rows:
            self._put(rows)

    def symbols(self) -> list[str]:
        """The symbols of the table, from its partitions alone."""
        return sorted(r.symbol for r in self.spark.read.parquet(self.path).select("symbol").distinct().collect()) if self._exists() else []

    def tail(self, symbol: str, n: int) -> DataFrame:
        return self.read([symbol]).orderBy(F.col(self.ts).desc()).limit(n)

    def summary(self) -> DataFrame:
        return self.read().groupBy("symbol").agg(F.count("*").alias("n_rows"), F.min(self.ts).alias("first"), F.max(self.ts).alias("last"))


#: The letters of delivery months, January to December, and the headers of contract files.
MONTH_CODES = "FGHJKMNQUVXZ"
CONTRACT_ALIASES = {
    "date": ["date", "datetime", "timestamp"],
    "price": ["settle", "settlement", "close", "last", "adjclose", "price"],
    "volume": ["volume", "vol", "totalvolume"],
    "oi": ["openinterest", "oi"],
}


def contract_of(path: Column, pivot: int = 70) -> Column:
    """Symbol, month letter, exchange and first delivery day of a file such as CLH25-NYM.dly; null for other names.

    Two-digit years up to the pivot are of this century.
    """
    part = lambda i: F.upper(F.regexp_extract(path, r"(?i)([^/]*?)([FGHJKMNQUVXZ])(\d{2})(?:-([A-Za-z]+))?\.[A-Za-z]+$", i))
    year = part(3).cast("int")
    year = F.when(year <= pivot, year + 2000).otherwise(year + 1900)
    delivery = F.make_date(year, F.call_function("locate", part(2), F.lit(MONTH_CODES)), F.lit(1))
    found = (part(1) != "") & part(1).rlike("^[A-Z]+$")
    return F.when(found, F.struct(part(1).alias("symbol"), F.concat(part(2), year.cast("string")).alias("contract"), F.nullif(part(4), F.lit("")).alias("exchange"), delivery.alias("delivery")))


def read_contracts(spark: SparkSession, path: str, rule: str = "twentieth", pivot: int = 70, symbols: list[str] | None = None) -> DataFrame:
    """A curve from a folder of contract files: symbol, date, contract, exchange, price, volume, oi, expiry, dte.

    Contract and year come from a file's name; files with other names are passed over.  Each file has its own header, or
    none and the columns date, price, volume and open interest; absent columns and bad numbers are null, rows without a
    date are left out, and of a repeated date the last row stays.  A file, one contract's days, is one row of the scan.
    """
    files = spark.read.text(path, wholetext=True).select(contract_of(F.col("_metadata.file_path"), pivot).alias("c"), "value").where("c IS NOT NULL")
    files = files if symbols is None else files.where(F.col("c.symbol").isin([s.upper() for s in symbols]))
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
    fields = lambda x: F.split(F.trim(x), r"\s*,\s*|\s+")
    named = files.withColumn("lines", lines).withColumn("header", F.transform(F.split(F.get("lines", F.lit(0)), ","), lambda h: F.regexp_replace(F.lower(h), "[^a-z0-9]", "")))
    place = lambda names: F.coalesce(*[F.nullif(F.array_position("header", n), F.lit(0).cast("bigint")) for n in names])
    named = named.withColumn("has_header", place(CONTRACT_ALIASES["date"]).isNotNull())
    for i, (name, aliases) in enumerate(CONTRACT_ALIASES.items()):
        named = named.withColumn(f"at_{name}", F.when(F.col("has_header"), place(aliases)).otherwise(i + 1).cast("int"))
    body = named.withColumn("body", F.when(F.col("has_header"), F.slice("lines", F.lit(2), F.size("lines"))).otherwise(F.col("lines")))
    rows = body.select("c", "has_header", *[f"at_{n}" for n in CONTRACT_ALIASES], F.posexplode("body").alias("nth", "line"))
    cells = F.when(F.col("has_header"), F.transform(F.split("line", ","), lambda x: F.trim(x))).otherwise(fields(F.col("line")))
    rows = rows.withColumn("cells", cells)
    cell = lambda n: F.get("cells", F.col(f"at_{n}") - 1)
    first = F.split_part(cell("date"), F.lit(" "), F.lit(1))
    date = F.coalesce(*[F.try_to_timestamp(first, F.lit(p)) for p in ("yyyy-M-d", "M/d/yyyy", "yyyyMMdd", "yyyy/M/d")]).cast("date")
    number = lambda n: cell(n).try_cast("double").alias(n)
    day = rows.select("c", "nth", date.alias("date"), *[number(n) for n in ("price", "volume", "oi")]).where("date IS NOT NULL")
    last = day.groupBy("c", "date").agg(F.max_by(F.struct("price", "volume", "oi"), "nth").alias("v"))
    out = last.select("c.symbol", "date", "c.contract", "c.exchange", "v.*", expiry("c.delivery", rule).alias("expiry"))
    return out.withColumn("dte", F.datediff("expiry", "date"))


def write_tidy(df: DataFrame, folder: str, name: str) -> None:
    """A result table as CSV and as Parquet."""
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


class KeyedTable:
    """Rows kept by text keys as partitioned Parquet, for stored metrics, code sets and scan results.

    `put` replaces the keys that it brings and no others, `read` prunes to the keys asked for.  Keys stay text ("001602" keeps its
    zeros); rows with a null key are kept together.  A key with very many rows is written by several tasks.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("symbol",)):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def _place(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def exists(self) -> bool:
        fs, place = self._place(self.path)
        return fs.exists(place)

    def put(self, df: DataFrame) -> None:
        spread = df.withColumns({k: F.col(k).cast("string") for k in self.keys}).hint("rebalance", *map(F.col, self.keys))
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.keys).parquet(self.path)

    def read(self, where: str | None = None, columns: list[str] | None = None, **keys: str | list[str]) -> DataFrame:
        """Rows of the keys given by name, each one value or a list, that meet the condition."""
        found = self.spark.read.parquet(self.path).schema
        text = StructType([StructField(f.name, StringType()) if f.name in self.keys else f for f in found])
        df = self.spark.read.schema(text).parquet(self.path)
        for k, v in keys.items():
            df = df.where(F.col(k).isin([v] if isinstance(v, str) else v))
        df = df.where(where) if where else df
        return df.select(*self.keys, *columns) if columns else df

    def has(self, **keys: str | list[str]) -> bool:
        return self.exists() and not self.read(**keys).isEmpty()

    def listed(self) -> DataFrame:
        """The keys that have rows, from the partitions alone."""
        return self.read().select(*self.keys).distinct()

    def summary(self, order: str) -> DataFrame:
        return self.read().groupBy(*self.keys).agg(F.count("*").alias("n_rows"), F.min(order).alias("first"), F.max(order).alias("last"))

    def drop(self, **keys: str) -> bool:
        """Remove the rows of the leading keys given, one value each; False if there were none."""
        names = self.keys[: len(keys)]
        if not keys or set(keys) != set(names):
            raise ValueError(f"Rows go by one or more of the leading keys of {self.keys}")
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        fs, place = self._place("/".join([self.path, *[f"{k}={escape(keys[k])}" for k in names]]))
        return fs.exists(place) and fs.delete(place, True)


class SyntheticStore:
    """Synthetic symbols as three tables by symbol: prices, legs (leg, weight) and properties (name, value)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.prices, self.legs, self.properties = (KeyedTable(spark, f"{path.rstrip('/')}/{t}") for t in ("prices", "legs", "properties"))

    def save(self, symbol: str, prices: DataFrame, legs: list[tuple[str, float]], properties: dict[str, str] | None = None, replace: bool = True) -> None:
        """Keep a synthetic symbol; the legs, which make it whole, are written last.  Without `replace` a symbol that is there stays and is an error."""
        if not replace and self.legs.has(symbol=symbol):
            raise ValueError(f"{symbol} is stored already")
        self.delete(symbol)
        named = lambda df: df.withColumn("symbol", F.lit(symbol))
        self.prices.put(named(prices.drop("symbol")))
        if properties:
            self.properties.put(named(self.spark.createDataFrame(sorted(properties.items()), "name string, value string")))
        self.legs.put(named(self.spark.createDataFrame(legs, "leg string, weight double")))

    def load(self, symbols: list[str], start=None, end=None, order: str = "date") -> DataFrame:
        """Stored prices of the symbols, both ends counted."""
        df = self.prices.read(symbol=symbols)
        df = df if start is None else df.where(F.col(order) >= F.lit(start))
        return df if end is None else df.where(F.col(order) <= F.lit(end))

    def rebuilt(self, symbol: str, bars: DataFrame, columns: tuple[str, ...] = ("close",), align: str = "intersection") -> DataFrame:
        """The symbol's prices anew from its stored legs and the legs' bars."""
        legs = [(r.leg, r.weight) for r in self.legs.read(symbol=symbol).select("leg", "weight").collect()]  # a row a leg
        if not legs:
            raise KeyError(symbol)
        return synthetic(bars, legs, columns, align).withColumn("symbol", F.lit(symbol))

    def described(self) -> DataFrame:
        """symbol, legs as a map from leg to weight, properties as a map (null if none)."""
        legs = self.legs.read().groupBy("symbol").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("leg", "weight")))).alias("legs"))
        if not self.properties.exists():
            return legs.withColumn("properties", F.lit(None).cast("map<string,string>"))
        properties = self.properties.read().groupBy("symbol").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("properties"))
        return legs.join(properties, "symbol", "left")

    def delete(self, symbol: str) -> bool:
        """Remove a symbol from all three tables, its legs first."""
        return any([t.drop(symbol=symbol) for t in (self.legs, self.prices, self.properties)])
