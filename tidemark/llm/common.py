"""Helpers shared by the text operators: tables, cuts of lineage, Arrow batches, joins by size."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a local session that names none, as in tests, gets one of this machine."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Run df once and keep its rows as a table in the shared folder, so that a lost executor costs a read, not a recount.

    A table has true sizes and single columns to read, which the planner needs where many such tables are joined.  The
    tables go when the application ends.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/table-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(path.toString())
    return spark.read.schema(df.schema).parquet(path.toString())


def numbered(df: DataFrame, name: str = "row_no") -> DataFrame:
    """A number for each row that tells repeated rows apart, kept with the rows as a table (`durable`).

    How a scan is split, and so the numbers, may change from scan to scan; whoever needs them twice reads this table.
    """
    return durable(df.withColumn(name, F.monotonically_increasing_id()))


def content_key(*columns: Column) -> list[Column]:
    """k1 and k2, 128 bits that stand for the columns' values: the same in every scan, shared by rows that are equal in them."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit("second"), *columns).alias("k2")]


def id_and_text(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the operators read; a null text counts as empty, other columns are left behind."""
    return documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and what they keep adds up with the next stage's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Bytes of an Arrow batch on its way to a Python worker, whatever its rows' length.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches bounded to BATCH_BYTES: a task holds a batch on both sides of its worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(df.sparkSession.conf.get(key))
    if not 0 < held <= BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = 512) -> DataFrame:
    """mapInArrow with a per-task setup: make() runs once in a task, what it returns runs on slices of at most `rows` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield apply(batch.slice(start, rows))
        give_back()

    return small_batches(df).mapInArrow(run, schema)


#: Rows of one key that one task joins.
HOT_ROWS = 100_000


def sized_join(
    big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", row_bytes: int = 64, most_bytes: int = 8 << 20, total_bytes: int | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """Join to a table whose size is counted first: broadcast it if it is small, else shuffle both sides by key.

    `small` has one row for each key and should be durable, as it is counted and then read.  `counts`, keys and
    `key_rows`, tells how many rows of the big side a key has: keys with more than HOT_ROWS are dealt out by a salt as
    well, and only their rows of the small side are copied, once for each salt; there are no more such keys than
    all rows / HOT_ROWS.  Other skew is left to the adaptive join, which splits large partitions.
    """
    if (small.count() * row_bytes if total_bytes is None else total_bytes) <= most_bytes:
        return big.join(F.broadcast(small), keys, how)
    if counts is None:
        return big.join(small, keys, how)
    hot = durable(counts.where(F.col("key_rows") > HOT_ROWS).select(*keys, F.ceil(F.col("key_rows") / HOT_ROWS).alias("join_salts")))
    if not (n_hot := hot.count()):
        return big.join(small, keys, how)
    few = F.broadcast(hot) if n_hot * 64 <= most_bytes else hot
    salts = F.coalesce("join_salts", F.lit(1).cast("bigint"))
    salted = big.join(few, keys, "left").withColumn("join_salt", F.pmod(F.monotonically_increasing_id(), salts)).drop("join_salts")
    copies = small.join(few, keys, "left").withColumn("join_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("join_salts")
    return salted.join(copies, [*keys, "join_salt"], how).drop("join_salt")
