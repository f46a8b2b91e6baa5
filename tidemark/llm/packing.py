"""Best-fit packing of tokenised documents, planned over the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, id_and_text
from tidemark.llm.tokens import CACHED, TOGETHER, Chunks, map_encoded

PIECES = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(documents: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cached: int = CACHED, keep: bool = True, together: int = TOGETHER) -> DataFrame:
    """Pieces of at most `capacity` tokens of every document with its end token; only longer documents are cut."""

    end = end_id.to_bytes(4, "little")

    def made(codec: Chunks, batch: pa.RecordBatch, encoded: list[bytes]) -> pa.RecordBatch:
        of, piece, start, length, crc = [], [], [], [], []
        for n, ids in enumerate(encoded):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                of.append(n)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    rows = id_and_text(documents, id_col, text_col)
    return map_encoded(rows, path, made, PIECES.format(id=rows.schema["doc_id"].dataType.simpleString()), cached, keep, together)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first rank, end rank, pieces a bin, first bin, offset).

    Open bins are held as ranges of equal bins by the room left in them.  Of a length, the pieces go to the tightest
    bins that have room; a bin that has room for several takes them all before the next one, as best fit would.
    A length visits a range at most once, and a visit splits it into three at most, so the plan's size depends on the
    capacity and not on the number of documents.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def open_(left: int, first: int, n: int) -> None:
        if left and n:
            room[left].append((first, n))

    runs, bins = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        for level in [*sorted(x for x in room if x >= length), capacity]:
            if not left:
                break
            each = level // length
            ranges = room.pop(level, []) if level < capacity else []
            if level == capacity:
                ranges = [(bins, -(-left // each))]
                bins += ranges[0][1]
            while ranges and left:
                first, n = ranges.pop()
                full = min(n, left // each)
                if full:
                    runs.append((length, rank, rank + full * each, each, first, capacity - level))
                    open_(level - each * length, first, full)
                    rank, left = rank + full * each, left - full * each
                if full < n and left:
                    runs.append((length, rank, rank + left, left, first + full, capacity - level))
                    open_(level - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                if full < n and level < capacity:
                    ranges.append((first + full, n - full))
            for first, n in ranges:
                open_(level, first, n)
    return runs


def pack(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """Give every piece its sequence and its offset there.

    Pieces are ranked within their length; runs of the plan then claim ranks.  Ranks are counted in two steps, within
    (length, salt) and over the salts' counts, so a length that a third of all pieces have is spread over many tasks.
    Only the histogram, at most `capacity` rows, reaches the driver.
    """
    spark = parts.sparkSession
    parts = durable(parts)
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(histogram, capacity)
    slots = spark.createDataFrame(runs, "length bigint, from_rank bigint, to_rank bigint, per_bin bigint, first_bin bigint, base bigint")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("local", local).join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("local") - 1)
    place = F.col("rank") - F.col("from_rank")
    # the plan's rows are counted: they depend on the capacity only
    claimed = ranked.join(F.broadcast(slots) if len(runs) <= 500_000 else slots, (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    return claimed.select(
        "doc_id",
        "piece",
        "start",
        ranked["length"],
        "ids_crc32",
        (F.col("first_bin") + F.floor(place / F.col("per_bin"))).cast("bigint").alias("sequence_id"),
        (F.col("base") + F.pmod(place, F.col("per_bin")) * ranked["length"]).cast("bigint").alias("offset"),
    )


def best_fit_pack(documents: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cached: int = CACHED, keep: bool = True, together: int = TOGETHER) -> DataFrame:
    """Pack every document into as few sequences as best-fit decreasing takes.

    A null or empty text is its end token alone.  Repeated rows are packed each for itself, even with equal ids; null
    ids too.  An empty table gives an empty result.  Other columns are not read.  `cached`, `keep` and `together` trade the
    encoder's time for a worker's memory (`map_encoded`).
    """
    return pack(pieces(documents, path, capacity, end_id, id_col, text_col, cached, keep, together), capacity)
