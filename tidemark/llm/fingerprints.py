"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs, in DataFrame functions only.

A paragraph's elements are its own hash and the hashes of its neighbouring word pairs.  An element adds one bit to each
of 128 lanes, the bits of a 128-bit hash, and one to a count; a fingerprint is the vector of these sums modulo 2**24.
It does not depend on the order of paragraphs, texts with the same paragraphs have the same one, and a paragraph is
put in or taken out by adding or subtracting its own vector.  With every bit read as a sign, the lanes are a random
projection of the element counts, so the cosine of two fingerprints estimates the cosine of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable

LANES, MODULUS, HEX = 128, 1 << 24, 6
#: Two lanes of 32 bits in a long: bits j and j + 32 of a hash, for j from 0 to 31.
_PAIR = (1 << 32) | 1


def elements(text: Column) -> Column:
    """One array of 64-bit hashes for each paragraph (a line; an empty text is one empty paragraph)."""
    hashed = F.transform(
        F.split(text, "\n", -1),
        lambda p: F.struct(F.xxhash64(p).alias("own"), F.transform(F.split(p, " ", -1), lambda w: F.xxhash64(w)).alias("words")),
    )
    return F.flatten(
        F.transform(
            hashed,
            lambda p: F.concat(
                F.array(p["own"]),
                F.zip_with(p["words"], F.slice(p["words"], 2, F.size(p["words"])), lambda a, b: F.xxhash64(a, b)),
            ),
        )
    )


def _sums() -> list[Column]:
    sums = [F.count("e").alias("n")]
    for h in ("e", "e2"):
        sums += [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_PAIR))).alias(f"{h}_{j}") for j in range(32)]
    return sums


def _lanes() -> Column:
    """The vector: lanes in order, then the count, modulo 2**24."""
    mask = F.lit(MODULUS - 1)
    found = []
    for h in ("e", "e2"):
        found += [F.col(f"{h}_{j}").bitwiseAND(mask) for j in range(32)]
        found += [F.shiftrightunsigned(f"{h}_{j}", 32).bitwiseAND(mask) for j in range(32)]
    return F.array(*found, F.col("n").bitwiseAND(mask))


def vectors(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys and the fingerprint vector, `lanes`, of the texts that share them, summed (one text: its own)."""
    exploded = rows.select(*keys, F.explode(elements(F.col(text_col))).alias("e")).withColumn("e2", F.xxhash64("e"))
    return exploded.groupBy(*keys).agg(*_sums()).select(*keys, _lanes().alias("lanes"))


def added(a: Column, b: Column) -> Column:
    """The vector of the multiset union: paragraphs inserted."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(MODULUS)))


def removed(a: Column, b: Column) -> Column:
    """The vector of the multiset difference: paragraphs deleted."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(MODULUS)))


def as_text(lanes: Column) -> Column:
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), HEX, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two vectors' lanes read as signed sums, 0 if negative; 1 for equal vectors."""

    def signed(lanes: Column) -> Column:
        return F.transform(F.slice(lanes, 1, LANES), lambda x: (2 * x - F.element_at(lanes, LANES + 1)).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    x, y = signed(a), signed(b)
    cosine = F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(cosine, F.lit(0.0)))))


def with_next(documents: DataFrame, buckets: int) -> DataFrame:
    """bucket, guest, text_hash, doc_id, text and the next row's text in descending order of ids, after the last the first.

    Rows are dealt to buckets of neighbouring ids, at quantiles of the ids, and one shuffle brings a bucket together.
    Its last row needs the next bucket's first one, which joins it as a guest; there is one guest a bucket.
    """
    quantiles = [k / buckets for k in range(1, buckets)]
    bounds = documents.where(F.col("doc_id").isNotNull()).agg(F.percentile_approx("doc_id", quantiles, 10 * buckets)).first()[0] or []
    bounds = sorted({int(b) for b in bounds}, reverse=True)
    rank = F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b >= F.col("doc_id"))).cast("bigint")
    # null ids come last, in the order of their texts' hashes
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1).cast("bigint") + F.floor((F.col("text_hash") / 2.0**62 + 1) / 2 * buckets).cast("bigint")).otherwise(rank)
    rows = documents.withColumn("bucket", bucket)
    place = F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id").alias("id"), (-F.col("text_hash")).alias("hash"))
    firsts = sorted((r.bucket, r.best.id, -r.best.hash) for r in rows.groupBy("bucket").agg(F.max(place).alias("best")).collect())  # a row a bucket
    guests = [(*row, firsts[i - 1][0]) for i, (_, *row) in enumerate(firsts)]
    spark = documents.sparkSession
    guest = F.broadcast(spark.createDataFrame(guests, "guest_id bigint, guest_hash bigint, bucket bigint"))
    same = F.col("doc_id").eqNullSafe(F.col("guest_id")) & (F.col("text_hash") == F.col("guest_hash"))
    # rows that repeat an id with its text are equal: one of them is the guest
    invited = rows.drop("bucket").join(guest, same).groupBy("bucket", "text_hash", "doc_id").agg(F.min("text").alias("text"))
    both = rows.select("bucket", "text_hash", "doc_id", "text", F.lit(False).alias("guest")).unionByName(invited.withColumn("guest", F.lit(True)))
    both = both.withColumn("nth", F.row_number().over(in_order()))
    return both.withColumn("next_text", F.lead("text").over(in_order("nth")))


def in_order(last: str = "text_hash"):
    return Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text_hash", last)


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text ends in the beginning of the next document: its last floor(n_chars / 3) code points are replaced by
    the next one's first as many (or all), in descending order of ids, after the last the first; a null id comes last,
    rows that repeat an id follow in the order of their texts' hashes, so that every scan has the same order.  A null text counts as empty.  A single document is its
    own next.  An empty table gives an empty result.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # 63 bits, so that the order of hashes can be turned round
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.shiftright(F.xxhash64(text), 1).alias("text_hash"))
    buckets = 3 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, cut = F.char_length("text").cast("bigint"), F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    pair = with_next(rows, buckets).select("bucket", "guest", "text_hash", "nth", "doc_id", "text", n.alias("n_chars"), F.when(~F.col("guest"), edited).alias("edited"))
    keys = ["bucket", "guest", "text_hash", "nth", "doc_id", "n_chars", "edited_sha256"]
    texts = pair.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).select(
        *keys, F.explode(F.filter(F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("t")), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("t"))), lambda s: s["t"].isNotNull())).alias("s")
    )
    lanes = vectors(texts.select(*keys, "s.is_edited", F.col("s.t").alias("t")), [*keys, "is_edited"], "t")
    both = lanes.groupBy(*keys).agg(F.max(F.when(~F.col("is_edited"), F.col("lanes"))).alias("own"), F.max(F.when(F.col("is_edited"), F.col("lanes"))).alias("edited"))
    then = both.withColumn("next", F.lead("own").over(in_order("nth"))).where(~F.col("guest"))
    return then.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
