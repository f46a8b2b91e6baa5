"""Importance resampling towards a target distribution, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, numbered

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: every ASCII character that is neither letter nor digit.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words in order: A-Z lower-cased, cut at ASCII signs; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN, -1), lambda w: w != "")


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def with_buckets(texts: DataFrame, buckets: int) -> DataFrame:
    """texts (words and other columns) with `features`, the bucket of every word and of every two consecutive words."""
    n_pairs = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", F.lit(1), n_pairs), F.slice("words", F.lit(2), n_pairs), lambda a, b: F.concat(a, F.lit(" "), b))
    return texts.withColumn("features", F.concat(F.transform("words", lambda w: bucket(w, buckets)), F.transform(pairs, lambda p: bucket(p, buckets))))


def bucket_counts(featured: DataFrame) -> DataFrame:
    """bucket and n: counted before the shuffle, so one row a bucket and task is sent."""
    return featured.select(F.explode("features").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain of all buckets: thousandths of the log ratio of smoothed frequencies, floored."""
    spark = source.sparkSession
    s, t = (bucket_counts(x).withColumnRenamed("n", name) for x, name in ((source, "s"), (target, "t")))
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    both = durable(both)
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    up = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets).cast("double")
    down = (F.col("s") + 1).cast("double") * (F.col("all_t") + buckets).cast("double")
    return both.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(up / down)).alias("gain"))


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with `rank`, 1, 2, 3... in that order: a distributed sort, then each partition's offset is added to its places."""
    place = F.monotonically_increasing_id()
    part, row = F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("row")
    written = durable(rows.orderBy(*order).select("*", part, row))
    sizes = written.groupBy("part").agg(F.count("*").alias("size"))
    # one row a partition of the sort
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return written.join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + F.col("row") + 1).drop("part", "row", "offset", "size")


def resample(
    documents: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank.

    Features are words and pairs of consecutive words in `buckets` buckets; a document's weight is the floored mean of
    its features' gains, frequent in target and rare in documents counting for more.  The score adds Gumbel noise drawn
    from the seed and the id, so the highest scores are a sample without replacement in proportion to exp(weight / 1000).
    Of the N documents with at least `least_words` words floor(percent * N / 100) are drawn, the highest scores first,
    ties to the smaller doc_id; the others have a null rank.

    Null and empty texts have no features and a weight of 0.  Each row is a document: rows that repeat an id share its
    noise and are ranked by the larger number of features where scores are equal too.  A null id counts as an empty
    text in the noise and comes after all others in ties.  An empty target leaves the frequencies of documents alone
    to decide; an empty table gives an empty result.  Other columns are not read.
    """
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), words(F.col(text_col)).alias("words"))
    featured = with_buckets(rows, buckets).select("doc_id", F.size("words").alias("n_words"), "features")
    featured = numbered(featured)
    aims = with_buckets(target.select(words(F.col(target_text)).alias("words")), buckets)
    gain = gains(featured, aims, buckets)
    each = featured.select("row_no", F.explode("features").alias("bucket"))
    # the gain table has `buckets` rows whatever the input
    sums = each.join(F.broadcast(gain), "bucket").groupBy("row_no").agg(F.sum("gain").alias("gains"))
    n = F.size("features").cast("bigint")
    weight = F.expr("(gains - pmod(gains, n_features)) div n_features")
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    known = featured.select("row_no", "doc_id", "n_words", n.alias("n_features")).join(sums, "row_no", "left").withColumn("weight", F.when(F.col("n_features") > 0, weight).otherwise(0).cast("bigint"))
    scored = known.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0))))
    scored = durable(scored.select("doc_id", "n_words", "n_features", "weight", "score"))
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ranked = placed(able, F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
