"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import content_key, durable, sized_join

#: `[\\x20\\x09-\\x0D]`, stripped at both ends of a line.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _keys(text: Column, least: int) -> Column:
    """For each line 128 bits of its key; null for keys under `least` code points."""
    keys = F.transform(F.split(F.translate(text, UPPER, LOWER), "\n", -1), lambda line: F.btrim(line, F.lit(STRIPPED)))
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= least, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("second"), k).alias("h2"))))


def line_keys(documents: DataFrame, least: int) -> DataFrame:
    """One row for each document and distinct long key: doc_id, k1, k2, h1, h2.  documents: doc_id, text, k1, k2."""
    distinct = F.array_distinct(F.filter(_keys(F.col("text"), least), lambda k: k.isNotNull()))
    return documents.select("doc_id", "k1", "k2", F.explode(distinct).alias("k")).select("doc_id", "k1", "k2", "k.h1", "k.h2")


class LineRuns:
    """Runs of (h1, h2, n_docs, top_id), each sorted by hash and written to the shared folder.

    A batch is one run of level 0; `fanout` runs of a level are merged into one of the next, so a hash is rewritten
    once a level.  An entry is settled for a batch if it already counts `enough` documents and its top_id is not below
    the batch's: the batch's own entry could not change the outcome, so the merge-anti-join leaves it out.
    """

    def __init__(self, enough: int = 3, fanout: int = 4):
        self.enough, self.fanout = enough, fanout
        self.levels: list[list[DataFrame]] = []

    @staticmethod
    def merged(runs: Iterable[DataFrame]) -> DataFrame:
        runs = list(runs)
        whole = runs[0]
        for r in runs[1:]:
            whole = whole.unionByName(r)
        return whole.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("top_id").alias("top_id"))

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys whose hash no run has: what a plain first-come deduplication keeps of a new batch."""
        for run in (r for level in self.levels for r in level):
            keys = keys.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Merge-anti-join a batch (doc_id, h1, h2) with the settled entries of the runs and add its own run."""
        own = keys.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("top_id"))
        for run in (r for level in self.levels for r in level):
            settled = run.where(F.col("n_docs") >= self.enough).select("h1", "h2", F.col("top_id").alias("settled_id"))
            own = own.join(settled, (own["h1"] == settled["h1"]) & (own["h2"] == settled["h2"]) & (F.col("settled_id") >= F.col("top_id")), "left_anti")
        self._push(0, durable(own.sortWithinPartitions("h1", "h2")))

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._push(level + 1, durable(self.merged(runs).sortWithinPartitions("h1", "h2")))

    def entries(self) -> DataFrame:
        return self.merged(r for level in self.levels for r in level)


def batches_of(spark: SparkSession, path: str, batches: int, id_col: str = "doc_id") -> list[DataFrame]:
    """A parquet table as that many batches, whose rows are all its rows: groups of its files, or shares by a hash of the id if it has fewer."""
    whole = spark.read.parquet(path)
    files = sorted(whole.inputFiles())
    if len(files) >= batches:
        return [spark.read.schema(whole.schema).parquet(*files[i::batches]) for i in range(batches)]
    return [whole.where(F.pmod(F.xxhash64(id_col), F.lit(batches)) == i) for i in range(batches)]


def drop_lines(documents: DataFrame, batches: Iterable[DataFrame], least: int = 20, enough: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text without dropped lines) of every document.

    Keys of at least `least` code points found in at least `enough` documents lose all their lines except in the
    document of the largest id that holds them.  The rule needs counts over all documents, so there are two sweeps:
    every batch adds its run, then all lines are anti-joined with the merged runs' frequent keys.
    A null or empty text is one empty line.  Each row counts as a document; rows that repeat the largest id all keep
    their lines, and a null id is smaller than all others.  An empty table gives an empty result.
    """

    def plain(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        # what a row loses follows from its id and text, so rows are told by these and repeated rows share a key
        return rows.select("doc_id", "text", *content_key(F.col("doc_id"), F.col("text")))

    runs = LineRuns(enough)
    for batch in batches:
        runs.add(line_keys(plain(batch), least))
    frequent = durable(runs.entries().where(F.col("n_docs") >= enough).select("h1", "h2", "top_id"))
    docs = plain(documents)
    lost = (
        sized_join(line_keys(docs, least), frequent, ["h1", "h2"], "inner", row_bytes=64)
        .where((F.col("doc_id") < F.col("top_id")) | (F.col("doc_id").isNull() & F.col("top_id").isNotNull()))
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))
    )
    lines, lost_keys = F.split("text", "\n", -1), F.coalesce("lost", F.array().cast("array<struct<h1:bigint,h2:bigint>>"))
    # zipped rather than looked up by place: an expression inside a lambda is evaluated for every line
    gone = F.transform(_keys(F.col("text"), least), lambda k: F.coalesce(F.array_contains(F.col("lost_keys"), k), F.lit(False)))
    marked = F.zip_with(lines, gone, lambda line, lost: F.struct(line.alias("line"), lost.alias("lost")))
    stay = F.transform(F.filter(marked, lambda m: ~m["lost"]), lambda m: m["line"])
    kept = docs.join(lost, ["k1", "k2"], "left").select("doc_id", F.size(lines).cast("bigint").alias("n_lines"), "text", "lost", lost_keys.alias("lost_keys"))
    kept = kept.select("doc_id", "n_lines", F.when(F.col("lost").isNull(), lines).otherwise(stay).alias("stay"))
    return kept.select("doc_id", "n_lines", (F.col("n_lines") - F.size("stay")).alias("n_dropped"), F.array_join("stay", "\n").alias("kept"))
