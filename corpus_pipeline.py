"""From raw documents to packed training sequences, in stages that each write a table for the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, near_dedup, packing, pii, toxicity
from tidemark.llm.common import shared_folder, table
from tidemark.llm.queries import PII_KEY, WORD_BPE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go.  The model learns from the labelled rows of the source table that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    model = toxicity.train(table(spark, sf_dir, "documents"), labels)
    rows = docs.select(F.struct("*").alias("doc"), F.col("text"))
    return toxicity.scored(rows, model).where(F.col("score") < 0.5).select("doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.marked(docs.select(F.struct("*").alias("doc"), "doc_id", "text")).where("dedup.kept").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the smallest doc_id."""
    return near_dedup.kept_rows(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data; n_chars follows the text."""
    rows = pii.redacted(docs.select(F.struct("*").alias("doc"), F.col("text")), PII_KEY)
    text = F.col("pii.text")
    new = {"text": text, "n_chars": F.when(text.isNull(), F.col("doc")["n_chars"]).otherwise(F.char_length(text).cast("bigint"))}
    return rows.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    return packing.best_fit_pack(docs, WORD_BPE, capacity=2048, end_id=0, cached=16 << 20, keep=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", hide_personal_data),
    ("packing", pack),
]

#: Training, signatures and token ids have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
