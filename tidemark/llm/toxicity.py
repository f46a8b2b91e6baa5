"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.llm.common import durable, map_batches, small_batches
from tidemark.llm.wordhash import SIGNS, distinct, hash_spans, mix, spans

_U = np.uint64


@dataclass(frozen=True)
class Ftrl:
    """Parameters: feature space of 2**bits; alpha and beta set the per-coordinate rates alpha / (beta + sqrt(sum g^2))."""

    bits: int = 20
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 20.0
    l2: float = 1.0
    passes: int = 4
    #: labelled rows at most that the weights are fitted on, those of the smallest hashes of their ids
    sample: int = 20_000


def features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and coordinate of the distinct words, pairs, and pairs that skip a word, of each text.

    Words also count by their beginnings of four to six bytes, so that inflected forms share a coordinate.
    """
    data, first, length, of = spans([t.lower() for t in texts], SIGNS)
    h = hash_spans(data, first, length)
    found, texts_of = [h], [of]
    for stem in (4, 5, 6):
        longer = length > stem
        found.append(mix(hash_spans(data, first[longer], np.full(longer.sum(), stem)) + _U(stem)))
        texts_of.append(of[longer])
    for step, salt in ((1, 0x5851F42D4C957F2D), (2, 0x14057B7EF767814F)):
        if len(h) > step:
            same = of[step:] == of[:-step]
            found.append(mix(h[:-step] * _U(3) + mix(h[step:] + _U(salt)))[same])
            texts_of.append(of[step:][same])
    where = (np.concatenate(found) >> _U(64 - bits)).astype(np.int64)
    of, where, _ = distinct(np.concatenate(texts_of), where)
    return of, where


def fit(rows: list[tuple[int, np.ndarray]], p: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates and weights that the L1 term leaves, and the bias, from (label, coordinates) in order."""
    z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    bias_z = bias_n = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= p.l1, 0.0, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))

    bias = 0.0
    for _ in range(p.passes):
        for label, at in rows:
            za, na = z[at], n[at]
            w = weight(za, na)
            bias = -bias_z / ((p.beta + np.sqrt(bias_n)) / p.alpha + p.l2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
            after = na + g * g
            z[at] = za + g - (np.sqrt(after) - np.sqrt(na)) / p.alpha * w
            n[at] = after
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / p.alpha * bias
            bias_n += g * g
    w = weight(z, n)
    kept = np.flatnonzero(w)
    return kept, w[kept], bias


def labelled(documents: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """doc_id, text, label of `sample` labelled documents at most, those of the smallest hashes of their ids.

    Labels that are null, whose id is null or that no document has are left out; an id labelled twice counts once, with the larger label; of
    the texts of an id that several rows have, the one of the smallest hash stands.  So there are `sample` rows at most.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("label"))
    texts = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # labels without a document do not take a place in the sample
    known = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = durable(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # two passes, so that an id that many rows have moves hashes and not texts
    hashes = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.char_length("text").alias("n"))).alias("one"))
    one = durable(chosen.join(hashes, "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "one.h", "one.n"))
    found = texts.join(F.broadcast(one), (texts["doc_id"] == one["doc_id"]) & (F.xxhash64("text") == one["h"]) & (F.char_length("text") == one["n"]))
    return found.select(one["doc_id"], "text", "label").dropDuplicates(["doc_id"])


def train(documents: DataFrame, labels: DataFrame, p: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Fit the weights on labelled documents.

    At most p.sample labelled rows are taken (`labelled`), so the one task that runs through them in order holds a
    bounded number of coordinates: 2**bits a row at most, and no texts.
    Without labels the weights are empty and every score is 0.5.
    """
    rows = labelled(documents, labels, p.sample, id_col, text_col, label_col)

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            of, where = features(texts, p.bits)
            ends = np.searchsorted(of, np.arange(len(texts) + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(where.astype(np.int32)))
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), lists], ["doc_id", "label", "at"])

        return apply

    def learn(batches):
        rows = [(y, np.array(at)) for b in batches for y, at in zip(b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False), strict=True)]
        kept, w, bias = fit(rows, p)
        yield pa.RecordBatch.from_arrays([pa.array([*kept, -1], pa.int64()), pa.array([*w, bias], pa.float64())], ["at", "w"])

    made = map_batches(rows, make, "doc_id string, label int, at array<int>", rows=128)
    ordered = made.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "at")
    model = ordered.mapInArrow(learn, "at bigint, w double").collect()  # the weights that L1 left
    bias = next((r.w for r in model if r["at"] < 0), 0.0)
    kept = sorted((r["at"], r.w) for r in model if r["at"] >= 0)
    return np.array([k for k, _ in kept], np.int64), np.array([w for _, w in kept]), bias


def scored(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = Ftrl.bits, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """documents with the probability of toxicity of each whole text in a further column; a null text counts as empty."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(model)  # at most 2**bits weights
    @pandas_udf("double")
    def score(text):
        import pandas as pd

        kept, w, bias = sent.value
        dense = np.zeros(1 << bits, np.float32)
        dense[kept] = w
        out = []
        for start in range(0, len(text), 128):
            part = text.iloc[start : start + 128].fillna("").tolist()
            of, where = features(part, bits)
            out.append(1 / (1 + np.exp(-np.clip(np.bincount(of, dense[where], len(part)) + bias, -35, 35))))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return small_batches(documents).withColumn(score_col, score(F.col(text_col)))


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """Whether a row's label is kept back: crc32 of the id as text, modulo folds, is 0."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == 0


def toxicity(documents: DataFrame, labels: DataFrame, p: Ftrl = Ftrl(), threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Learns from labels that are not held out.  Scores depend on the text alone, so equal texts score alike; null and
    empty texts have no features and score by the bias.  A null id is not held out.  Repeated rows give repeated rows,
    an empty table an empty result.  Other columns are not read.
    """
    model = train(documents, labels.where(~held_out()), p)
    texts = documents.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return scored(texts, model, p.bits).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
