"""Quality: nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.llm.common import small_batches
from tidemark.llm.toxicity import held_out, labelled
from tidemark.llm.wordhash import SPACES, distinct, hash_spans, mix, spans

_U = np.uint64


@dataclass(frozen=True)
class Lsa:
    """Parameters: features of the hashed term space, dimensions of the vectors, neighbours that vote."""

    features: int = 8192
    dimensions: int = 48
    neighbours: int = 24
    #: labelled rows at most that are fitted and kept as voters, those of the smallest hashes of their ids
    sample: int = 4096
    seed: int = 7


def _kinds() -> np.ndarray:
    """The kind of each byte: lower case and non-ASCII letters, capitals, digits; a sign stands for itself."""
    kinds = np.arange(256, dtype=np.uint8)
    kinds[[*range(97, 123), *range(128, 256)]] = 97
    kinds[65:91] = 65
    kinds[48:58] = 48
    return kinds


_KINDS = _kinds()


def terms(texts: list[str], n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, coordinate and count of each text's terms: words, their outlines, pairs of outlines, and how often words recur.

    An outline is the word's runs of capitals, small letters, digits and signs, each run as one.
    """
    data, first, length, of = spans(texts, SPACES)
    if not len(first):
        return of, of.astype(np.int64), of.astype(np.int64)
    word = hash_spans(np.where((data >= 65) & (data < 91), data + 32, data), first, length)
    before = np.cumsum(length) - length
    at = np.arange(int(length.sum())) - np.repeat(before, length) + np.repeat(first, length)
    kind = _KINDS[data[at]]
    head = np.concatenate(([True], kind[1:] != kind[:-1]))
    head[before] = True
    runs = np.add.reduceat(head, before)
    outline = hash_spans(kind[head], np.cumsum(runs) - runs, runs)
    pair = mix(outline[:-1] * _U(3) + mix(outline[1:] + _U(77)))[of[1:] == of[:-1]]
    order = np.lexsort((word, of))
    again = np.zeros(len(word), bool)
    again[order[1:]] = (word[order][1:] == word[order][:-1]) & (of[order][1:] == of[order][:-1])
    long_again = again & (length >= 6)
    share = np.bincount(of, long_again, len(texts)) / np.maximum(np.bincount(of, length >= 6, len(texts)), 1)
    recur = np.repeat(np.arange(len(texts)), 4), np.repeat(mix((np.minimum(share, 0.99) * 8).astype(np.uint64) + _U(501)), 4) + np.tile(np.arange(4, dtype=np.uint64), len(texts)) * _U(1 << 60)
    items = np.concatenate([word, outline + _U(1), pair, recur[1]])
    texts_of = np.concatenate([of, of, of[1:][of[1:] == of[:-1]], recur[0]])
    return distinct(texts_of, (mix(items) % _U(n_features)).astype(np.int64))


def vectors(texts: list[str], idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit latent vectors: damped counts times idf, through the basis.  A text without terms is the zero vector."""
    of, at, n = terms(texts, len(idf))
    value = ((1 + np.log(np.maximum(n, 1))) * idf[at]).astype(np.float32)
    out = np.zeros((len(texts), basis.shape[1]), np.float32)
    if len(of):
        starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        norm = np.sqrt(np.add.reduceat(value * value, starts))
        out[of[starts]] = np.add.reduceat(basis[at] * value[:, None], starts) / norm[:, None]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _basis(texts: list[str], idf: np.ndarray, p: Lsa) -> np.ndarray:
    """Right singular vectors of the sample's term matrix, by a randomised range finder."""
    of, at, n = terms(texts, p.features)
    a = np.zeros((len(texts), p.features), np.float32)
    a[of, at] = (1 + np.log(np.maximum(n, 1))) * idf[at]
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
    q = np.linalg.qr(a @ np.random.RandomState(p.seed).randn(p.features, min(p.dimensions + 16, max(len(texts), 1))).astype(np.float32))[0]
    for _ in range(2):
        q = np.linalg.qr(a @ (a.T @ q))[0]
    found = np.linalg.svd(q.T @ a, full_matrices=False)[2][: p.dimensions].T
    return np.pad(found, ((0, 0), (0, p.dimensions - found.shape[1]))).astype(np.float32)


def document_frequencies(texts: DataFrame, p: Lsa) -> tuple[np.ndarray, int]:
    """In how many of all documents each coordinate occurs, and their number; summed in Spark, a row a task and coordinate."""

    def run(batches):
        count, rows = np.zeros(p.features, np.int64), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.column(0).slice(start, 128).to_pylist()
                rows += len(part)
                count += np.bincount(terms(part, p.features)[1], minlength=p.features)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int64()), pa.array([*count[at], rows], pa.int64())], ["at", "n"])

    summed = small_batches(texts.select("text")).mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()  # p.features + 1 rows at most
    df, total = np.zeros(p.features), 0
    for r in summed:
        if r["at"] < 0:
            total = r.n
        else:
            df[r["at"]] = r.n
    return df, total


def train(documents: DataFrame, labels: DataFrame, p: Lsa = Lsa(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """idf over all documents; basis and labelled vectors from at most p.sample labelled documents, fitted in one task."""
    texts = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df, total = document_frequencies(texts, p)
    idf = (np.log((1 + total) / (1 + df)) + 0.1).astype(np.float32)
    rows = labelled(documents, labels, p.sample, id_col, text_col, label_col).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "label")

    def learn(batches):
        found = [(y, t) for b in batches for t, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        texts = [t for _, t in found]
        basis = _basis(texts, idf, p)
        v = np.concatenate([vectors(texts[i : i + 128], idf, basis) for i in range(0, len(texts), 128)] or [np.zeros((0, p.dimensions), np.float32)])
        label = np.array([y for y, _ in found], np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([basis.tobytes(), v.tobytes(), label.tobytes()], pa.binary())], ["part"])

    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")
    learned = [bytes(r[0]) for r in ordered.mapInArrow(learn, "part binary").collect()]  # a few MB, by p
    # Spark runs no task over a join that it knows to be empty
    basis, v, label = learned or (np.zeros((p.features, p.dimensions), np.float32).tobytes(), b"", b"")
    return {
        "idf": idf,
        "basis": np.frombuffer(basis, np.float32).reshape(p.features, p.dimensions),
        "vectors": np.frombuffer(v, np.float32).reshape(-1, p.dimensions),
        "labels": np.frombuffer(label, np.float32),
    }


def vote(v: np.ndarray, model: dict, k: int) -> np.ndarray:
    """Similarity-weighted share of label 1 among the k nearest labelled vectors, from the exact products of a block.

    All vectors as near as the k-th vote, so ties do not depend on an order.
    """
    labels = model["labels"]
    if not len(labels):
        return np.full(len(v), 0.5)
    # rounded, so that the shape of a block does not decide what is nearer or alike
    near = np.round((v.astype(np.float64) @ model["vectors"].astype(np.float64).T), 5)
    k = min(k, len(labels))
    kth = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
    w = np.where(near >= kth, np.maximum(near, 0) ** 4 + 1e-9, 0)
    return np.clip(np.round((w @ labels) / w.sum(1), 9), 0, 1)


def scored(documents: DataFrame, model: dict, p: Lsa = Lsa(), text_col: str = "text", score_col: str = "score") -> DataFrame:
    """documents with the neighbours' vote on each whole text in a further column; a null text counts as empty."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # sized by p

    @pandas_udf("double")
    def score(text):
        import pandas as pd

        m, out = sent.value, []
        for start in range(0, len(text), 128):
            out.append(vote(vectors(text.iloc[start : start + 128].fillna("").tolist(), m["idf"], m["basis"]), m, p.neighbours))
        return pd.Series(np.concatenate(out).astype(float) if out else np.zeros(0))

    return small_batches(documents).withColumn(score_col, score(F.col(text_col)))


def quality(documents: DataFrame, labels: DataFrame, p: Lsa = Lsa(), threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Learns from labels that are not held out.  Scores depend on the text alone; a text without words (null, empty,
    blank) is the zero vector, as near to all voters, so that all vote with one weight.  A null id is not held out.  Repeated rows give
    repeated rows, an empty table an empty result.  Without labels every score is 0.5.  Other columns are not read.
    """
    model = train(documents, labels.where(~held_out()), p)
    texts = documents.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return scored(texts, model, p).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
