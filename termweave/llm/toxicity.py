"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

A text's features are the buckets of its words, its neighbouring word pairs and its
pairs with one word between; each counts once. Training is follow-the-regularised-
leader with per-coordinate rates; its L1 term leaves few weights other than zero, so
the model that executors get is a short list of buckets and weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import common, words

#: Labelled toxic rows that fit the model, at most about so many, and other rows for each of them.
TRAINING_ROWS = 3_000
OTHERS = 3
BITS = 20
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2.5, 0.1
THRESHOLD = 0.7


@dataclass(frozen=True)
class Weights:
    """Buckets with a weight other than zero, in order, and the bias."""

    buckets: np.ndarray
    values: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        table = np.zeros(1 << BITS, dtype=np.float32)
        table[self.buckets] = self.values
        return table


def features(found: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every feature of some rows, repeats included."""
    rows = np.repeat(np.arange(len(found.bounds) - 1), np.diff(found.bounds))
    own, kinds = [rows], [found.hashes]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        same = rows[gap:] == rows[:-gap]
        own.append(rows[gap:][same])
        kinds.append(words.mix(found.hashes[:-gap][same] * np.uint64(3) + found.hashes[gap:][same] + np.uint64(salt)))
    return np.concatenate(own), (np.concatenate(kinds) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal with one rate per coordinate; the last coordinate is the bias."""

    def __init__(self) -> None:
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def step(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Train on (text, toxic) rows in order of their mark; give buckets and weights."""
    model, seen = Ftrl(), []
    for batch in batches:
        raw, ends = common.text_buffers(batch.column("text"))
        labels = batch.column("toxic").to_pylist()
        marks = batch.column("mark").to_pylist()
        for a, b in common.runs(ends):
            rows, buckets = features(words.find(raw, ends[a : b + 1], words.LETTER_OR_DIGIT))
            pairs = np.unique(rows << BITS | buckets)
            cuts = np.searchsorted(pairs, np.arange(b - a + 1) << BITS)
            for k in range(b - a):
                at = (pairs[cuts[k] : cuts[k + 1]] & ((1 << BITS) - 1)).astype(np.int32)
                seen.append((marks[a + k], np.append(at, np.int32(1 << BITS)), labels[a + k]))
    seen.sort(key=lambda x: (x[0], x[2], len(x[1])))
    for _ in range(EPOCHS):
        for _, at, label in seen:
            model.step(at, label)
    every = np.arange((1 << BITS) + 1)
    w = model.weights(every)
    kept = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(w[kept], pa.float64())], ["bucket", "weight"])


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Weights:
    """Fit the weights on at most about ``rows`` toxic texts and three times as many others.

    Labels are taken only of rows without the hold-out mark; of repeated labels of a
    doc_id the greater counts, null labels and null texts do not. All rows of a rarer
    class are used; of a more frequent one a hash of doc_id picks its share. The picked
    labels are bounded in number, so they are sent to all tasks that read texts.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000))
    share = F.when(F.col("toxic") == 1, min(1.0, rows / max(1, sizes.get(1, 0)))).otherwise(min(1.0, OTHERS * rows / max(1, sizes.get(0, 0))))
    picked = marked.withColumn("mark", mark).where(F.col("mark") / 1e9 < share)
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id").select("text", "toxic", F.xxhash64("doc_id", F.lit("order")).alias("mark"))
    found = sample.repartition(1).mapInArrow(fit, "bucket bigint, weight double").toPandas()
    values = dict(zip(found["bucket"], found["weight"]))
    bias = values.pop(1 << BITS, 0.0)
    at = np.array(sorted(values), dtype=np.int64)
    return Weights(at, np.array([values[k] for k in at], dtype=np.float32), bias)


def score_batches(model_of, threshold: float):
    """Arrow function from (doc_id, text) to scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Weights = model_of.value
        table = model.dense()
        for batch in batches:
            raw, ends = common.text_buffers(batch.column("text"))
            sums = np.full(len(batch), model.bias)
            for a, b in common.runs(ends):
                rows, buckets = features(words.find(raw, ends[a : b + 1], words.LETTER_OR_DIGIT))
                hit = np.flatnonzero(table[buckets])
                pairs = np.unique(rows[hit] << BITS | buckets[hit])
                sums[a:b] += np.bincount(pairs >> BITS, weights=table[pairs & ((1 << BITS) - 1)], minlength=b - a)
            score = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """Score each row's whole text; one row out for each row in.

    A null or empty text has no features: its score is the bias alone. With no labels
    to learn from every score is one half.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(score_batches(held, threshold), "doc_id bigint, score double, predicted int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; hold-out rows took no part in the training."""
    docs = common.read(spark, sf_dir, "documents")
    model = train(docs, common.read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
