"""Soft-membership mixing: document rates that bring domains to target token totals.

A classifier learned from the labelled table gives each document a posterior over the
domains. A document of n tokens with rate r counts r·n·p tokens towards a domain of
posterior p. Projected gradient steps, each one pass over all documents, fit
nonnegative rates whose expected domain totals match the targets in least squares.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm import common, words
from termweave.llm.toxicity import BITS, Ftrl, features

DOMAINS = ("high", "low", "toxic")
#: Share of the mixed corpus that each domain shall have, and the corpus's size in tokens of the input.
WEIGHTS = {"high": 0.90, "low": 0.09, "toxic": 0.01}
SIZE = 1.0
#: Labelled rows of each domain that fit the classifier, at most about so many.
TRAINING_ROWS = 2_500
EPOCHS = 3
MOST_STEPS = 40
CLOSE = 1e-6
SHAPE = np.array([1 if chr(b).islower() else 2 if chr(b).isupper() else 3 if chr(b).isdigit() else 4 if b >= 128 else 5 + b % 59 for b in range(256)], dtype=np.int64)
BIAS = 1 << BITS


@dataclass(frozen=True)
class Classifier:
    """Weights of two logistic models, toxic or not and of high quality or not."""

    buckets: tuple[np.ndarray, np.ndarray]
    values: tuple[np.ndarray, np.ndarray]

    def dense(self) -> np.ndarray:
        table = np.zeros((BIAS + 1, 2), np.float32)
        for k in range(2):
            table[self.buckets[k], k] = self.values[k]
        return table


def document_features(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features as row << BITS | bucket, where rows begin, and each row's words.

    Words, pairs and skip pairs, and how large a share of a text's words begin and end
    with which kinds of characters.
    """
    rows, buckets = features(words.find(raw, ends, words.LETTER_OR_DIGIT))
    found = words.find(raw, ends, words.NOT_BLANK)
    data, sizes = raw[ends[0] : ends[-1]], np.diff(found.bounds)
    own = np.repeat(np.arange(len(sizes)), sizes)
    kind = SHAPE[data[found.starts]] * 64 + SHAPE[data[found.starts + found.lengths - 1]]
    pairs, counts = np.unique(own << 12 | kind, return_counts=True)
    level = np.floor(-np.log2(counts / np.maximum(1, sizes[pairs >> 12]))).astype(np.uint64)
    shape = (words.mix((pairs & 4095).astype(np.uint64) << np.uint64(8) | level) >> np.uint64(64 - BITS)).astype(np.int64)
    every = np.unique(np.concatenate([rows << BITS | buckets, pairs >> 12 << BITS | shape]))
    return every, np.searchsorted(every, np.arange(len(sizes) + 1) << BITS), sizes


def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Train both models on (text, toxic, quality, mark) rows in order of their mark."""
    seen = []
    for batch in batches:
        raw, ends = common.text_buffers(batch.column("text"))
        facts = list(zip(batch.column("mark").to_pylist(), batch.column("toxic").to_pylist(), batch.column("quality").to_pylist()))
        for a, b in common.runs(ends):
            every, cuts, _ = document_features(raw, ends[a : b + 1])
            for k in range(b - a):
                at = (every[cuts[k] : cuts[k + 1]] & (BIAS - 1)).astype(np.int32)
                seen.append((*facts[a + k], np.append(at, np.int32(BIAS))))
    seen.sort(key=lambda x: (*x[:3], len(x[3])))
    for k in range(2):
        model = Ftrl()
        for _ in range(EPOCHS):
            for row in seen:
                model.step(row[3], row[1 + k])
        w = model.weights(np.arange(BIAS + 1))
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), k, np.int32)), pa.array(kept, pa.int64()), pa.array(w[kept], pa.float64())], ["model", "bucket", "weight"])


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Classifier:
    """Fit the classifier on at most about ``rows`` labelled texts of each domain.

    Labels with a null, or whose text is null, do not count; of repeated labels of a
    doc_id the greatest of each kind counts. The picked labels are bounded in number and
    are sent to all tasks that read texts.
    """
    marked = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"), F.max(F.col("quality").cast("int")).alias("quality"))
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    sizes = {r["domain"]: r["count"] for r in marked.groupBy(domain.alias("domain")).count().collect()}
    share = F.array(*(F.lit(min(1.0, rows / max(1, sizes.get(k, 0)))) for k in range(3)))
    picked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1_000_000)) / 1e6 < F.get(share, domain))
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id").select("text", "toxic", "quality", F.xxhash64("doc_id", F.lit("order")).alias("mark"))
    found = sample.repartition(1).mapInArrow(fit, "model int, bucket bigint, weight double").toPandas()
    parts = [found[found["model"] == k].sort_values("bucket") for k in range(2)]
    return Classifier(tuple(p["bucket"].to_numpy() for p in parts), tuple(p["weight"].to_numpy() for p in parts))


def posterior_batches(held, names: list[str]):
    """Arrow function adding token counts and domain posteriors to rows with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value.dense()
        for batch in batches:
            raw, ends = common.text_buffers(batch.column("text"))
            sums, tokens = np.tile(table[BIAS], (len(batch), 1)).astype(float), np.zeros(len(batch), np.int64)
            for a, b in common.runs(ends):
                every, _, tokens[a:b] = document_features(raw, ends[a : b + 1])
                for k in range(2):
                    sums[a:b, k] += np.bincount(every >> BITS, weights=table[every & (BIAS - 1), k], minlength=b - a)
            toxic, high = (1 / (1 + np.exp(-np.clip(sums, -35, 35)))).T
            columns = ((1 - toxic) * high, (1 - toxic) * (1 - high), toxic)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(tokens), *map(pa.array, columns)], [*names, "n_tokens", *DOMAINS])

    return run


def posteriors(docs: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of each row with token count and domain posteriors; a null or blank text has no tokens."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), *(T.StructField(d, T.DoubleType()) for d in DOMAINS)])
    return docs.select(*{*keep, "text"}).mapInArrow(posterior_batches(held, list(keep)), schema)


def rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """A document's rate after some steps: from 1, down each step, never below 0."""
    r = np.ones(len(p))
    for step in steps:
        r = np.maximum(0.0, r - p @ step)
    return r


def fit_rates(soft: DataFrame, targets: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Projected-gradient steps that bring the expected domain totals to ``targets``.

    A step moves each rate against the gradient of the squared error, measured in the
    metric of the documents that can still move (those above 0, and those that the step
    would raise), and projects it on the nonnegative numbers. Each step is one pass over
    all documents; the driver sees one total for each domain and pair of domains. Gives
    the steps that came nearest and their error, as a share of all targets.
    """
    k = len(targets)
    steps: list[np.ndarray] = []
    scale = max(1.0, float(targets.sum()))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, metric = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            p = np.stack([batch.column(d).to_numpy() for d in DOMAINS], axis=1)
            n = batch.column("n_tokens").to_numpy().astype(float)
            r = rates(p, steps)
            sums += p.T @ (n * r)
            metric += (p * (n * (r > 0))[:, None]).T @ p
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*sums, *metric.ravel())], [f"t{i}" for i in range(k + k * k)])

    names = [f"t{i}" for i in range(k + k * k)]
    best, best_error = [], np.inf
    for _ in range(MOST_STEPS):
        row = soft.mapInArrow(totals, ", ".join(f"{n} double" for n in names)).agg(*(F.sum(n).alias(n) for n in names)).first()
        found = np.array([x or 0.0 for x in row])
        error = found[:k] - targets
        size = float(np.abs(error).sum()) / scale
        if size < best_error:
            best, best_error = list(steps), size
        if size < CLOSE:
            break
        metric = found[k:].reshape(k, k)
        steps.append(np.linalg.solve(metric + np.eye(k) * max(1e-9 * np.trace(metric), 1e-9), error))
    return best, best_error


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on doc_id alone."""
    return F.pmod(F.xxhash64(doc_id, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, size: float = SIZE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Posteriors, rate and number of copies of each row of (doc_id, text).

    One row out for each row in, with its columns ``keep`` (like-named ones give way to
    the results). ``copies`` is the rate rounded up or down by a number drawn from
    doc_id, so that its expectation is the rate. Where no rates reach the targets (a
    domain without tokens), the nearest totals that the steps found are kept;
    ``fit_error`` is how far these are off, as a share, and a warning says so where it
    is above CLOSE. Texts without tokens have no say and the rate of their posterior.
    Null and repeated doc_ids are separate documents, equal ones with one draw. An empty
    table gives an empty one; without labels all documents are alike.
    """
    weights = weights or WEIGHTS
    keep = [c for c in keep if c not in {"n_tokens", *DOMAINS, "rate", "copies", "fit_error"}]
    soft = common.materialize(posteriors(docs, learn(docs, labels), keep), "posteriors")
    facts = soft.select("n_tokens", *DOMAINS)
    total = facts.agg(F.sum("n_tokens")).first()[0] or 0
    targets = np.array([weights[d] for d in DOMAINS]) * size * total / sum(weights.values())
    steps, error = fit_rates(facts, targets) if total else ([], 0.0)
    if error > CLOSE:
        warnings.warn(f"the mixed totals are {error:.2g} of all tokens off their targets", stacklevel=2)

    def rate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.stack([batch.column(d).to_numpy() for d in DOMAINS], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(p, steps))], [*batch.schema.names, "rate"])

    rated = soft.mapInArrow(rate_batches, T.StructType([*soft.schema.fields, T.StructField("rate", T.DoubleType())]))
    return rated.withColumns({"copies": F.floor(F.col("rate") + uniform(F.col("doc_id"))).cast("long"), "fit_error": F.lit(float(error))})


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for the production weights."""
    return mix(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
