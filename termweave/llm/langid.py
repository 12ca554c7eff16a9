"""Language ID: script ranges narrow the candidates, Viterbi labels spans.

A word's script leaves as candidates the languages whose training text uses it. Each of
these gets a score: the log likelihood of the word's bytes' trigrams and of the word
itself, as a posterior among the candidates. A Viterbi path over the words with a penalty for each switch labels spans of
mixed-language text; a document's language is the one with the most labelled letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm import common, words

#: Rows per language that fit the classifier, at most about so many (chosen by a hash).
TRAINING_ROWS = 2_000
TRAINING_PARTS = 4
#: Tables are dense up to so many languages and sparse beyond; all languages are learned.
DENSE_LANGUAGES = 256
BUCKETS = 1 << 16
SWITCH_PENALTY = 14.0
FLOOR = -5.0
#: Score of a language that is no candidate for a word; one foreign name costs less than two switches.
OUT_OF_SCRIPT = -10.0
#: Scripts by their code points, Latin first; what is in none of them is of no script.
RANGES = (
    ("Latin", 0x41, 0x24F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x370, 0x3FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F),
    ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x6FF), ("Syriac", 0x700, 0x74F), ("Arabic", 0x750, 0x77F), ("Thaana", 0x780, 0x7BF), ("Nko", 0x7C0, 0x7FF),
    ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF), ("Gurmukhi", 0xA00, 0xA7F), ("Gujarati", 0xA80, 0xAFF), ("Oriya", 0xB00, 0xB7F), ("Tamil", 0xB80, 0xBFF),
    ("Telugu", 0xC00, 0xC7F), ("Kannada", 0xC80, 0xCFF), ("Malayalam", 0xD00, 0xD7F), ("Sinhala", 0xD80, 0xDFF), ("Thai", 0xE00, 0xE7F), ("Lao", 0xE80, 0xEFF),
    ("Tibetan", 0xF00, 0xFFF), ("Myanmar", 0x1000, 0x109F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Ethiopic", 0x1200, 0x139F), ("Khmer", 0x1780, 0x17FF),
    ("Mongolian", 0x1800, 0x18AF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF), ("Han", 0xF900, 0xFAFF), ("Han", 0x20000, 0x323AF),
)
SCRIPTS = ("none", *dict.fromkeys(name for name, _, _ in RANGES))
_sorted = sorted(RANGES, key=lambda x: x[1])
STARTS, STOPS = np.array([a for _, a, _ in _sorted]), np.array([b for _, _, b in _sorted])
SCRIPT_OF_RANGE = np.array([SCRIPTS.index(name) for name, _, _ in _sorted], np.uint8)
UNDETERMINED = "und"
HAS_LETTER = regex.compile(r"\p{L}")
SPANS = "spans array<struct<start:int,end:int,lang:string>>"


@dataclass(frozen=True)
class Sparse:
    """Log likelihoods by bucket: each language's base, and what the buckets it has add."""

    base: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    adds: np.ndarray

    def sums(self, buckets: np.ndarray, row: np.ndarray, rows: int, candidates: np.ndarray) -> np.ndarray:
        """Sum of each row's buckets for each candidate."""
        k, first = len(self.base), self.starts[buckets]
        sizes = self.starts[buckets + 1] - first
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        row_of = np.repeat(row, sizes)
        if len(candidates) < k:
            place = np.full(k, -1)
            place[candidates] = np.arange(len(candidates))
            own = np.flatnonzero(place[self.langs[at]] >= 0)
            at, row_of, langs = at[own], row_of[own], place[self.langs[at[own]]]
        else:
            langs = self.langs[at]
        k = len(candidates)
        found = np.bincount(row_of * k + langs, weights=self.adds[at], minlength=rows * k).reshape(rows, k)
        return found + np.bincount(row, minlength=rows)[:, None] * self.base[candidates]


@dataclass(frozen=True)
class Model:
    """Languages and their tables: log likelihood by bucket, and which scripts each uses."""

    langs: tuple[str, ...]
    trigrams: np.ndarray | Sparse
    tokens: np.ndarray | Sparse
    scripts: np.ndarray

    def candidates(self, script: int) -> np.ndarray:
        """Languages that use a script; all, if none does."""
        used = np.flatnonzero(self.scripts[script])
        return used if len(used) else np.arange(len(self.langs))


def trigram_buckets(found: words.Words) -> np.ndarray:
    """Bucket of the three bytes around each letter; 0 stands beyond a word's ends."""
    here = found.letters.astype(np.uint32)
    before, after = np.zeros_like(here), np.zeros_like(here)
    before[1:], after[:-1] = here[:-1], here[1:]
    before[found.first] = 0
    after[found.first + found.lengths - 1] = 0
    return ((before * np.uint32(0x01000193) ^ here) * np.uint32(0x85EBCA6B) ^ after * np.uint32(0xC2B2AE35)) * np.uint32(0x9E3779B1) >> np.uint32(16)


def word_scripts(found: words.Words) -> np.ndarray:
    """The script of each word; of several, that which is last in SCRIPTS."""
    if not len(found.first):
        return np.zeros(0, np.uint8)
    b = found.letters
    script = (b < 0x80).astype(np.uint8)
    lead = np.flatnonzero(b >= 0xC0)
    if len(lead):
        size = 2 + (b[lead] >= 0xE0) + (b[lead] >= 0xF0)
        point = b[lead].astype(np.int64) & (0x7F >> size)
        for k in range(1, 4):
            more = k < size
            point[more] = point[more] << 6 | b[lead[more] + k] & 0x3F
        at = np.searchsorted(STARTS, point, side="right") - 1
        script[lead] = np.where(point <= STOPS[at], SCRIPT_OF_RANGE[at], 0)
    return np.maximum.reduceat(script, found.first)


def count_features(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Feature counts of one part of one language's training rows."""
    counts = [np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPTS), np.int64)]
    raw, ends = common.text_buffers(pa.array(rows["text"], pa.string()))
    for a, b in common.runs(ends):
        found = words.find(raw, ends[a : b + 1], words.LETTER)
        for table, at in zip(counts, (trigram_buckets(found), found.hashes >> np.uint64(48), word_scripts(found))):
            table += np.bincount(at.astype(np.int64), minlength=len(table))
    every = np.concatenate(counts)
    at = np.flatnonzero(every)
    return pd.DataFrame({"lang": [key[0]], "at": [at.astype("<i4").tobytes()], "counts": [every[at].astype("<i8").tobytes()]})


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Whether a row is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 0, F.lit(False))


def train(docs: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Fit the tables on at most about ``rows`` labelled rows of each language.

    Training rows have a text, a lang and no hold-out mark. All of a rarer language's
    rows are used; of a more frequent one a hash of doc_id picks its share. Their
    counts are summed in a fixed number of groups. Every lang is learned, however many
    there are.
    """
    usable = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    shares = docs.sparkSession.createDataFrame([(lang, rows / n) for lang, n in sizes.items() if n > rows], "lang string, share double")
    spot = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1_000_000)) / 1_000_000.0
    sample = usable.join(F.broadcast(shares), "lang", "left").where(spot < F.coalesce("share", F.lit(1.0))).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(TRAINING_PARTS)))
    parts = common.materialize(sample.groupBy("lang", "part").applyInPandas(count_features, "lang string, at binary, counts binary"), "languages")
    found: dict[str, list] = {}
    for r in parts.toLocalIterator():
        found.setdefault(r["lang"], []).append((np.frombuffer(r["at"], "<i4"), np.frombuffer(r["counts"], "<i8")))
    langs = tuple(sorted(found))
    dense = len(langs) <= DENSE_LANGUAGES
    trigrams, tokens, scripts = [], [], []
    for lang in langs:
        at, counts = (np.concatenate(x) for x in zip(*found.pop(lang)))
        three, whole, script = np.split(np.bincount(at, weights=counts, minlength=2 * BUCKETS + len(SCRIPTS)), [BUCKETS, 2 * BUCKETS])
        for to, count, prior in ((trigrams, three, 0.1), (tokens, whole, 0.5)):
            to.append(log_likelihood(count, prior) if dense else sparse_likelihood(count, prior))
        scripts.append(script >= 1e-4 * max(1.0, script.sum()))
    stack = lambda x: np.ascontiguousarray(np.stack(x, axis=1).astype(np.float32))
    table = stack if dense else stack_sparse
    return Model(langs, table(trigrams), table(tokens), np.stack(scripts, axis=1))


def log_likelihood(count: np.ndarray, prior: float) -> np.ndarray:
    """Smoothed log likelihood of each bucket."""
    return np.log((count + prior) / (count.sum() + prior * BUCKETS))


def sparse_likelihood(count: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The log likelihood of a bucket without a count, the others, and what they add."""
    at = np.flatnonzero(count)
    return np.log(prior / (count.sum() + prior * BUCKETS)), at.astype(np.int32), np.log((count[at] + prior) / prior).astype(np.float32)


def stack_sparse(parts: list[tuple[float, np.ndarray, np.ndarray]]) -> Sparse:
    """Join the languages' buckets, ordered by bucket and then language."""
    bucket = np.concatenate([at for _, at, _ in parts])
    order = np.argsort(bucket, kind="stable")
    langs = np.repeat(np.arange(len(parts), dtype=np.int32), [len(at) for _, at, _ in parts])
    starts = np.append(0, np.cumsum(np.bincount(bucket, minlength=BUCKETS)))
    return Sparse(np.array([base for base, *_ in parts]), starts, langs[order], np.concatenate([add for *_, add in parts])[order])


def some_words(found: words.Words, at: np.ndarray) -> words.Words:
    """Some of the words, as if they were all (of one row)."""
    sizes = found.lengths[at]
    first = np.cumsum(sizes) - sizes
    letters = found.letters[np.repeat(found.first[at] - first, sizes) + np.arange(sizes.sum())]
    return words.Words(np.array([0, len(at)]), found.hashes[at], found.starts[at], sizes, first, letters)


def likelihoods(model: Model, found: words.Words, candidates: np.ndarray) -> np.ndarray:
    """Log likelihood of each candidate for each word; with sparse tables by parts of the words."""
    buckets, whole = trigram_buckets(found), (found.hashes >> np.uint64(48)).astype(np.int64)
    n, k = len(found.first), len(candidates)
    if not isinstance(model.trigrams, Sparse):
        if k == len(model.langs):
            return np.add.reduceat(model.trigrams[buckets], found.first, axis=0) + model.tokens[whole]
        return np.add.reduceat(model.trigrams[buckets[:, None], candidates], found.first, axis=0) + model.tokens[whole[:, None], candidates]
    score = np.empty((n, k), np.float32)
    step = max(1, (1 << 20) // len(model.langs))
    for a in range(0, n, step):
        b = min(n, a + step)
        row = np.repeat(np.arange(b - a), found.lengths[a:b])
        here = buckets[found.first[a] : found.first[b - 1] + found.lengths[b - 1]].astype(np.int64)
        score[a:b] = model.trigrams.sums(here, row, b - a, candidates) + model.tokens.sums(whole[a:b], np.arange(b - a), b - a, candidates)
    return score


def word_scores(model: Model, found: words.Words) -> np.ndarray:
    """Score of each language for each word.

    The candidates of the word's script get their log posteriors, not below FLOOR; the
    others are not looked up and get OUT_OF_SCRIPT.
    """
    n, k = len(found.first), len(model.langs)
    out, script = np.full((n, k), OUT_OF_SCRIPT, np.float32), word_scripts(found)
    for kind in np.unique(script):
        at, candidates = np.flatnonzero(script == kind), model.candidates(kind)
        score = likelihoods(model, found if len(at) == n else some_words(found, at), candidates)
        score -= score.max(axis=1, keepdims=True)
        score -= np.log(np.exp(score).sum(axis=1, keepdims=True))
        if score.shape == out.shape:
            return np.maximum(score, FLOOR)
        out[at[:, None], candidates] = np.maximum(score, FLOOR)
    return out


def viterbi(score: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best label path over one document's words."""
    n, k = score.shape
    back = np.zeros((n, k), dtype=np.int32)
    best, own = score[0].copy(), np.arange(k)
    for t in range(1, n):
        top = int(best.argmax())
        switch = best[top] - penalty
        moved = best < switch
        back[t] = np.where(moved, top, own)
        best = np.where(moved, switch, best) + score[t]
    path = np.empty(n, dtype=np.int32)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def paths(score: np.ndarray, bounds: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best label path over the words of each of many documents.

    A path with m switches has m + 1 runs at most that leave a document's best total
    language, and pays m penalties. So if no run of words gains more than half a penalty
    by leaving it (m / (m + 1) at m = 1), no path with switches can beat the constant
    one; that test runs on all documents at once. The others go through the recurrence.
    """
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    at = bounds[:-1][full]
    lead = np.add.reduceat(score.astype(np.float64), at, axis=0).argmax(axis=1)
    path = np.repeat(lead, sizes[full]).astype(np.int32)
    gain = score.astype(np.float64) - score[np.arange(len(path)), path][:, None]
    total = np.cumsum(gain, axis=0)
    before = total - gain
    total -= np.repeat(before[at], sizes[full], axis=0)
    low = total - gain
    step = np.repeat(np.arange(len(full)) * (np.abs(total).max(initial=0.0) * 2 + 1.0), sizes[full])[:, None]
    low = np.minimum.accumulate(low - step, axis=0) + step
    mixed = np.maximum.reduceat((total - low).max(axis=1), at) > penalty / 2 - 1e-3
    for k in np.flatnonzero(mixed):
        a, b = at[k], at[k] + sizes[full[k]]
        path[a:b] = viterbi(score[a:b], penalty)
    return path


def label_batches(model_of, spans: bool):
    """Arrow function from (doc_id, text, ...) rows to their labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = model_of.value
        names = np.array([*model.langs, UNDETERMINED], dtype=object)
        most = common.CHUNK_BYTES * DENSE_LANGUAGES // max(DENSE_LANGUAGES, len(model.langs))
        for batch in batches:
            column = batch.column("text")
            raw, ends = common.text_buffers(column)
            labels, scores, counts, marks = [], [], [], []
            for a, b in common.runs(ends, most):
                letters = np.array([t is not None and HAS_LETTER.search(t) is not None for t in column.slice(a, b - a).to_pylist()])
                best, share, switches, cut = label_run(model, raw, ends[a : b + 1], spans)
                best = np.where(letters, best, len(model.langs))
                labels += names[best].tolist()
                scores += np.where(best < len(model.langs), share, 0.0).tolist()
                counts += switches.tolist()
                marks += [[{"start": int(x), "end": int(y), "lang": names[k]} for x, y, k in row] for row in cut]
            out = [batch.column("doc_id"), pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(counts, pa.int32())]
            fields = ["doc_id", "lang_pred", "score", "n_spans"]
            if spans:
                out.append(pa.array(marks, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                fields.append("spans")
            yield pa.RecordBatch.from_arrays(out, fields)

    return run


def label_run(model: Model, raw: np.ndarray, ends: np.ndarray, spans: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Language index, share of letters, span count and spans of some rows."""
    rows, k = len(ends) - 1, len(model.langs)
    best, share, switches = np.full(rows, k), np.zeros(rows), np.zeros(rows, np.int64)
    cut: list[list] = [[] for _ in range(rows)] if spans else []
    found = words.find(raw, ends, words.LETTER)
    if not k or not len(found.starts):
        return best, share, switches, cut
    path = paths(word_scores(model, found), found.bounds)
    sizes = np.diff(found.bounds)
    row = np.repeat(np.arange(rows), sizes)
    mass = np.bincount(row * k + path, weights=found.lengths, minlength=rows * k).reshape(rows, k)
    full = sizes > 0
    best = np.where(full, mass.argmax(axis=1), k)
    share = np.where(full, mass.max(axis=1) / np.maximum(1, mass.sum(axis=1)), 0.0)
    opens = np.append(True, (path[1:] != path[:-1]) | (row[1:] != row[:-1]))
    switches = np.bincount(row[opens], minlength=rows)
    if spans:
        heads = np.flatnonzero(opens)
        tails = np.append(heads[1:], len(path)) - 1
        origin = ends[:-1] - ends[0]
        for h, t in zip(heads, tails):
            cut[row[h]].append((found.starts[h] - origin[row[h]], found.starts[t] + found.lengths[t] - origin[row[h]], path[h]))
    return best, share, switches, cut


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """Label each row of (doc_id, text); one row out for each row in.

    Gives ``lang_pred``, ``score`` (the share of its letters that the spans of that
    language cover), ``n_spans`` and, if asked for, ``spans`` (byte offsets). A null or
    empty text, or one without a letter, is ``und`` with score 0, as is every text when
    there was nothing to learn from. Equal totals: the smaller language name.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, lang_pred string, score double, n_spans int" + (f", {SPANS}" if spans else "")
    return docs.select("doc_id", "text").mapInArrow(label_batches(held, spans), schema)


def label_rows(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of each row with its ``lang_pred``, ``score`` and ``n_spans``.

    The label columns replace like-named ones; nothing is joined, so repeated and null
    doc_ids keep their own labels.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    added = ["lang_pred", "score", "n_spans"]
    source = docs.drop(*added)
    names = source.columns
    schema = T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_spans", T.IntegerType())])
    label = label_batches(held, spans=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in label(iter([batch])):
                yield pa.RecordBatch.from_arrays([*batch.columns, *(found.column(c) for c in added)], [*names, *added])

    return source.mapInArrow(run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label every document; hold-out rows took no part in the training."""
    docs = common.read(spark, sf_dir, "documents")
    labels = identify(docs, train(docs))
    return labels.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_spans")
