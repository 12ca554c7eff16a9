"""Pair counts over a stream of documents, kept up to date as documents arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termweave.operators import cooc, match


def stream_pairs(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Ordered pairs of different terms of each sentence of (doc_id, text): (src, dst), without state.

    Terms are lower-case, of any number of words; the longest that begins at a word is
    taken, as in a batch. Each sentence is judged alone inside its row, so only the
    counting needs state.
    """
    rows = [(t.split(" "), t, len(t.split(" "))) for t in dict.fromkeys(terms)]
    words = docs.sparkSession.createDataFrame(rows, "path array<string>, term string, n int")
    hits = match.in_windows(cooc.windows(docs, 1), words, "lower")
    return cooc.window_pairs(hits).select("src", "dst")


def stream_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Running (src, dst, cnt) of a stream of (doc_id, text); for output mode update or complete."""
    return stream_pairs(docs, terms).groupBy("src", "dst").agg(F.count("*").alias("cnt"))


def start(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Start the counting into an in-memory table, for tests and small uses."""
    return counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).start()
