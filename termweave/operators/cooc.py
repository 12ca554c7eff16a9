"""Windows, co-occurring pairs, their counts and the cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions import text


def sentence_rows(docs: DataFrame, paragraphs: bool = False) -> DataFrame:
    """One row (doc_id, sent_ix, words) for each sentence or paragraph of (doc_id, text)."""
    return docs.select("doc_id", F.posexplode(text.sentences(F.col("text"), paragraphs)).alias("sent_ix", "words"))


def windows(docs: DataFrame, width: int = 1, paragraphs: bool = False, mode: str = "reference") -> DataFrame:
    """Windows (doc_id, win_ix, words) of ``width`` sentences that follow each other.

    Mode ``reference`` has the first ceil(n / width) offsets only, as the original
    semantics do; ``sliding`` has all n - width + 1 (one at least). Paragraphs need
    width 1.
    """
    if width < 1 or (paragraphs and width != 1):
        raise ValueError("the width must be at least 1, and 1 for paragraphs")
    if mode not in ("reference", "sliding"):
        raise ValueError(f"unknown window mode {mode!r}")
    held = docs.select("doc_id", text.sentences(F.col("text"), paragraphs).alias("s"))
    last = F.ceil(F.size("s") / width).cast("int") - 1 if mode == "reference" else F.greatest(F.size("s") - width, F.lit(0))
    # no filter before: it would be pushed to where the texts are read and split them there again
    cut = F.when(F.size("s") > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.flatten(F.slice("s", i + 1, width))))
    return held.select("doc_id", F.posexplode(cut).alias("win_ix", "words"))


def pairs(found: DataFrame, keys: tuple[str, ...] = ("doc_id", "win_ix"), item: str = "term") -> DataFrame:
    """All ordered pairs of different terms of each window: (*keys, src, dst).

    The distinct terms of a window are brought together once; the pairs come from that
    array, so there is no self-join and no second exchange.
    """
    return _ordered(found.groupBy(*keys).agg(F.collect_set(item).alias("t")), keys)


def window_pairs(hits: DataFrame) -> DataFrame:
    """The same from windows with their matches, where nothing has to be brought together."""
    return _ordered(hits.select("doc_id", "win_ix", _terms()), ("doc_id", "win_ix"))


def _terms() -> Column:
    """The distinct terms of a window's matches."""
    return F.array_distinct(F.col("hits.term")).alias("t")


def _ordered(sets: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each term of an array with each other one; one side is exploded first, so no array of all pairs is made."""
    one = sets.where(F.size("t") > 1).select(*keys, F.explode("t").alias("src"), "t")
    return one.select(*keys, "src", F.explode("t").alias("dst")).where("src <> dst")


def definition_pairs(found: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs from a glossary head to each other term of a sentence of its definition.

    ``heads`` is (doc_id, term); ``found`` the matches in definitions.
    """
    there = found.select("doc_id", "win_ix", F.col("term").alias("dst")).distinct()
    return there.join(heads.select("doc_id", F.col("term").alias("src")), "doc_id").where("src <> dst").select("doc_id", "win_ix", "src", "dst")


def counts(found: DataFrame) -> DataFrame:
    """Number of windows of each pair: (src, dst, cnt)."""
    return found.groupBy("src", "dst").agg(F.count("*").alias("cnt"))


def histogram(counted: DataFrame) -> DataFrame:
    """How many pairs have each count."""
    return counted.groupBy("cnt").agg(F.count("*").alias("pairs"))


def statistics(counted: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Largest, smallest and mean count, as one row.

    ``sources`` (term) are all terms with an entry; one without pairs makes the smallest
    count 0. Without pairs all three are 0.
    """
    row = counted.agg(F.coalesce(F.max("cnt"), F.lit(0)).alias("max_cnt"), F.coalesce(F.min("cnt"), F.lit(0)).alias("min_cnt"), F.coalesce(F.avg("cnt"), F.lit(0.0)).alias("avg_cnt"))
    if sources is None:
        return row
    alone = sources.select(F.col("term").alias("src")).join(counted.select("src").distinct(), "src", "left_anti").agg((F.count("*") > 0).alias("alone"))
    return row.join(F.broadcast(alone)).select("max_cnt", F.when(F.col("alone"), F.lit(0)).otherwise(F.col("min_cnt")).alias("min_cnt"), "avg_cnt")


def cutoff(counted: DataFrame, keep: float = 80) -> DataFrame:
    """One row with the smallest count that is kept: max(int(largest · (100 - keep) %), 1)."""
    if not 0 <= keep <= 100:
        raise ValueError("keep must be from 0 to 100")
    share = (100.0 - keep) / 100.0
    return counted.agg(F.greatest((F.coalesce(F.max("cnt"), F.lit(0)) * F.lit(share)).cast("bigint"), F.lit(1)).alias("cutoff"))


def kept(counted: DataFrame, keep: float = 80) -> DataFrame:
    """The pairs that reach the cutoff; the cutoff's single row is sent to all tasks."""
    return counted.join(F.broadcast(cutoff(counted, keep)), F.col("cnt") >= F.col("cutoff")).select("src", "dst", "cnt")


def pair_sentences(found: DataFrame, cut: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct window texts of each kept pair: (src, dst, sentence)."""
    there = found.join(cut.select("src", "dst"), ["src", "dst"])
    shown = texts.select("doc_id", "win_ix", text.name(F.col("words")).alias("sentence"))
    return there.join(shown, ["doc_id", "win_ix"]).select("src", "dst", "sentence").distinct()


def distinct_texts(hits: DataFrame) -> DataFrame:
    """The different texts of windows with their matches, and their terms: (t, sentence).

    Equal texts have equal terms, so texts are made distinct before pairs leave them.
    """
    return hits.where("sentence is not null").select(_terms(), "sentence").distinct()


def text_pairs(texts: DataFrame, cut: DataFrame) -> DataFrame:
    """Distinct window texts of each kept pair, from different texts with their terms: (src, dst, sentence)."""
    return _ordered(texts, ("sentence",)).join(cut.select("src", "dst"), ["src", "dst"]).select("src", "dst", "sentence")


def membership(sources: DataFrame, cut: DataFrame) -> DataFrame:
    """Included and excluded terms: (term, included); a glossary term can be both."""
    inside = cut.select(F.col("src").alias("term")).union(cut.select("dst")).distinct().withColumn("included", F.lit(True))
    outside = sources.select("term").distinct().join(cut.select(F.col("src").alias("term")).distinct(), "term", "left_anti").withColumn("included", F.lit(False))
    return inside.unionByName(outside)
