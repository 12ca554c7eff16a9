"""Vocabularies: paths of lemmas and the terms they stand for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions import scan, stem, text

EQUIVALENT = "<="


def from_heads(heads: DataFrame, column: str = "head", how: str = "stem") -> DataFrame:
    """Vocabulary of glossary heads, with the surface form of each: (path, term, surface, n)."""
    words = heads.select(text.words(F.col(column)).alias("w")).where(F.size("w") > 0)
    return _rows(words.select("w", F.col("w").alias("canonical")), how).distinct()


def from_terms(terms: DataFrame, column: str = "text", how: str = "stem") -> DataFrame:
    """Vocabulary of a term list, one term a sentence; ``A <= B`` makes B another path to A.

    Both the lemmas and the plain words of B lead to A. Empty sentences do not count.
    Raises ValueError where one path leads to two terms, or a term to itself.
    """
    each = terms.select(F.explode(text.sentences(F.col(column))).alias("w")).where(F.size("w") > 0)
    at = F.array_position("w", EQUIVALENT)
    plain = each.where(at == 0).select("w", F.col("w").alias("canonical"))
    pairs = each.where(at > 0).select(F.slice("w", F.lit(1), (at - 1).cast("int")).alias("a"), F.expr(f"slice(w, cast(array_position(w, '{EQUIVALENT}') as int) + 1, size(w))").alias("b"))
    owners = pairs.select(F.col("a").alias("w"), F.col("a").alias("canonical"))
    own = _rows(plain.unionByName(owners), how)
    alias = pairs.select(stem.lemmas(F.col("b"), how).alias("path"), text.name(stem.lemmas(F.col("a"), how)).alias("term"))
    raw = pairs.select(F.col("b").alias("path"), text.name(stem.lemmas(F.col("a"), how)).alias("term"))
    aliases = alias.unionByName(raw).distinct()
    looped = aliases.where(text.name(F.col("path")) == F.col("term")).limit(1).collect()
    if looped:
        raise ValueError(f"cycle on {looped[0]['term']!r}")
    found = own.unionByName(aliases.select("path", "term", F.lit(None).cast("string").alias("surface"), F.size("path").alias("n"))).distinct()
    return check(found)


def from_links(links: DataFrame, content: DataFrame, how: str = "stem") -> DataFrame:
    """Vocabulary of the links (page_id, link) that occur in their page's text (page_id, text)."""
    there = links.join(content, "page_id").where(F.contains(F.col("text"), F.col("link")))
    words = there.select(text.words(F.col("link")).alias("w")).where((F.size("w") > 0) & (text.name(F.col("w")) != "1"))
    terms = words.select(stem.lemmas(F.col("w"), how).alias("path")).distinct()
    return terms.select("path", text.name(F.col("path")).alias("term"), text.name(F.col("path")).alias("surface"), F.size("path").alias("n"))


def _rows(words: DataFrame, how: str) -> DataFrame:
    path = stem.lemmas(F.col("w"), how)
    return words.select(path.alias("path"), text.name(stem.lemmas(F.col("canonical"), how)).alias("term"), text.name(F.col("canonical")).alias("surface")).withColumn("n", F.size("path"))


def check(vocab: DataFrame) -> DataFrame:
    """The vocabulary, if each path leads to one term; else ValueError."""
    clash = vocab.groupBy("path").agg(F.min("term").alias("a"), F.max("term").alias("b")).where("a <> b").limit(1).collect()
    if clash:
        raise ValueError(f"{' '.join(clash[0]['path'])!r} leads to both {clash[0]['a']!r} and {clash[0]['b']!r}")
    return vocab


def most_frequent(docs: DataFrame, words: int = 60, pairs: int = 20, least: int = 4, stop: tuple[str, ...] = ()) -> DataFrame:
    """Vocabulary of the words and word pairs that the most documents have.

    Words are lower-case, of ``least`` characters or more, without "." and "<" and "="
    and outside ``stop``; pairs are neighbours in a sentence, both among those words.
    Equal counts: the smaller term. The result has at most ``words + pairs`` rows, which
    come from two passes over the texts; a batch's counts leave it, not its words.
    """
    def counted(picked):
        """Tasks that count, batch by batch, the texts that have each picked item."""

        def run(batches):
            for batch in batches:
                for piece in scan.pieces(batch, "text"):
                    found = scan.sentences(piece["text"])
                    known, codes = scan.lowered(found)
                    row = np.repeat(found.rows, np.diff(found.bounds))
                    terms, dfs = picked(found, known, codes, row)
                    yield pa.RecordBatch.from_pydict({"term": terms.cast(pa.string()), "df": pa.array(dfs, pa.int64())})

        return docs.select("text").mapInArrow(run, "term string, df bigint")

    def single(found, known, codes, row):
        odd = pc.or_(pc.match_substring_regex(known, "[.<=]"), pc.less(pc.utf8_length(known), least))
        fit = (~odd.to_numpy(zero_copy_only=False) & (scan.index(known, list(stop)) < 0))[codes]
        items, dfs = scan.row_counts(row[fit], codes[fit], max(len(known), 1))
        return known.take(pa.array(items)), dfs

    best = lambda t, k: t.groupBy("term").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "term").limit(k).collect()
    top = [(r["term"], r["df"]) for r in best(counted(single), words)]
    chosen = [term for term, _ in top]

    def double(found, known, codes, row):
        place = scan.index(known, chosen)[codes]
        inside = np.ones(len(codes), dtype=bool)  # whether a word's follower is in its sentence
        inside[(found.bounds[1:] - 1)[np.diff(found.bounds) > 0]] = False
        at = np.flatnonzero(inside[:-1] & (place[:-1] >= 0) & (place[1:] >= 0))
        k = len(chosen)
        items, dfs = scan.row_counts(row[at], place[at] * k + place[at + 1], k * k)
        return pa.array([f"{chosen[i // k]} {chosen[i % k]}" for i in items], pa.string()), dfs

    if chosen:
        top += [(r["term"], r["df"]) for r in best(counted(double), pairs)]
    rows = docs.sparkSession.createDataFrame(top, "term string, df bigint")
    return rows.select(F.split("term", " ").alias("path"), "term", F.col("term").alias("surface"), F.size(F.split("term", " ")).alias("n"), "df")
