"""Leftmost-longest dictionary matching and inflection counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave import storage
from termweave.functions import scan, stem, text
from termweave.operators import cooc

#: A vocabulary is sent to all tasks up to so many paths; beyond, it is joined by exchange.
BROADCAST_PATHS = 200_000
#: Up to so many paths are held by every task.
ROW_PATHS = 500
HITS = "array<struct<start:int,n:int,term:string,surface:string>>"


def matches(windows: DataFrame, vocab: DataFrame, how: str = "lower", gate: bool = False) -> DataFrame:
    """Terms found in each window (doc_id, win_ix, words): (doc_id, win_ix, start, n, term, surface)."""
    return each(in_windows(windows, vocab, how, gate))


def each(hits: DataFrame) -> DataFrame:
    """One row for each match of windows with their matches."""
    return hits.select("doc_id", "win_ix", F.inline("hits"))


def in_windows(windows: DataFrame, vocab: DataFrame, how: str = "lower", gate: bool = False) -> DataFrame:
    """Windows with the terms found in them: (doc_id, win_ix, hits); those without any are left out.

    From left to right the longest path that begins at a word is taken and its words are
    skipped. With ``gate`` a path matches only words outside the closed word classes. A
    vocabulary of a checked size of up to ROW_PATHS is matched inside each batch of windows,
    without any exchange; a larger one is joined by the paths' first lemmas.
    """
    paths = _held(vocab)
    if paths is not None:
        return _in_batches(windows.select("doc_id", "win_ix", "words"), paths, how, gate)
    bounds = vocab.agg(F.max("n").alias("n"), F.count("*").alias("k")).first()
    if windows.isStreaming:
        raise ValueError(f"a stream is matched against at most {ROW_PATHS} paths")
    seen = windows.select("doc_id", "win_ix", "words", stem.lemmas(F.col("words"), how).alias("lemmas"))
    if gate:
        seen = seen.withColumn("ok", text.allowed(F.col("words")))
    return _by_join(seen, vocab, bounds["n"] or 1, bounds["k"] <= BROADCAST_PATHS, gate)


def in_texts(docs: DataFrame, vocab: DataFrame, how: str = "lower", gate: bool = False, shown: bool = False) -> DataFrame:
    """Sentences of (doc_id, text) with the terms found in them: (doc_id, win_ix, hits).

    With a vocabulary of up to ROW_PATHS each text is split and matched in one go, so no
    words leave the batch they were read in. ``shown`` adds the column ``sentence``, the
    words of a sentence with several matches joined by blanks, else null.
    """
    paths = _held(vocab)
    if paths is None:
        windows = cooc.windows(docs, 1)
        hits = in_windows(windows, vocab, how, gate)
        if not shown:
            return hits
        return hits.join(windows.select("doc_id", "win_ix", text.name(F.col("words")).alias("sentence")), ["doc_id", "win_ix"])
    return _in_batches(docs.select("doc_id", "text"), paths, how, gate, shown)


def _held(vocab: DataFrame) -> list[scan.Path] | None:
    """The paths of a vocabulary of up to ROW_PATHS; else None."""
    rows = vocab.select("n", "path", "term").distinct().limit(ROW_PATHS + 1).collect()
    return [scan.Path(r["n"], tuple(r["path"]), r["term"]) for r in rows if r["n"] == len(r["path"])] if len(rows) <= ROW_PATHS else None


def _in_batches(rows: DataFrame, paths: list[scan.Path], how: str, gate: bool, shown: bool = False) -> DataFrame:
    """Matching of (doc_id, text) or (doc_id, win_ix, words) against paths that every task holds."""
    matcher, whole = scan.Matcher(paths, how, gate), "text" in rows.columns

    def run(batches):
        for batch in batches:
            for piece in scan.pieces(batch, "text") if whole else [batch]:
                words = scan.sentences(piece["text"]) if whole else scan.given(piece["words"], piece["win_ix"])
                yield matcher.hits(words, piece["doc_id"], shown)

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, win_ix int, hits {HITS}" + (", sentence string" if shown else "")
    if not paths:
        return rows.limit(0).select("doc_id", F.lit(0).alias("win_ix"), F.array().cast(HITS).alias("hits"), *([F.lit(None).cast("string").alias("sentence")] if shown else []))
    return rows.mapInArrow(run, schema)


def _leftmost(hits: Column) -> Column:
    """Of matches in order of their starts, those that no taken one before covers."""
    free = lambda taken, h: h["start"] >= F.element_at(taken, -1)["start"] + F.element_at(taken, -1)["n"]
    return F.aggregate(F.slice(hits, F.lit(2), F.size(hits)), F.slice(hits, 1, 1), lambda taken, h: F.when(free(taken, h), F.concat(taken, F.array(h))).otherwise(taken))


def _by_join(seen: DataFrame, vocab: DataFrame, longest: int, small: bool, gate: bool) -> DataFrame:
    """Matching by an equi-join of words with first lemmas.

    Only the words that a path could cover travel with each position.
    """
    at = lambda i: F.struct(
        i.alias("start"), F.slice("lemmas", i + 1, longest).alias("ahead"), F.slice("words", i + 1, longest).alias("surface"),
        *([F.slice("ok", i + 1, longest).alias("ok")] if gate else []),
    )
    places = seen.where(F.size("lemmas") > 0).select("doc_id", "win_ix", F.explode(F.transform(F.sequence(F.lit(0), F.size("lemmas") - 1), at)).alias("p"))
    places = places.select("doc_id", "win_ix", "p.*").withColumn("first", F.element_at("ahead", 1))
    keyed = vocab.select(F.element_at("path", 1).alias("first"), "path", "term", "n").distinct()
    joined = places.join(F.broadcast(keyed) if small else keyed, "first")
    fits = F.slice("ahead", F.lit(1), F.col("n")) == F.col("path")
    if gate:
        fits = fits & F.forall(F.slice("ok", F.lit(1), F.col("n")), lambda x: x)
    hits = joined.where(fits).select("doc_id", "win_ix", "start", "n", "term", text.name(F.slice("surface", F.lit(1), F.col("n"))).alias("surface"))
    best = F.max_by(F.struct("start", "n", "term", "surface"), "n")
    longest_ones = hits.groupBy("doc_id", "win_ix", "start").agg(best.alias("h"))
    grouped = longest_ones.groupBy("doc_id", "win_ix").agg(F.array_sort(F.collect_list("h")).alias("hits"))
    return grouped.select("doc_id", "win_ix", _leftmost(F.col("hits")).alias("hits"))


def inflections(found: DataFrame, vocab: DataFrame) -> DataFrame:
    """How often each surface form stood for each term: (term, surface, cnt, first_ord).

    The definition of a term counts once and comes first; then matches by place. Raises
    ValueError where a surface form stands for two terms.
    """
    defined = vocab.where(F.col("surface").isNotNull()).select("term", "surface", F.struct(F.lit(-1).cast("bigint").alias("d"), F.lit(-1).alias("w"), F.lit(-1).alias("s")).alias("ord"))
    met = found.select("term", "surface", F.struct(F.col("doc_id").cast("bigint").alias("d"), F.col("win_ix").cast("int").alias("w"), F.col("start").alias("s")).alias("ord"))
    return merged(defined.unionByName(met).groupBy("term", "surface").agg(F.count("*").alias("cnt"), F.min("ord").alias("first_ord")))


def merged(counts: DataFrame) -> DataFrame:
    """Sum inflection counts, for tables that were put together; a conflict is a ValueError."""
    summed = storage.cut(counts.groupBy("term", "surface").agg(F.sum("cnt").alias("cnt"), F.min("first_ord").alias("first_ord")))
    clash = summed.groupBy("surface").agg(F.min("term").alias("a"), F.max("term").alias("b")).where("a <> b").limit(1).collect()
    if clash:
        raise ValueError(f"{clash[0]['surface']!r} stands for both {clash[0]['a']!r} and {clash[0]['b']!r}")
    return summed


def dominant(counts: DataFrame) -> DataFrame:
    """The most frequent surface form of each term; of equal ones the first recorded."""
    w = Window.partitionBy("term").orderBy(F.desc("cnt"), "first_ord", "surface")
    return counts.withColumn("r", F.row_number().over(w)).where("r = 1").select("term", "surface", "cnt")


def lemma_counts(counts: DataFrame) -> DataFrame:
    """Total count of each term."""
    return counts.groupBy("term").agg(F.sum("cnt").alias("cnt"))


def decode(names: DataFrame, counts: DataFrame) -> DataFrame:
    """Terms of display names (name): by exact surface form, else by its lower case; else null."""
    known = counts.select("surface", "term").distinct()
    exact = names.join(known.withColumnsRenamed({"surface": "name", "term": "exact"}), "name", "left")
    lowered = exact.withColumn("low", F.lower("name")).join(known.withColumnsRenamed({"surface": "low", "term": "lowered"}), "low", "left")
    return lowered.select("name", F.coalesce("exact", "lowered").alias("term"))
