"""Term networks: parsing each kind of input, building, comparing, properties."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave import storage
from termweave.operators import cooc, graph, match, vocab
from termweave.operators import pagerank as P

LEFT, RIGHT = "left", "right"
EMPTY_PAIRS = "src string, dst string, sentence string"


@dataclass(frozen=True)
class Parsed:
    """What an input gives: pairs of windows, window texts, inflections and all sources."""

    pairs: DataFrame  # doc_id, win_ix, src, dst
    texts: DataFrame  # doc_id, win_ix, words
    inflections: DataFrame  # term, surface, cnt, first_ord
    sources: DataFrame | None = None  # term; None: the ends of the pairs
    hits: DataFrame | None = None  # doc_id, win_ix, hits, sentence; None: texts are joined with the pairs


@dataclass(frozen=True)
class Network:
    """A display graph, the ranked graph of each group, and what is known of its terms."""

    display: graph.Graph
    groups: dict[str, graph.Graph]
    inflections: DataFrame
    find_sentences: Callable[[], DataFrame]
    facts: DataFrame  # one row: min_cnt, max_cnt, avg_cnt, cutoff, total_terms
    members: DataFrame  # term, included
    cached: dict = field(default_factory=dict, compare=False)

    @property
    def sentences(self) -> DataFrame:
        """(src, dst, sentence): distinct window texts of each kept pair, prepared when first asked for."""
        if "sentences" not in self.cached:
            self.cached["sentences"] = self.find_sentences()
        return self.cached["sentences"]

    def node_groups(self) -> DataFrame:
        """(term, groups): the sorted names of the groups that have the term."""
        rows = [g.nodes.select("term", F.lit(name).alias("grp")) for name, g in self.groups.items()]
        every = rows[0]
        for more in rows[1:]:
            every = every.unionByName(more)
        return every.groupBy("term").agg(F.sort_array(F.collect_set("grp")).alias("groups"))

    def names(self) -> DataFrame:
        """(term, name): the dominant inflection of each term."""
        return match.dominant(self.inflections).select("term", F.col("surface").alias("name"))

    def properties(self) -> DataFrame:
        """One row of counts with the names of included and excluded terms."""
        named = self.members.join(self.names(), "term", "left").select("included", F.coalesce("name", "term").alias("name"))
        lists = named.agg(F.sort_array(F.collect_list(F.when(F.col("included"), F.col("name")))).alias("included"), F.sort_array(F.collect_list(F.when(~F.col("included"), F.col("name")))).alias("excluded"))
        return self.facts.join(F.broadcast(lists))

    def metric(self, name: str, group: str, seed=None, bias: float | None = None) -> DataFrame:
        """A metric of one group's graph, kept for later calls."""
        key = (name, group, tuple(seed) if isinstance(seed, list) else seed, bias)
        if key not in self.cached:
            self.cached[key] = storage.cut(P.metric(self.groups[group], name, seed, bias))
        return self.cached[key]


def parse_glossary(rows: DataFrame, how: str = "stem", gate: bool = False) -> Parsed:
    """Pairs from heads to the terms of their definitions: (ord, head, definition) rows."""
    words = vocab.from_heads(rows, how=how)
    docs = rows.select(F.col("ord").cast("bigint").alias("doc_id"), F.col("definition").alias("text"))
    heads = rows.select(F.col("ord").cast("bigint").alias("doc_id"), F.array_join(vocab.stem.lemmas(vocab.text.words(F.col("head")), how), " ").alias("term"))
    wins = cooc.windows(docs, 1)
    found = match.each(storage.cut(match.in_windows(wins, vocab.check(words), how, gate)))
    return Parsed(cooc.definition_pairs(found, heads), wins, match.inflections(found, words), heads.select("term").distinct())


def parse_content(docs: DataFrame, words: DataFrame, width: int = 1, paragraphs: bool = False, how: str = "stem", gate: bool = False, mode: str = "reference") -> Parsed:
    """Pairs of terms of one window of (doc_id, text): for term lists and articles alike."""
    wins, single = cooc.windows(docs, width, paragraphs, mode), width == 1 and not paragraphs
    hits = storage.cut(match.in_texts(docs, words, how, gate, shown=True) if single else match.in_windows(wins, words, how, gate))
    return Parsed(cooc.window_pairs(hits), wins, match.inflections(match.each(hits), words), hits=hits if single else None)


def build(parsed: Parsed, keep: float = 80) -> Network:
    """Count pairs, cut the rare ones off and build the undirected network of the rest."""
    counted = storage.cut(cooc.counts(parsed.pairs))
    sources = counted.select(F.col("src").alias("term")).distinct() if parsed.sources is None else parsed.sources
    cut = storage.cut(cooc.kept(counted, keep))
    built = graph.build(cut).cut()
    members = storage.cut(cooc.membership(sources, cut))
    sums = members.agg(F.count("*").alias("total_terms"))
    facts = cooc.statistics(counted, sources).join(F.broadcast(cooc.cutoff(counted, keep))).join(F.broadcast(sums))

    def sentences() -> DataFrame:
        if parsed.hits is None:
            return storage.cut(cooc.pair_sentences(parsed.pairs, cut, parsed.texts))
        return cooc.text_pairs(storage.cut(cooc.distinct_texts(parsed.hits)), cut)

    return Network(built, {LEFT: built}, parsed.inflections, sentences, facts.select("min_cnt", "max_cnt", "avg_cnt", "cutoff", "total_terms"), members)


def compare(a: Network, b: Network) -> Network:
    """Two networks side by side: one display graph, the ranked graphs left and right."""
    if len(a.groups) != 1 or len(b.groups) != 1 or a.display.kind != b.display.kind:
        raise ValueError("two plain networks of one kind can be compared")
    display = graph.Graph(a.display.kind, a.display.nodes.union(b.display.nodes).distinct(), a.display.arcs.union(b.display.arcs).distinct()).cut()
    inflections = match.merged(a.inflections.unionByName(b.inflections))
    included = a.members.where("included").union(b.members.where("included")).distinct()
    excluded = a.members.where("not included").union(b.members.where("not included")).distinct().join(included.select("term"), "term", "left_anti")
    both = a.facts.withColumn("side", F.lit(0)).unionByName(b.facts.withColumn("side", F.lit(1)))
    merged = both.agg(
        F.min("min_cnt").alias("min_cnt"), F.max("max_cnt").alias("max_cnt"), (F.sum("avg_cnt") / 2.0).alias("avg_cnt"),
        F.when(F.min("cutoff") == F.max("cutoff"), F.min("cutoff")).alias("cutoff"),
    )
    facts = merged.join(F.broadcast(display.nodes.agg(F.count("*").alias("total_terms"))))
    (left,), (right,) = a.groups.values(), b.groups.values()
    return Network(display, {LEFT: left, RIGHT: right}, inflections, lambda: a.sentences.union(b.sentences).distinct(), facts, included.unionByName(excluded))
