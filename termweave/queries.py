"""Queries of the term-network operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave import storage
from termweave.functions import ranks as R
from termweave.functions import text
from termweave.oracles import CUT_KEEP, GLOSSARY, ROUNDS, SEED_RANK, STEMS, STOP
from termweave.operators import cooc, graph, match, vocab
from termweave.operators import pagerank as P
from termweave.plans import build
from termweave.plans import network as N
from termweave.plans.session import Session
from termweave.sources import readers


def docs_of(spark: SparkSession, folder: str) -> DataFrame:
    return storage.spread(storage.table(spark, folder, "documents").select("doc_id", "text"))


def words_of(spark: SparkSession, folder: str) -> DataFrame:
    """The derived vocabulary, computed once: it has at most 80 rows by its definition."""
    return storage.cut(vocab.most_frequent(docs_of(spark, folder), stop=STOP))


def hits_of(spark: SparkSession, folder: str) -> DataFrame:
    return match.in_texts(docs_of(spark, folder), words_of(spark, folder).drop("df"), "lower")


def inflections_of(spark: SparkSession, folder: str) -> DataFrame:
    words = words_of(spark, folder).drop("df")
    return match.inflections(match.each(match.in_texts(docs_of(spark, folder), words, "lower")), words)


def counts_of(spark: SparkSession, folder: str) -> DataFrame:
    return cooc.counts(cooc.window_pairs(hits_of(spark, folder)))


def graph_of(spark: SparkSession, folder: str) -> graph.Graph:
    return graph.build(storage.cut(cooc.kept(storage.cut(counts_of(spark, folder)), CUT_KEEP))).cut()


def sentence_split(spark, folder):
    return cooc.sentence_rows(docs_of(spark, folder)).select("doc_id", F.col("sent_ix").cast("bigint").alias("sent_ix"), text.name(F.col("words")).alias("words"))


def sentence_stats(spark, folder):
    rows = cooc.sentence_rows(docs_of(spark, folder))
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.size("words")).cast("bigint").alias("words"), F.count(F.when(F.size("words") == 0, 1)).alias("empty"))


def token_frequency(spark, folder):
    rows = cooc.sentence_rows(docs_of(spark, folder))
    return rows.select(F.explode(text.lower(F.col("words"))).alias("token")).groupBy("token").agg(F.count("*").alias("cnt"))


def vocab_top_terms(spark, folder):
    return words_of(spark, folder).select("term", F.col("n").cast("bigint").alias("n"), "df")


def term_matches(spark, folder):
    return match.each(hits_of(spark, folder)).select("doc_id", F.col("win_ix").cast("bigint").alias("win_ix"), F.col("start").cast("bigint").alias("start"), "term", "surface")


def inflection_counts(spark, folder):
    return inflections_of(spark, folder).select("term", "surface", "cnt")


def dominant_inflection(spark, folder):
    return match.dominant(inflections_of(spark, folder))


def _windows(mode):
    def run(spark, folder):
        rows = cooc.windows(docs_of(spark, folder), 2, mode=mode)
        return rows.select("doc_id", F.col("win_ix").cast("bigint").alias("win_ix"), text.name(F.col("words")).alias("words"))

    return run


def cooc_pairs(spark, folder):
    return cooc.window_pairs(hits_of(spark, folder)).select("doc_id", F.col("win_ix").cast("bigint").alias("win_ix"), "src", "dst")


def cooc_counts(spark, folder):
    return counts_of(spark, folder)


def cooc_histogram(spark, folder):
    return cooc.histogram(counts_of(spark, folder))


def cooc_stats(spark, folder):
    return cooc.statistics(counts_of(spark, folder)).select("max_cnt", "min_cnt", F.round("avg_cnt", 6).alias("avg_cnt"))


def cooc_cutoff(spark, folder):
    return cooc.kept(storage.cut(counts_of(spark, folder)), CUT_KEEP)


def pair_sentences(spark, folder):
    hits = storage.cut(match.in_texts(docs_of(spark, folder), words_of(spark, folder).drop("df"), "lower", shown=True))
    return cooc.text_pairs(cooc.distinct_texts(hits), storage.cut(cooc.kept(storage.cut(cooc.counts(cooc.window_pairs(hits))), CUT_KEEP)))


def included_excluded(spark, folder):
    counted = storage.cut(counts_of(spark, folder))
    return cooc.membership(counted.select(F.col("src").alias("term")), cooc.kept(counted, CUT_KEEP))


def glossary_cooc(spark, folder):
    rows = readers.glossary(spark.createDataFrame([(GLOSSARY,)], "text string"))
    return cooc.counts(N.parse_glossary(rows, how="lower").pairs)


def articles_links_vocab(spark, folder):
    pages = storage.table(spark, folder, "pages")
    return vocab.from_links(readers.page_links(pages), readers.page_text(pages), how="lower").select("term").distinct()


def stem_counts(spark, folder):
    rows = cooc.sentence_rows(docs_of(spark, folder))
    words = rows.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    from termweave.functions.stem import lemmas

    return words.select(F.element_at(lemmas(F.array("w"), "stem"), 1).alias("stem"), "c").groupBy("stem").agg(F.sum("c").alias("cnt"))


def stem_samples(spark, folder):
    """Published word forms of the stemming algorithm, through the distributed form."""
    words = spark.createDataFrame([(w,) for w in STEMS], "word string")
    from termweave.functions.stem import lemmas

    return words.select("word", F.element_at(lemmas(F.array("word"), "stem"), 1).alias("stem"))


def lemma_counts(spark, folder):
    return match.lemma_counts(inflection_counts(spark, folder))


def merged_inflections(spark, folder):
    return compared_of(spark, folder).inflections.select("term", "surface", "cnt")


def decoded_names(spark, folder):
    """Each surface form in capitals and as it is, brought back to its term."""
    counted = inflections_of(spark, folder)
    names = counted.select("surface").distinct()
    every = names.union(names.select(F.upper("surface"))).distinct().withColumnRenamed("surface", "name")
    return match.decode(every, counted).select("name", "term")


def built_glossary(spark, folder):
    return build.build(spark, GLOSSARY, "gc", keep=100, how="lower").display.links()


def built_articles(spark, folder):
    """Counts of pairs over all pages as articles, whose links are the vocabulary."""
    pages = storage.table(spark, folder, "pages")
    title = F.col("page_id").cast("string").alias("title")
    fetch = build.table_fetcher(readers.page_text(pages).select(title, F.lit(None).cast("string").alias("section"), F.lit(0).alias("ord"), "text"), readers.page_links(pages).select(title, "link"))
    listing = pages.select(F.col("page_id").alias("ord"), F.col("page_id").cast("string").alias("line"))
    return cooc.counts(build.parse_input(spark, listing, "wal", fetch=fetch, how="lower").pairs)


def graph_edges(spark, folder):
    return graph_of(spark, folder).links()


def degree(spark, folder):
    return graph_of(spark, folder).degrees()


def top_nodes(g: graph.Graph, k: int) -> DataFrame:
    """The k nodes of the greatest degree, a bounded report."""
    return g.degrees().orderBy(F.desc("degree"), "term").limit(k).select("term")


def seed_of(g: graph.Graph) -> str:
    """The node that queries start from: that of a fixed place by degree."""
    return top_nodes(g, SEED_RANK).orderBy(F.asc("term")).collect()[0]["term"]


def sub_graph(spark, folder):
    g = graph_of(spark, folder)
    return graph.sub_graph(g, top_nodes(g, 10)).links()


def adjacency_long(spark, folder):
    return graph.adjacency(graph_of(spark, folder)).select("row", "col", F.col("value").cast("bigint").alias("value"))


def clustering_coefficient(spark, folder):
    return graph.clustering(graph_of(spark, folder)).select("term", F.round("cc", 6).alias("cc"))


def clustering_coefficient_directed(spark, folder):
    links = graph_of(spark, folder).links()
    return graph.clustering(graph.build(links, "directed")).select("term", F.round("cc", 6).alias("cc"))


def neighbourhood_1(spark, folder):
    g = graph_of(spark, folder)
    return graph.neighbourhood(g, seed_of(g), 1, True).select("term", F.col("dist").cast("bigint").alias("dist"))


def neighbourhood_expanded(spark, folder):
    g = graph_of(spark, folder)
    return graph.neighbourhood(g, seed_of(g), 1, True, (2, 0.5)).select("term", F.col("dist").cast("bigint").alias("dist"))


def distances(spark, folder):
    return graph.all_distances(graph_of(spark, folder)).select("src", "dst", F.col("dist").cast("double").alias("dist"))


def eccentricity(spark, folder):
    return graph.eccentricity(graph.distances(graph_of(spark, folder))).select("term", F.col("ecc").cast("bigint").alias("ecc"))


def diameter(spark, folder):
    return graph.diameter(graph.distances(graph_of(spark, folder))).select(F.col("diameter").cast("bigint").alias("diameter"))


def pagerank_k(spark, folder):
    return P.pagerank(graph_of(spark, folder), epsilon=0, epochs=ROUNDS).select("term", F.round("rank", 6).alias("rank"))


def biased_pagerank_k(spark, folder):
    g = graph_of(spark, folder)
    return P.pagerank(g, {seed_of(g): 0.5}, epsilon=0, epochs=ROUNDS).select("term", F.round("rank", 6).alias("rank"))


def inverse_pagerank_k(spark, folder):
    return P.metric(graph_of(spark, folder), "IPR", epsilon=0, epochs=ROUNDS).select("term", F.round("value", 6).alias("value"))


def scaled_cc(spark, folder):
    return P.metric(graph_of(spark, folder), "CC").select("term", F.round("value", 6).alias("value"))


def inverse_cc(spark, folder):
    return P.metric(graph_of(spark, folder), "ICC").select("term", F.round("value", 6).alias("value"))


def fitted_cc(spark, folder):
    return R.fit(P.metric(graph_of(spark, folder), "CC"), "value", 0.5).select("term", F.round("value", 6).alias("value"))


def other_of(g: graph.Graph) -> str:
    """The last by name of the nodes that :func:`seed_of` takes the first of."""
    return top_nodes(g, SEED_RANK).orderBy(F.desc("term")).first()["term"]


def biased_metric(spark, folder):
    g = graph_of(spark, folder)
    return P.metric(g, "BPR", [seed_of(g), other_of(g)], epsilon=0, epochs=ROUNDS).select("term", F.round("value", 6).alias("value"))


def inverse_biased_metric(spark, folder):
    g = graph_of(spark, folder)
    return P.metric(g, "IBPR", seed_of(g), epsilon=0, epochs=ROUNDS).select("term", F.round("value", 6).alias("value"))


def all_seed_pagerank(spark, folder):
    return P.all_seeds(graph_of(spark, folder), epsilon=0, epochs=ROUNDS).select("seed", "term", F.round("rank", 6).alias("rank"))


def log_size(spark, folder):
    return graph.log_size(graph_of(spark, folder)).select(F.round("log_size", 6).alias("log_size"))


def network_of(spark: SparkSession, folder: str, docs: DataFrame | None = None) -> N.Network:
    words = words_of(spark, folder).drop("df")
    return N.build(N.parse_content(docs_of(spark, folder) if docs is None else docs, words, how="lower"), CUT_KEEP)


def session_of(spark: SparkSession, folder: str) -> Session:
    """A session with the clustering metric, focused on all, one amplified and one dampened term."""
    net = network_of(spark, folder)
    tops = [r["term"] for r in top_nodes(net.display, 3).orderBy("term").collect()]
    s = Session.start(net).with_metric("CC").with_influence("positive", "linear").with_influence("negative", "exponential").focus()
    return s.amplify(tops[0]).dampen(tops[-1])


def session_focus(spark, folder):
    s = Session.start(network_of(spark, folder)).with_metric("CC").focus()
    return s.ranks.select("grp", "term", F.round("rank", 6).alias("rank"))


def masked_rank(spark, folder):
    s = session_of(spark, folder)
    return s.masked(s.selection()).select("grp", "term", F.round("rank", 6).alias("rank"))


def top_k_per_group(spark, folder):
    s = session_of(spark, folder)
    return s.top(s.masked(s.selection()).withColumn("rank", F.round("rank", 9))).select("grp", "term", F.col("place").cast("bigint").alias("place"))


def display_nodes(spark, folder):
    s = session_of(spark, folder)
    return s.display().nodes.select("name", F.round(F.try_element_at("ranks", F.lit("left")), 6).alias("rank"), "alpha", F.array_join("groups", ",").alias("groups"))


def session_search(spark, folder):
    s = session_of(spark, folder)
    shown = s.search(seed_of(s.network.display))[1]
    return shown.nodes.select("name", F.round(F.try_element_at("ranks", F.lit("left")), 6).alias("rank"), "alpha")


def session_highlight(spark, folder):
    """One node highlighted, one of greatest degree ignored."""
    s = session_of(spark, folder)
    middle = top_nodes(s.network.display, SEED_RANK).orderBy("term").collect()[1]["term"]
    first = s.network.display.nodes.agg(F.min("term")).first()[0]
    return s.highlight(first).ignore(middle).display().nodes.select("name", "alpha")


def session_totals(spark, folder):
    return session_of(spark, folder).display().totals.select(F.md5("summary").alias("summary"), "size", "selection")


def session_chart(spark, folder):
    return session_of(spark, folder).chart().select("name", F.round("rank", 6).alias("rank"))


def session_radii(spark, folder):
    return session_of(spark, folder).radii(1_000.0).select("name", F.round("radius", 6).alias("radius"))


def display_links(spark, folder):
    return session_of(spark, folder).display().links.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "alpha", F.round("distance", 6).alias("distance"), "stroke")


def link_distance(spark, folder):
    s = Session.start(network_of(spark, folder))
    counted = storage.cut(s.link_counts())
    return counted.join(F.broadcast(counted.agg(F.max("cnt").alias("most")))).select("src", "dst", "cnt", F.round(F.col("cnt") / F.col("most") * 280.0, 6).alias("distance"))


def best_link_summary(spark, folder):
    s = session_of(spark, folder)
    selection = s.selection()
    masked = storage.cut(s.masked(selection))
    tops = s.top(masked.withColumn("rank", F.round("rank", 9))).select("term")
    return s.best_link(graph.sub_graph(s.network.display, tops).links(), masked).select("src", "dst", F.round("score", 6).alias("score"), F.md5("summary").alias("summary"))


def compared_of(spark: SparkSession, folder: str) -> N.Network:
    """English against all other documents, each its own network on one vocabulary."""
    docs = storage.spread(storage.table(spark, folder, "documents").select("doc_id", "text", "lang"))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    words = words_of(spark, folder).drop("df")
    sides = [N.build(N.parse_content(docs.where(c).select("doc_id", "text"), words, how="lower"), CUT_KEEP) for c in (english, ~english)]
    return N.compare(*sides)


def compare_union(spark, folder):
    return compared_of(spark, folder).display.links()


def compare_groups(spark, folder):
    return compared_of(spark, folder).node_groups().select("term", F.array_join("groups", ",").alias("groups"))


def compare_properties(spark, folder):
    return compared_of(spark, folder).facts.select(*(F.col(c).cast("bigint").alias(c) for c in ("min_cnt", "max_cnt", "cutoff", "total_terms")), F.round("avg_cnt", 6).alias("avg_cnt"))


def basket_pairs(spark: SparkSession, folder: str) -> DataFrame:
    lines = storage.table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    parts = storage.table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("term"))
    orders = storage.table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return cooc.counts(cooc.pairs(lines.join(parts, "l_partkey").join(orders, "l_orderkey", "left_semi"), ("l_orderkey",)))


def basket_cooc_part_type(spark, folder):
    return basket_pairs(spark, folder)


def basket_pagerank(spark, folder):
    g = graph.build(storage.cut(cooc.kept(storage.cut(basket_pairs(spark, folder)), CUT_KEEP))).cut()
    return P.pagerank(g, epsilon=0, epochs=ROUNDS).select("term", F.round("rank", 6).alias("rank"))


def conversation_cooc(spark, folder):
    turns = storage.spread(storage.table(spark, folder, "conversations")).select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("win_ix"), text.words(F.col("text")).alias("words"))
    words = words_of(spark, folder).drop("df")
    return cooc.counts(cooc.window_pairs(match.in_windows(turns, words, "lower")))


QUERIES = {
    "sentence_split": sentence_split, "sentence_stats": sentence_stats, "token_frequency": token_frequency, "vocab_top_terms": vocab_top_terms,
    "term_matches": term_matches, "inflection_counts": inflection_counts, "dominant_inflection": dominant_inflection,
    "windows_ref_w2": _windows("reference"), "windows_sliding_w2": _windows("sliding"), "cooc_pairs": cooc_pairs, "cooc_counts": cooc_counts,
    "cooc_histogram": cooc_histogram, "cooc_stats": cooc_stats, "cooc_cutoff": cooc_cutoff, "pair_sentences": pair_sentences,
    "included_excluded": included_excluded, "glossary_cooc": glossary_cooc, "articles_links_vocab": articles_links_vocab, "stem_counts": stem_counts,
    "graph_edges": graph_edges, "degree": degree, "sub_graph": sub_graph, "adjacency_long": adjacency_long, "clustering_coefficient": clustering_coefficient,
    "clustering_coefficient_directed": clustering_coefficient_directed, "neighbourhood_1": neighbourhood_1, "neighbourhood_expanded": neighbourhood_expanded,
    "distances": distances, "eccentricity": eccentricity, "diameter": diameter, "pagerank_k": pagerank_k, "biased_pagerank_k": biased_pagerank_k,
    "inverse_pagerank_k": inverse_pagerank_k, "scaled_cc": scaled_cc, "inverse_cc": inverse_cc, "fitted_cc": fitted_cc, "session_focus": session_focus,
    "masked_rank": masked_rank, "top_k_per_group": top_k_per_group, "display_nodes": display_nodes, "display_links": display_links,
    "link_distance": link_distance, "best_link_summary": best_link_summary, "compare_union": compare_union, "compare_groups": compare_groups,
    "compare_properties": compare_properties, "basket_cooc_part_type": basket_cooc_part_type, "basket_pagerank": basket_pagerank, "conversation_cooc": conversation_cooc,
    "stem_samples": stem_samples, "lemma_counts": lemma_counts, "merged_inflections": merged_inflections, "decoded_names": decoded_names,
    "built_glossary": built_glossary, "built_articles": built_articles, "biased_metric": biased_metric, "inverse_biased_metric": inverse_biased_metric,
    "all_seed_pagerank": all_seed_pagerank, "log_size": log_size, "session_search": session_search, "session_highlight": session_highlight,
    "session_totals": session_totals, "session_chart": session_chart, "session_radii": session_radii,
}
