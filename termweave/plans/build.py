"""The entry point: from a submitted input of any format to a network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.operators import vocab
from termweave.plans import network as N
from termweave.sources import readers

#: Takes (title) rows; gives sections (title, section, ord, text) and links (title, link).
Fetcher = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
SEPARATORS = ("sentence", "paragraph")
SECTION_COLUMNS, LINK_COLUMNS = ["title", "section", "ord", "text"], ["title", "link"]


def table_fetcher(sections: DataFrame, links: DataFrame) -> Fetcher:
    """A fetcher of articles that lie in two tables."""
    return lambda titles: (sections.join(titles, "title", "left_semi"), links.join(titles, "title", "left_semi"))


def cached(fetch: Fetcher, folder: str) -> Fetcher:
    """A fetcher that asks ``fetch`` only for titles that the shared folder does not hold.

    Each call that fetches adds a batch of files, named after its titles, so a call that
    is repeated after a failure writes the same batch again. Titles that have been asked
    for are kept with the batch, so that one without an article is not asked for twice.
    """

    def run(titles: DataFrame) -> tuple[DataFrame, DataFrame]:
        spark = titles.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        there = lambda: jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/titles"))
        asked = titles.select("title").distinct()
        missing = asked.join(spark.read.parquet(f"{folder}/titles").select("title"), "title", "left_anti") if there() else asked
        if not missing.isEmpty():
            sums = missing.agg(F.count("*"), F.bit_xor(F.xxhash64("title"))).first()
            batch = "batch=" + hashlib.sha256(str(tuple(sums)).encode()).hexdigest()[:16]
            sections, links = fetch(missing)
            sections.select(*SECTION_COLUMNS).write.mode("overwrite").parquet(f"{folder}/sections/{batch}")
            links.select(*LINK_COLUMNS).write.mode("overwrite").parquet(f"{folder}/links/{batch}")
            missing.write.mode("overwrite").parquet(f"{folder}/titles/{batch}")
        wanted = lambda name, columns: spark.read.parquet(f"{folder}/{name}").select(*columns).join(asked, "title", "left_semi")
        return wanted("sections", SECTION_COLUMNS), wanted("links", LINK_COLUMNS)

    return run


def parse_articles(listing: DataFrame, fetch: Fetcher, width: int = 1, paragraphs: bool = False, how: str = "stem", gate: bool = False, mode: str = "reference") -> N.Parsed:
    """Pairs of the terms of listed articles: (line) rows of titles, fetched by ``fetch``.

    The vocabulary is made of the links that occur in their article's text. An article
    that is not there is a ValueError.
    """
    titles = readers.article_titles(listing)
    sections, links = fetch(titles.select("title").distinct())
    texts = readers.articles(titles, sections)
    linked = titles.select("page_id", "title").join(links, "title").select("page_id", "link")
    words = vocab.check(vocab.from_links(linked, texts, how))
    docs = texts.join(titles.select("page_id", F.col("ord").alias("doc_id")), "page_id").select("doc_id", "text")
    return N.parse_content(docs, words, width, paragraphs, how, gate, mode)


def parse_input(spark: SparkSession, content: str | DataFrame, kind: str | tuple[str, ...], terms: str | DataFrame | None = None, window: int = 1, separator: str = "sentence", fetch: Fetcher | None = None, how: str = "stem", gate: bool = False, mode: str = "reference") -> N.Parsed:
    """Parse one input by its format: glossary markup, an article list, or terms and content.

    Strings are what a form holds; tables have ``text`` rows (content with doc_id and
    text, an article list with ``line``).
    """
    if window < 1 or separator not in SEPARATORS:
        raise ValueError(f"the window must be at least 1 and the separator one of {SEPARATORS}")
    paragraphs, reader = separator == "paragraph", readers.format_of(kind)
    if reader == "glossary":
        markup = spark.createDataFrame([(content,)], "text string") if isinstance(content, str) else content
        return N.parse_glossary(readers.glossary(markup), how, gate)
    if reader == "articles":
        if fetch is None:
            raise ValueError("an article list needs a fetcher")
        lines = spark.createDataFrame(list(enumerate(content.split("\n"))), "ord bigint, line string") if isinstance(content, str) else content
        return parse_articles(lines, fetch, window, paragraphs, how, gate, mode)
    if terms is None:
        raise ValueError("content needs a list of terms")
    listed = spark.createDataFrame([(terms,)], "text string") if isinstance(terms, str) else terms
    docs = spark.createDataFrame([(0, content)], "doc_id bigint, text string") if isinstance(content, str) else content
    return N.parse_content(docs, vocab.from_terms(listed, how=how), window, paragraphs, how, gate, mode)


def build(spark: SparkSession, content: str | DataFrame, kind: str | tuple[str, ...], window: int = 1, separator: str = "sentence", keep: float = 80, **more) -> N.Network:
    """The network of an input; ``more`` are the other parameters of :func:`parse_input`."""
    if not 0 <= keep <= 100:
        raise ValueError("keep must be from 0 to 100")
    return N.build(parse_input(spark, content, kind, window=window, separator=separator, **more), keep)


def build_form(spark: SparkSession, form: dict[str, list[str]], **more) -> N.Network:
    """The network of a submitted form, which is checked first."""
    data = readers.check_form(form)
    names = {"content-terms": "tct"}
    kind = names.get(data["format"], data["format"])
    return build(spark, data["content"], kind, terms=data.get("terms"), **more)
