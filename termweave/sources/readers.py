"""Sources: text lines, CSV cells, glossary markup, article lists and article tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions import text

#: Fixed section titles that are left out of an article.
SECTIONS_LEFT_OUT = ["Notes", "References", "Further reading", "External links", "See also"]
#: Fixed names and aliases of input formats.
FORMATS = {"gc": "glossary", "glossary_csv": "glossary", "wal": "articles", "wikipedia_articles_list": "articles", "tct": "terms", "terms_content_text": "terms"}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files without white space at their ends: (line)."""
    return spark.read.text(path).select(text.strip(F.col("value")).alias("line"))


def csv_cells(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of CSV files, quoted cells over several lines included, cells stripped."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.csv(path, schema=schema, multiLine=True, quote='"', escape='"')
    return rows.select(*(text.strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns))


def glossary(markup: DataFrame, column: str = "text") -> DataFrame:
    """Rows (ord, head, definition) of ``=:head:= definition`` markup.

    A head is on one line; a definition runs to the next head; a last head without a
    definition is dropped. A text that begins with no head is a ValueError.
    """
    head = r"(?s)=:([^\n]*?):=(.*?)(?==:[^\n]*:=|\z)"
    bad = markup.where(F.col(column).isNotNull() & (F.length(F.col(column)) > 0) & ~F.rlike(F.col(column), F.lit("=:[^\n]*?:="))).limit(1).collect()
    if bad:
        raise ValueError(f"cannot parse: {bad[0][column][:80]}")
    found = F.arrays_zip(F.regexp_extract_all(F.col(column), F.lit(head), 1).alias("head"), F.regexp_extract_all(F.col(column), F.lit(head), 2).alias("definition"))
    rows = markup.select(F.posexplode(found).alias("ord", "g"), F.size(found).alias("n"))
    cleaned = rows.select("ord", "n", text.strip(F.col("g.head")).alias("head"), text.strip(F.col("g.definition")).alias("definition"), (F.length("g.definition") == 0).alias("bare"))
    return cleaned.where(~(F.col("bare") & (F.col("ord") == F.col("n") - 1))).select("ord", "head", "definition")


def article_titles(listing: DataFrame, column: str = "line") -> DataFrame:
    """(page_id, title, sections, ord) of titles separated by "."; ``Title#A#B`` selects sections.

    ``ord`` is the place among the titles of a line and, if the listing has an ``ord``,
    of that line before. A repeated entry counts once, at its first place.
    """
    line = F.col("ord").cast("bigint") if "ord" in listing.columns else F.lit(0).cast("bigint")
    pages = listing.select(line.alias("line_ord"), F.posexplode(F.transform(F.split(F.col(column), r"\."), text.strip)).alias("at", "page_id")).where("page_id <> ''")
    first = pages.groupBy("page_id").agg(F.min(F.col("line_ord") * (1 << 20) + F.col("at")).alias("ord"))
    parts = F.split("page_id", "#")
    return first.select("page_id", F.element_at(parts, 1).alias("title"), F.slice(parts, F.lit(2), F.size(parts)).alias("sections"), "ord")


def articles(titles: DataFrame, sections: DataFrame) -> DataFrame:
    """Content of each listed article: (page_id, text), from (title, section, ord, text) rows.

    Without chosen sections: the summary (section null) and all sections but those that
    are left out; else only the chosen ones, in their order. A title without rows is a
    ValueError. Single line breaks become paragraph breaks.
    """
    missing = titles.join(sections.select("title").distinct(), "title", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"missing article {missing[0]['title']!r}")
    met = titles.select("page_id", "title", "sections").join(sections, "title")
    whole = (F.size("sections") == 0) & (F.col("section").isNull() | ~F.col("section").isin(*SECTIONS_LEFT_OUT))
    chosen = (F.size("sections") > 0) & F.array_contains("sections", F.col("section")) & ~F.col("section").isin(*SECTIONS_LEFT_OUT)
    place = F.when(F.size("sections") > 0, F.array_position("sections", F.col("section")).cast("int")).otherwise(F.col("ord").cast("int"))
    rows = met.where(F.coalesce(whole, F.lit(False)) | F.coalesce(chosen, F.lit(False))).select("page_id", place.alias("place"), text.strip(F.col("text")).alias("text")).where("text <> ''")
    joined = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("t"))
    return joined.select("page_id", F.regexp_replace(F.array_join(F.transform("t", lambda x: x["text"]), " "), "\n", "\n\n").alias("text"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, link) of the anchors in HTML pages."""
    found = F.regexp_extract_all(F.col("html"), F.lit(r"(?s)<a [^>]*>([^<]*)</a>"), 1)
    return pages.select("page_id", F.explode(F.array_distinct(found)).alias("link")).where("link <> ''")


def page_text(pages: DataFrame) -> DataFrame:
    """(page_id, text) of the articles in HTML pages: tags out, character references kept."""
    article = F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1)
    return pages.select("page_id", F.regexp_replace(F.regexp_replace(article, r"(?s)<h1>.*?</h1>", ""), r"<[^>]*>", " ").alias("text"))


def check_form(data: dict[str, list[str]]) -> dict[str, str]:
    """Format, content and terms of a submitted form; what is missing or blank is a ValueError."""
    needed = ["format", "content"] + (["terms"] if (data.get("format") or [""])[0] == "content-terms" else [])
    out = {}
    for name in needed:
        value = (data.get(name) or [""])[0]
        if not value.strip():
            raise ValueError(f"the form has no {name}")
        out[name] = value.strip()
    return out


def format_of(name: str | tuple[str, ...]) -> str:
    """The reader that a format name, alias or pair of both stands for."""
    for each in (name,) if isinstance(name, str) else name:
        if each in FORMATS:
            return FORMATS[each]
    raise ValueError(f"no reader for the format {name!r}")


def focus_terms(value: str) -> list[str]:
    """Terms of a comma list, stripped."""
    return [t for t in (re.sub(r"^\s+|\s+$", "", x) for x in value.split(",")) if t]
