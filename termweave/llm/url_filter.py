"""URL filters: pattern rules indexed by their rarest literal token.

Only DataFrame functions run here. A rule is a regular expression over the
canonical ``host + path`` string plus the literal tokens every match must contain.
The index maps one token of each rule - the one that the fewest URLs of the table
contain - to the rule. A URL's tokens fetch candidate rules from the index, and
only these run their expressions, so the work per URL does not grow with the list. A
short list is held in the plan; a long one is a table that tokens are joined with.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm import common

#: (host, path) rules of the deployed list; the longest that fits decides.
SITE_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: (name, expression, tokens that each match contains): block where no site rule fits.
PATTERN_RULES = (
    ("*pills*", r"^(?:[^/]*[.-])?pills(?:[.-]|/|$)", ("pills",)),
    ("*bets*", r"^(?:[^/]*[.-])?bets(?:[.-]|/|$)", ("bets",)),
    ("*spam-farm*", r"^(?:[^/]*[.-])?spam-farm(?:[.-]|/|$)", ("spam", "farm")),
    ("*ads-track*", r"^(?:[^/]*[.-])?ads-track(?:[.-]|/|$)", ("ads", "track")),
    ("*casino*", r"^(?:[^/]*[.-])?casino(?:[.-]|/|$)", ("casino",)),
)
#: A list of up to so many rules is held in the plan; beyond, it is a table.
MOST_RULES = 20_000
TOKEN = "[A-Za-z0-9]+"
RULE_TYPE = T.StructType(
    [
        T.StructField("rank", T.IntegerType()),
        T.StructField("rule", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("pattern", T.StringType()),
    ]
)


@dataclass(frozen=True)
class UrlRule:
    """One rule. ``rank`` orders rules that fit the same URL; the highest wins."""

    rule: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    site: bool


def site_rule(rule: str, verdict: str) -> UrlRule:
    """Compile ``host/path-prefix``: it fits the host and all its subdomains.

    The last token of the path is left out of the index where the prefix may end
    in its middle.
    """
    whole = [m for m in re.finditer(TOKEN, rule) if m.end() < len(rule)]
    if not whole:
        raise ValueError(f"the rule {rule!r} has no whole literal token")
    return UrlRule(rule, verdict, rf"^(?:[^/]*\.)?{re.escape(rule)}", tuple(m[0] for m in whole), 1_000 + len(rule), True)


def pattern_rule(name: str, pattern: str, tokens: tuple[str, ...], verdict: str = "block") -> UrlRule:
    """Compile an expression over ``host + path``; any site rule outranks it."""
    if not tokens:
        raise ValueError(f"the rule {name!r} needs a literal token")
    return UrlRule(name, verdict, pattern, tokens, min(len(name), 999), False)


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rarest_tokens(parts: DataFrame, rules: list[UrlRule]) -> dict[str, list[UrlRule]]:
    """Index each rule by whichever of its tokens the fewest URLs of the table contain.

    One pass counts, over all URLs, only tokens that rules use: the result has at
    most as many rows as the rule list has tokens. Equal counts: the longer token,
    then the smaller one.
    """
    used = sorted({t for r in rules for t in r.tokens})
    wanted = F.array(*(F.lit(t) for t in used))
    seen = parts.select(F.explode(F.array_intersect("tokens", wanted)).alias("token")).groupBy("token").count()
    counts = {row["token"]: row["count"] for row in seen.collect()}
    index: dict[str, list[UrlRule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(r)
    return index


def url_filter(pages: DataFrame, rules: list[UrlRule], url: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row's URL; all columns stay, the result columns replace like-named ones.

    Adds ``host``, ``path``, ``rule`` (the site rule that decided, else null),
    ``method_rule`` (the rule of any kind that decided, else null) and ``verdict``.
    A null URL or one without ``://`` has empty host and path and gets ``default``.
    Rows are neither dropped nor merged, so repeated rows stay repeated; an empty
    table gives an empty one. Rules of one rank: the greater rule string wins.
    """
    parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    judged = by_join(parts, rules, url) if len(rules) > MOST_RULES else in_plan(parts, rules)
    sites = any(r.site for r in rules)
    return judged.withColumns(
        {
            "rule": F.when(F.col("_best.rank") >= 1_000, F.col("_best.rule")) if sites else F.lit(None).cast("string"),
            "method_rule": F.col("_best.rule"),
            "verdict": F.coalesce(F.col("_best.verdict"), F.lit(default)),
        }
    ).drop("_best")


def tokens_of(subject: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(subject, F.lit(f"({TOKEN})"), 1))


def best_of(fetched: Column, subject: Column) -> Column:
    """Of the fetched rules that fit, the one of the highest rank."""
    return F.array_max(F.filter(fetched, lambda r: F.rlike(subject, r["pattern"])))


def in_plan(parts: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """Add the deciding rule as ``_best``, from an index held in the plan."""
    subject, none = F.concat("host", "path"), F.array().cast(T.ArrayType(RULE_TYPE))
    if not rules:
        return parts.withColumn("_best", best_of(none, subject))
    pairs = []
    for token, own in sorted(rarest_tokens(parts.select(tokens_of(subject).alias("tokens")), rules).items()):
        pairs.append(F.lit(token))
        pairs.append(F.array(*(F.struct(F.lit(r.rank).alias("rank"), F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern")) for r in own)))
    held = F.create_map(*pairs)
    fetched = F.flatten(F.transform(tokens_of(subject), lambda t: F.coalesce(F.try_element_at(held, t), none)))
    return parts.withColumn("_best", best_of(fetched, subject))


def by_join(parts: DataFrame, rules: list[UrlRule], url: str) -> DataFrame:
    """The same from an index that is a table, for lists of any length.

    Each different URL is judged once. Tokens and URLs that very many rows have are
    joined where they are.
    """
    spark = parts.sparkSession
    urls = common.materialize(parts.where(F.col(url).isNotNull()).groupBy(F.col(url).alias("_url")).agg(F.first("host").alias("host"), F.first("path").alias("path"), F.count("*").alias("_rows")), "urls")
    subject = F.concat("host", "path")
    each = urls.select("_url", subject.alias("subject"), F.explode(tokens_of(subject)).alias("token"))
    listed = spark.createDataFrame([(k, r.rank, r.rule, r.verdict, r.pattern, list(r.tokens)) for k, r in enumerate(rules)], "id int, rank int, rule string, verdict string, pattern string, tokens array<string>")
    counts = each.groupBy("token").agg(F.count("*").alias("n"))
    known = listed.select("id", F.explode("tokens").alias("token")).join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = known.groupBy("id").agg(F.min(F.struct("n", (-F.char_length("token")).alias("short"), "token")).alias("by"))
    index = listed.join(rarest, "id").groupBy(F.col("by.token").alias("token")).agg(F.first("by.n").alias("n"), F.collect_list(F.struct("rank", "rule", "verdict", "pattern")).alias("fetched")).where("n > 0")
    index = common.materialize(index, "index")
    met = common.join_hot(each, index, "token", "n", index.agg(F.sum("n")).first()[0] or 0)
    found = met.withColumn("_best", best_of(F.col("fetched"), F.col("subject"))).groupBy("_url").agg(F.max("_best").alias("_best"))
    judged = common.materialize(urls.join(found, "_url", "left").select("_url", "_rows", "_best"), "judged")
    rows = common.join_hot(parts.withColumn("_url", F.col(url)), judged, "_url", "_rows", judged.agg(F.sum("_rows")).first()[0] or 0)
    blank = parts.where(F.col(url).isNull()).withColumn("_best", F.lit(None).cast(RULE_TYPE))
    return rows.select(*parts.columns, "_best").unionByName(blank)


def deployed_rules() -> list[UrlRule]:
    """The rules that op1 applies."""
    return [site_rule(*r) for r in SITE_RULES] + [pattern_rule(*r) for r in PATTERN_RULES]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge the URL of every page."""
    pages = common.read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, deployed_rules()).select("page_id", "host", "path", "rule", "verdict", "method_rule")


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
  CASE
    WHEN regexp_matches(host, '(^|[.-])spam-farm([.-]|$)') THEN '*spam-farm*'
    WHEN regexp_matches(host, '(^|[.-])ads-track([.-]|$)') THEN '*ads-track*'
    WHEN regexp_matches(host, '(^|[.-])casino([.-]|$)') THEN '*casino*'
    WHEN regexp_matches(host, '(^|[.-])pills([.-]|$)') THEN '*pills*'
    WHEN regexp_matches(host, '(^|[.-])bets([.-]|$)') THEN '*bets*' END AS pattern
  FROM parts)
SELECT page_id, host, path, rule, coalesce(rule, pattern) AS method_rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
