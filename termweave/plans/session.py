"""Sessions on a network: focus, influence, search and display, each a pure step."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave import storage
from termweave.functions import ranks as R
from termweave.operators import graph as G
from termweave.operators import match
from termweave.operators import pagerank as P
from termweave.plans.network import Network, compare

#: Fixed values of the display: terms shown per group, radius in pixels, opacities, bars of the chart.
TOP, RADIUS, DARK, LIGHT, BARS = 10, 280.0, 1.0, 0.1, 35
MEDIUM = (DARK + LIGHT) / 2.0
#: Least and greatest radius of a node.
LEAST_RADIUS, MOST_RADIUS = 5.0, 50.0
SEARCH = (1, (2, 0.5))


@dataclass(frozen=True)
class Display:
    """What is shown: nodes, links and one row of totals."""

    nodes: DataFrame  # name, ranks (map), alpha, groups
    links: DataFrame  # source, target, alpha, distance, stroke
    totals: DataFrame  # summary, size, selection


@dataclass(frozen=True)
class Session:
    """State of one user's view; every command returns a new session."""

    network: Network
    ranks: DataFrame  # grp, term, rank
    metric: str = "BPR"
    positive: str = "none"
    negative: str = "none"
    focused: bool = False
    focus_points: frozenset[str] = frozenset()
    amplified: frozenset[str] = frozenset()
    dampened: frozenset[str] = frozenset()
    ignored: frozenset[str] = frozenset()
    highlighted: frozenset[str] = frozenset()
    previous: str | None = None

    @staticmethod
    def start(network: Network) -> Session:
        return Session(network, uniform(network))

    def reset(self) -> Session:
        """Uniform ranks and no points; metric, influences and previous search stay."""
        none: frozenset[str] = frozenset()
        return replace(self, ranks=uniform(self.network), focused=False, focus_points=none, amplified=none, dampened=none, ignored=none, highlighted=none)

    def term(self, name: str) -> str:
        """The node that a display name stands for; else KeyError."""
        names = self.network.display.nodes.sparkSession.createDataFrame([(name,)], "name string")
        row = match.decode(names, self.network.inflections).join(self.network.display.nodes, "term", "left_semi").first()
        if row is None:
            raise KeyError(name)
        return row["term"]

    def with_metric(self, name: str) -> Session:
        if name not in P.UNBIASED + P.BIASED:
            raise ValueError(f"unknown metric {name!r}")
        return replace(self, metric=name)

    def with_influence(self, polarity: str, mode: str) -> Session:
        if polarity not in ("positive", "negative") or mode not in R.INFLUENCES:
            raise ValueError(f"unknown influence {polarity!r} {mode!r}")
        return replace(self, **{polarity: mode})

    def amplify(self, name: str, remove: bool = False) -> Session:
        t = {self.term(name)}
        return replace(self, amplified=self.amplified - t) if remove else replace(self, amplified=self.amplified | t, dampened=self.dampened - t)

    def dampen(self, name: str, remove: bool = False) -> Session:
        t = {self.term(name)}
        return replace(self, dampened=self.dampened - t) if remove else replace(self, dampened=self.dampened | t, amplified=self.amplified - t)

    def ignore(self, name: str, mode: str = "add") -> Session:
        if mode not in ("add", "remove"):
            raise ValueError(f"unknown mode {mode!r}")
        t = {self.term(name)}
        return replace(self, ignored=self.ignored | t if mode == "add" else self.ignored - t)

    def highlight(self, name: str, mode: str = "add") -> Session:
        if mode not in ("add", "remove", "toggle"):
            raise ValueError(f"unknown mode {mode!r}")
        t = {self.term(name)}
        now = self.highlighted ^ t if mode == "toggle" else self.highlighted | t if mode == "add" else self.highlighted - t
        return replace(self, highlighted=now)

    def focus(self, names: str | list[str] | None = None, bias: float | None = None) -> Session:
        """Add the metric to the ranks of the groups that have the term, then normalise all.

        Each group is scaled to sum 1, then brought to the smallest of the groups'
        maxima. Without a term the metric must be an unbiased one.
        """
        if names is None and self.metric not in P.UNBIASED:
            raise ValueError(f"{self.metric} needs a term")
        seeds = None if names is None else self.term(names) if isinstance(names, str) else [self.term(n) for n in names]
        added = self.ranks
        for grp, g in self.network.groups.items():
            if isinstance(seeds, str) and g.nodes.where(F.col("term") == seeds).isEmpty():
                continue
            values = self.network.metric(self.metric, grp, seeds if self.metric in P.BIASED else None, bias).select(F.lit(grp).alias("grp"), "term", "value")
            added = added.join(values, ["grp", "term"], "left").select("grp", "term", (F.col("rank") + F.coalesce("value", F.lit(0.0))).alias("rank"))
        scaled = storage.cut(R.scale(added, "rank", "grp"))
        least = scaled.groupBy("grp").agg(F.max("rank").alias("m")).agg(F.min("m")).first()[0]
        fitted = R.fit(scaled, "rank", least, "grp") if least is not None else scaled
        points = set() if seeds is None else {seeds} if isinstance(seeds, str) else set(seeds)
        return replace(self, ranks=storage.cut(fitted), focused=True, focus_points=self.focus_points | points)

    def search(self, name: str | None = None) -> tuple[Session, Display]:
        """Show the surroundings of a term, or all; the term is remembered."""
        after = replace(self, previous=name)
        return after, after.display()

    def clean(self) -> bool:
        return not (self.focused or self.focus_points or self.amplified or self.dampened)

    def selection(self) -> DataFrame:
        """The terms to show: (term)."""
        spark = self.network.display.nodes.sparkSession
        if self.previous is None:
            shown = self.network.display.nodes
        else:
            limit, expansion = SEARCH
            shown = G.neighbourhood(self.network.display, self.term(self.previous), limit, True, expansion).select("term")
        points = spark.createDataFrame([(t,) for t in sorted(self.focus_points | self.highlighted)], "term string")
        return shown.union(points).distinct()

    def masked(self, selection: DataFrame) -> DataFrame:
        """(grp, term, rank): ranks with the influence of amplified and dampened points.

        A point of rank r adds r² f(distance), and all is divided by 1 + the number of
        points of the group. For amplified points the distance is counted from the
        point's eccentricity down; without a path it is 0 for these and the
        eccentricity for dampened ones.
        """
        chosen = self.ranks.join(selection, "term", "left_semi")
        parts = None
        for points, mode, up in ((self.amplified, self.positive, True), (self.dampened, self.negative, False)):
            if not points:
                continue
            for grp, g in self.network.groups.items():
                spark = g.nodes.sparkSession
                sources = g.contains(spark.createDataFrame([(p,) for p in sorted(points)], "term string"))
                reached = storage.cut(G.distances(g, sources))
                own = sources.join(G.eccentricity(reached), "term").join(self.ranks.where(F.col("grp") == grp).select("term", "rank"), "term").withColumnsRenamed({"term": "src", "rank": "weight"})
                pairs = chosen.where(F.col("grp") == grp).select("grp", "term").join(F.broadcast(own))  # the points are few; each bears on all terms
                met = pairs.join(reached.withColumnRenamed("dst", "term"), ["src", "term"], "left")
                far = F.coalesce(F.col("ecc") - F.col("dist"), F.lit(0)) if up else F.coalesce("dist", "ecc")
                part = met.select("grp", "term", (F.col("weight") * F.col("weight") * R.INFLUENCES[mode](far)).alias("add"))
                parts = part if parts is None else parts.unionByName(part)
        if parts is None:
            return chosen.select("grp", "term", "rank")
        sums = parts.groupBy("grp", "term").agg(F.sum("add").alias("add"), F.count("*").alias("points"))
        return chosen.join(sums, ["grp", "term"], "left").select("grp", "term", ((F.col("rank") + F.coalesce("add", F.lit(0.0))) / (1 + F.coalesce("points", F.lit(0)))).alias("rank"))

    def top(self, masked: DataFrame, k: int = TOP) -> DataFrame:
        """The k terms of each group with the greatest masked ranks, ignored ones left out."""
        w = Window.partitionBy("grp").orderBy(F.desc("rank"), "term")
        return masked.where(~F.col("term").isin(*sorted(self.ignored))).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)

    def classes(self, selection: DataFrame, masked: DataFrame) -> DataFrame:
        """(term, class): selected, cascade or neighbour."""
        listed = lambda points: F.col("term").isin(*sorted(points))
        if self.clean():
            known = selection.withColumn("top", F.lit(False)).withColumn("near", ~listed(self.ignored))
        else:
            tops = self.top(masked).select("term").distinct().withColumn("top", F.lit(True))
            known = selection.join(tops, "term", "left").withColumn("top", F.coalesce("top", F.lit(False)) | (listed(self.focus_points) & ~listed(self.ignored))).withColumn("near", ~listed(self.ignored))
        selected = F.col("top") | listed(self.highlighted)
        base = known.select("term", F.when(selected, "selected").when(F.col("near"), "neighbour").alias("class")).where(F.col("class").isNotNull())
        if not self.highlighted:
            return base
        lit = self.network.display.arcs.where(F.col("src").isin(*sorted(self.highlighted))).select(F.col("dst").alias("term")).distinct().withColumn("lit", F.lit(True))
        return base.join(lit, "term", "left").select("term", F.when((F.col("class") == "neighbour") & F.coalesce("lit", F.lit(False)), "cascade").otherwise(F.col("class")).alias("class"))

    def link_counts(self) -> DataFrame:
        """(src, dst, cnt): distinct texts of each link, both directions added."""
        s = storage.cut(self.network.sentences.groupBy("src", "dst").agg(F.count("*").alias("c")))
        links = self.network.display.links()
        there = links.join(s, ["src", "dst"], "left").withColumnRenamed("c", "there")
        back = there.join(s.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("c").alias("back")), ["src", "dst"], "left")
        return back.select("src", "dst", (F.coalesce("there", F.lit(0)) + F.coalesce("back", F.lit(0))).alias("cnt"))

    def display(self) -> Display:
        """Nodes with ranks and opacity, links with opacity, length and stroke, and totals."""
        selection = storage.cut(self.selection())
        masked = storage.cut(self.masked(selection))
        classes = storage.cut(self.classes(selection, masked))
        groups, names = storage.cut(self.network.node_groups()), self.network.names()
        any_selected = not classes.where("class = 'selected'").isEmpty()
        faint = LIGHT if any_selected else MEDIUM
        alpha = F.when(F.col("class") == "selected", DARK).when(F.col("class") == "cascade", MEDIUM).otherwise(faint)
        every = F.map_from_arrays(F.array(*map(F.lit, self.network.groups)), F.array(*(F.coalesce(F.try_element_at("r", F.lit(g)), F.lit(0.0)) for g in self.network.groups)))
        ranked = masked.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("grp", "rank"))).alias("r"))
        nodes = classes.join(ranked, "term", "left").join(groups, "term", "left").join(names, "term", "left").select(F.coalesce("name", "term").alias("name"), every.alias("ranks"), alpha.cast("double").alias("alpha"), "groups")
        counted = storage.cut(self.link_counts())
        ends = lambda side: classes.select(F.col("term").alias(side), F.col("class").alias(f"{side}_class"))
        met = counted.join(ends("src"), "src").join(ends("dst"), "dst")
        pair = lambda a, b: ((F.col("src_class") == a) & (F.col("dst_class") == b)) | ((F.col("src_class") == b) & (F.col("dst_class") == a))
        near = lambda side: F.col(f"{side}_class").isin("neighbour", "cascade")
        lit = lambda side: F.col(side).isin(*sorted(self.highlighted))
        selected = pair("selected", "selected") | (lit("src") & near("dst")) | (near("src") & lit("dst"))
        most = counted.agg(F.max("cnt").alias("most"))
        g = lambda side: groups.select(F.col("term").alias(side), F.col("groups").alias(f"{side}_groups"))
        n = lambda side, to: names.select(F.col("term").alias(side), F.col("name").alias(to))
        drawn = met.withColumn("chosen", selected).join(F.broadcast(most)).join(g("src"), "src").join(g("dst"), "dst").join(n("src", "source"), "src", "left").join(n("dst", "target"), "dst", "left")
        links = drawn.select(
            F.coalesce("source", "src").alias("source"), F.coalesce("target", "dst").alias("target"), F.when(F.col("chosen"), DARK).otherwise(faint).alias("alpha"),
            (F.col("cnt") / F.col("most") * RADIUS).alias("distance"), F.when(F.col("src_groups") == F.col("dst_groups"), "full").otherwise("dash").alias("stroke"),
        )
        return Display(nodes, links, self.totals(classes, masked, met.where(pair("selected", "selected"))))

    def totals(self, classes: DataFrame, masked: DataFrame, chosen: DataFrame) -> DataFrame:
        """Number of nodes shown and selected, and the texts of the best selected link."""
        best = self.best_link(chosen.select("src", "dst"), masked)
        sizes = classes.agg(F.count("*").alias("size"), F.count(F.when(F.col("class") != "neighbour", 1)).alias("selection"))
        return sizes.join(F.broadcast(best.agg(F.coalesce(F.max("summary"), F.lit("")).alias("summary")))).select("summary", "size", "selection")

    def best_link(self, links: DataFrame, masked: DataFrame) -> DataFrame:
        """The link with the greatest sum of its ends' ranks over all groups, and its texts."""
        score = masked.groupBy("term").agg(F.sum("rank").alias("score"))
        scored = links.join(score.withColumnsRenamed({"term": "src", "score": "a"}), "src").join(score.withColumnsRenamed({"term": "dst", "score": "b"}), "dst")
        best = storage.cut(scored.select("src", "dst", (F.col("a") + F.col("b")).alias("score")).where("score > 0").orderBy(F.desc(F.round("score", 9)), "src", "dst").limit(1))
        ways = best.select("src", "dst", F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("way"))
        texts = self.network.sentences.join(F.broadcast(ways.select(F.col("src").alias("a"), F.col("dst").alias("b"), "way.*")), ["src", "dst"])
        joined = texts.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.array_join(F.sort_array(F.collect_list("sentence")), "|||").alias("summary"))
        return best.join(joined, ["src", "dst"], "left").select("src", "dst", "score", F.coalesce("summary", F.lit("")).alias("summary"))

    def chart(self, part: str = "whole", bars: int = BARS) -> DataFrame:
        """The first bars of the rank chart: (name, rank), for all groups or one with the rest as tie-break."""
        masked = self.masked(self.selection())
        own = F.sum("rank") if part == "whole" else F.sum(F.when(F.col("grp") == part, F.col("rank")).otherwise(0.0))
        rows = masked.groupBy("term").agg(own.alias("rank"), F.sum("rank").alias("whole")).join(self.network.names(), "term", "left")
        return rows.select(F.coalesce("name", "term").alias("name"), "rank", "whole").orderBy(F.desc(F.round("rank", 9)), F.desc(F.round("whole", 9)), "name").limit(bars).select("name", "rank")

    def radii(self, size: float, part: str = "whole") -> DataFrame:
        """(name, radius): a node's rank, of all groups or one, times ``size``, within bounds."""
        rows = self.masked(self.selection())
        own = F.sum("rank") if part == "whole" else F.sum(F.when(F.col("grp") == part, F.col("rank")).otherwise(0.0))
        ranked = rows.groupBy("term").agg(own.alias("rank")).join(self.network.names(), "term", "left")
        return ranked.select(F.coalesce("name", "term").alias("name"), F.least(F.greatest(F.col("rank") * size, F.lit(LEAST_RADIUS)), F.lit(MOST_RADIUS)).alias("radius"))

    def properties(self) -> DataFrame:
        return self.network.properties()


def uniform(network: Network) -> DataFrame:
    """Each term's start rank: the smallest of 1 / size over the groups."""
    sizes = [g.nodes.count() for g in network.groups.values()]
    start = min((1.0 / n if n else 0.0) for n in sizes)
    rows = [g.nodes.select(F.lit(name).alias("grp"), "term", F.lit(start).alias("rank")) for name, g in network.groups.items()]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return every


class Sessions:
    """Sessions by key; a key ``A&B`` compares two networks when it is first used."""

    def __init__(self) -> None:
        self.held: dict[str, Session] = {}

    def put(self, key: str, session: Session) -> None:
        self.held[key] = session

    def get(self, key: str) -> Session:
        if key not in self.held and "&" in key:
            a, b = key.split("&", 1)
            self.held[key] = Session.start(compare(self.held[a].network, self.held[b].network))
        return self.held[key]
