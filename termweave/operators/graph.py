"""Graphs of terms: builder, links, clustering, distances, neighbourhoods, matrices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave import storage

MOST_ROUNDS = 10_000


@dataclass(frozen=True)
class Graph:
    """Nodes (term) and arcs (src, dst); an undirected graph has each arc both ways."""

    kind: str
    nodes: DataFrame
    arcs: DataFrame

    def links(self) -> DataFrame:
        """Directed pairs, or unordered pairs as src < dst."""
        return self.arcs if self.kind == "directed" else self.arcs.where("src < dst")

    def degrees(self) -> DataFrame:
        """Number of out-neighbours: (term, degree)."""
        out = self.arcs.groupBy(F.col("src").alias("term")).agg(F.count("*").alias("degree"))
        return self.nodes.join(out, "term", "left").select("term", F.coalesce("degree", F.lit(0)).alias("degree"))

    def contains(self, terms: DataFrame) -> DataFrame:
        """Those of (term) rows that are nodes."""
        return terms.join(self.nodes, "term", "left_semi")

    def cut(self) -> Graph:
        """The same graph with its tables computed."""
        return Graph(self.kind, storage.cut(self.nodes), storage.cut(self.arcs))


def build(edges: DataFrame, kind: str = "undirected", nodes: DataFrame | None = None) -> Graph:
    """Graph of (src, dst) rows; repeats count once, a loop is a ValueError."""
    if kind not in ("directed", "undirected"):
        raise ValueError(f"unknown kind {kind!r}")
    pairs = edges.select("src", "dst")
    if not pairs.where("src = dst").isEmpty():
        raise ValueError("a node cannot be linked with itself")
    arcs = (pairs if kind == "directed" else pairs.union(pairs.select("dst", "src"))).distinct()
    ends = arcs.select(F.col("src").alias("term")).union(arcs.select("dst"))
    return Graph(kind, (ends if nodes is None else ends.union(nodes.select("term"))).distinct(), arcs)


def log_size(graph: Graph) -> DataFrame:
    """The decimal logarithm of the number of nodes and one, as one row."""
    return graph.nodes.agg(F.log10(F.count("*") + 1).alias("log_size"))


def sub_graph(graph: Graph, terms: DataFrame) -> Graph:
    """The links with both ends among (term) rows; nodes left alone vanish."""
    inside = graph.arcs.join(terms.select(F.col("term").alias("src")), "src", "left_semi").join(terms.select(F.col("term").alias("dst")), "dst", "left_semi")
    return build(inside.select("src", "dst"), graph.kind)


def clustering(graph: Graph) -> DataFrame:
    """Clustering coefficient of each node: (term, cc).

    Undirected: each triangle is found once, from its end of least degree, which keeps
    the two-step paths of hubs out, and counts for its three nodes. Directed: arcs among
    out-neighbours over k (k - 1).
    """
    degree = graph.degrees()
    if graph.kind == "undirected":
        d = degree.select(F.col("term"), F.struct("degree", "term").alias("o"))
        oriented = graph.arcs.join(d.withColumnsRenamed({"term": "src", "o": "os"}), "src").join(d.withColumnsRenamed({"term": "dst", "o": "od"}), "dst").where("os < od").select("src", "dst", "od")
        one = oriented.select("src", F.col("dst").alias("b"), F.col("od").alias("ob"))
        two = oriented.select("src", F.col("dst").alias("c"), F.col("od").alias("oc"))
        closing = oriented.select(F.col("src").alias("b"), F.col("dst").alias("c"))
        triangles = one.join(two, "src").where("ob < oc").join(closing, ["b", "c"])
        found = triangles.select(F.explode(F.array("src", "b", "c")).alias("term"))
        possible = F.col("degree") * (F.col("degree") - 1) / 2
    else:
        out, on = graph.arcs.select(F.col("src").alias("n"), F.col("dst").alias("a")), graph.arcs.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        found = out.join(on, "a").join(out.select("n", F.col("a").alias("b")), ["n", "b"]).select(F.col("n").alias("term"))
        possible = F.col("degree") * (F.col("degree") - 1)
    closed = found.groupBy("term").agg(F.count("*").alias("closed"))
    return degree.join(closed, "term", "left").select("term", F.when(F.col("degree") > 1, F.coalesce("closed", F.lit(0)) / possible).otherwise(F.lit(0.0)).alias("cc"))


def distances(graph: Graph, sources: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Steps from each source to each node that it reaches: (src, dst, dist), itself 0.

    All sources advance together; each round joins only the newly reached pairs with the
    arcs and drops those known before.
    """
    starts = graph.nodes if sources is None else graph.contains(sources.select("term"))
    reached = storage.cut(starts.select(F.col("term").alias("src"), F.col("term").alias("dst"), F.lit(0).alias("dist")))
    frontier, arcs = reached, graph.arcs.select(F.col("src").alias("mid"), "dst")
    for step in range(1, (limit if limit is not None else MOST_ROUNDS) + 1):
        ahead = frontier.select("src", F.col("dst").alias("mid")).join(arcs, "mid").select("src", "dst").distinct()
        frontier = storage.cut(ahead.join(reached.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("dist", F.lit(step)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def all_distances(graph: Graph) -> DataFrame:
    """Distances of all pairs, null where there is no path: a matrix of all nodes by contract."""
    every = graph.nodes.select(F.col("term").alias("src")).crossJoin(graph.nodes.select(F.col("term").alias("dst")))
    return every.join(distances(graph), ["src", "dst"], "left")


def eccentricity(reached: DataFrame) -> DataFrame:
    """Largest finite distance from each node: (term, ecc)."""
    return reached.groupBy(F.col("src").alias("term")).agg(F.max("dist").alias("ecc"))


def eccentricities(graph: Graph, batches: int = 1) -> DataFrame:
    """The same for all nodes of a graph, whose sources are taken in so many batches.

    No more than one batch's distances are held at a time.
    """
    part = F.pmod(F.xxhash64("term"), F.lit(batches))
    found = None
    for k in range(batches):
        own = storage.cut(eccentricity(distances(graph, graph.nodes.where(part == k))))
        found = own if found is None else found.unionByName(own)
    return found


def diameter(reached: DataFrame) -> DataFrame:
    """Largest eccentricity as one row; null for an empty graph."""
    return reached.agg(F.max("dist").alias("diameter"))


def neighbourhood(graph: Graph, term: str, limit: int | None = None, inclusive: bool = False, expansion: tuple[int, float] | None = None) -> DataFrame:
    """Nodes around a node: (term, dist).

    A step to distance d is open if there is no limit, or d is within it, or, with
    ``expansion`` (more, share), d is within limit + more and the next node's clustering
    coefficient times share is at least the present node's. A term that is no node is a
    KeyError.
    """
    if expansion is not None and not (isinstance(expansion[0], int) and expansion[0] > 0 and 0 < expansion[1] <= 1):
        raise ValueError("an expansion is a positive number of steps and a share in (0, 1]")
    start = graph.nodes.where(F.col("term") == term)
    if start.isEmpty():
        raise KeyError(term)
    arcs = graph.arcs
    if expansion is not None:
        cc = storage.cut(clustering(graph))
        arcs = storage.cut(arcs.join(cc.withColumnsRenamed({"term": "src", "cc": "cs"}), "src").join(cc.withColumnsRenamed({"term": "dst", "cc": "cd"}), "dst"))
    reached = storage.cut(start.select("term", F.lit(0).alias("dist")))
    frontier = reached
    last = MOST_ROUNDS if limit is None else limit + (expansion[0] if expansion else 0)
    for step in range(1, last + 1):
        open_ = arcs if limit is None or step <= limit else arcs.where(F.col("cd") * expansion[1] >= F.col("cs"))
        ahead = frontier.select(F.col("term").alias("src")).join(open_.select("src", F.col("dst").alias("term")), "src").select("term").distinct()
        frontier = storage.cut(ahead.join(reached, "term", "left_anti").withColumn("dist", F.lit(step)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached if inclusive else reached.where(F.col("term") != term)


def walk(graph: Graph, term: str, depth: int) -> Graph:
    """The part of a graph within ``depth`` steps of a node."""
    return sub_graph(graph, neighbourhood(graph, term, depth, inclusive=True).select("term"))


def adjacency(graph: Graph) -> DataFrame:
    """Sparse adjacency with ones on the diagonal: (row, col, value)."""
    own = graph.nodes.select(F.col("term").alias("row"), F.col("term").alias("col"))
    return own.union(graph.arcs.select("src", "dst")).distinct().withColumn("value", F.lit(1))


def adjacency_matrix(graph: Graph) -> DataFrame:
    """Square 0/1 matrix, a column for each node; for graphs that a matrix can show."""
    names = [r["term"] for r in graph.nodes.orderBy("term").collect()]
    return adjacency(graph).groupBy("row").pivot("col", names).agg(F.max("value")).na.fill(0).orderBy("row")
