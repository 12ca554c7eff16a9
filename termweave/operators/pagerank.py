"""PageRank, plain and biased, and the six metrics of a ranked graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave import storage
from termweave.functions import ranks as R
from termweave.operators.graph import Graph, clustering

DAMPING, EPSILON, EPOCHS, BIAS = 0.85, 0.005, 50, 0.1
UNBIASED, BIASED = ("PR", "IPR", "CC", "ICC"), ("BPR", "IBPR")
#: Up to so many arcs, and so many ranks, rounds run on arrays in one task.
SMALL = 500_000

def pagerank(graph: Graph, biases: dict[str, float] | None = None, damping: float = DAMPING, epsilon: float = EPSILON, epochs: int = EPOCHS) -> DataFrame:
    """Rank of each node: (term, rank).

    A round gives each node (1 - d)/N, its part of the mass of nodes without arcs, and d
    times the shares of its in-neighbours, times 1 + bias where the node has one (then
    all are scaled to sum 1). It ends with the first round that changes less than
    ``epsilon`` in sum, whose result counts. With epsilon 0 just ``epochs`` rounds run.
    """
    return batch_pagerank(graph, {None: biases or {}}, damping, epsilon, epochs).drop("seed")


def batch_pagerank(graph: Graph, seeds: dict, damping: float = DAMPING, epsilon: float = EPSILON, epochs: int = EPOCHS) -> DataFrame:
    """PageRank for several bias maps at once: (seed, term, rank).

    All seeds share each round's joins; a seed that has converged keeps its ranks.
    """
    spark, n = graph.nodes.sparkSession, graph.nodes.count()
    if n and seeds and n * len(seeds) <= SMALL and graph.arcs.count() <= SMALL:
        return _on_arrays(graph, dict(seeds), damping, epsilon, epochs)
    biased = spark.createDataFrame([(s, t, float(b)) for s, own in seeds.items() for t, b in own.items()], "seed string, term string, bias double")
    every = spark.createDataFrame([(s, bool(own)) for s, own in seeds.items()], "seed string, scaled boolean")
    return _by_exchange(graph, n, every, biased, damping, epsilon, epochs)


def _on_arrays(graph: Graph, seeds: dict, damping: float, epsilon: float, epochs: int) -> DataFrame:
    rows = graph.nodes.select("term", F.lit(None).cast("string").alias("dst")).unionByName(graph.arcs.select(F.col("src").alias("term"), "dst"))
    return rows.coalesce(1).mapInPandas(_rank_in_one(seeds, damping, epsilon, epochs), "seed string, term string, rank double")


def _by_exchange(graph: Graph, n: int, seeds: DataFrame, biased: DataFrame, damping: float, epsilon: float, epochs: int) -> DataFrame:
    """The rounds for tables of seeds (seed, scaled) and biases (seed, term, bias) of any size.

    The ranks are a row for each seed and node by contract. What is one row a seed is
    joined without a hint, so that the engine sends it to all tasks if it is small.
    """
    degree = graph.degrees()
    shares = storage.cut(graph.arcs.join(degree.withColumnRenamed("term", "src"), "src").select("src", "dst", (1.0 / F.col("degree")).alias("share")))
    factors = biased.withColumnsRenamed({"seed": "of", "term": "at"})
    base = degree.select("term", (F.col("degree") == 0).alias("sink")).crossJoin(seeds)
    base = base.join(factors, (F.col("term") == F.col("at")) & F.col("seed").eqNullSafe(F.col("of")), "left").select("seed", "term", "sink", "scaled", F.coalesce(F.col("bias") + 1.0, F.lit(1.0)).alias("factor"))
    state = storage.cut(base.select("*", F.lit(1.0 / max(1, n)).alias("rank"), F.lit(False).alias("done")))
    scales = not seeds.where("scaled").isEmpty()
    of_seed = lambda rows, value, kind="left": (rows.join(value.withColumnRenamed("seed", "of"), F.col("seed").eqNullSafe(F.col("of")), kind).drop("of"))
    for _ in range(epochs if n else 0):
        sent = state.select("seed", F.col("term").alias("src"), "rank").join(shares, "src").groupBy("seed", F.col("dst").alias("at")).agg(F.sum(F.col("rank") * F.col("share")).alias("got")).withColumnRenamed("seed", "of")
        leak = state.where("sink").groupBy("seed").agg(F.sum("rank").alias("leak"))
        met = of_seed(state.join(sent, (F.col("term") == F.col("at")) & F.col("seed").eqNullSafe(F.col("of")), "left").drop("of", "at"), leak)
        raw = (1.0 - damping) / n + damping * F.coalesce("leak", F.lit(0.0)) / n + damping * F.coalesce("got", F.lit(0.0)) * F.col("factor")
        fresh = met.select("seed", "term", "sink", "scaled", "factor", "rank", "done", raw.alias("raw"))
        if scales:
            fresh = storage.cut(fresh)
            total = fresh.groupBy("seed").agg(F.sum("raw").alias("total"))
            fresh = of_seed(fresh, total).withColumn("raw", F.when(F.col("scaled"), F.col("raw") / F.col("total")).otherwise(F.col("raw")))
        moved = F.when(F.col("done"), F.col("rank")).otherwise(F.col("raw"))
        fresh = storage.cut(fresh.select("seed", "term", "sink", "scaled", "factor", moved.alias("rank"), "done", F.abs(moved - F.col("rank")).alias("change")))
        if epsilon <= 0:
            state = fresh.drop("change")
            continue
        still = storage.cut(fresh.groupBy("seed").agg((F.sum("change") < epsilon).alias("still")))
        state = of_seed(fresh, still).select("seed", "term", "sink", "scaled", "factor", "rank", (F.col("done") | F.col("still")).alias("done"))
        if still.where(~F.col("still")).isEmpty():
            break
    return state.select("seed", "term", "rank")


def _rank_in_one(seeds: dict, damping: float, epsilon: float, epochs: int):
    """The same rounds on arrays in one task, for a graph whose checked size is small."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        terms = np.array(sorted(rows.loc[rows["dst"].isna(), "term"]), dtype=object)
        arcs = rows[rows["dst"].notna()]
        src, dst = np.searchsorted(terms, arcs["term"].to_numpy()), np.searchsorted(terms, arcs["dst"].to_numpy())
        n, degree = len(terms), np.bincount(src, minlength=len(terms))
        for seed, biases in seeds.items():
            rank = np.full(n, 1.0 / n)
            factor = 1.0 + np.array([biases.get(t, 0.0) for t in terms])
            for _ in range(epochs):
                got = np.bincount(dst, weights=rank[src] / degree[src], minlength=n)
                after = (1.0 - damping) / n + damping * rank[degree == 0].sum() / n + damping * got * factor
                after = after / after.sum() if biases else after
                change, rank = np.abs(after - rank).sum(), after
                if change < epsilon:
                    break
            yield pd.DataFrame({"seed": [seed] * n, "term": terms, "rank": rank})

    return run


def metric(graph: Graph, name: str, seed: str | list[str] | None = None, bias: float | None = None, epsilon: float = EPSILON, epochs: int = EPOCHS) -> DataFrame:
    """One of PR, IPR, CC, ICC, BPR, IBPR as (term, value).

    The biased ones need a seed, or for BPR a list of seeds.
    """
    if name not in UNBIASED + BIASED:
        raise ValueError(f"unknown metric {name!r}")
    if name in ("CC", "ICC"):
        value = R.scale(clustering(graph).withColumnRenamed("cc", "value"), "value")
    elif name in ("PR", "IPR"):
        value = pagerank(graph, None, DAMPING, epsilon, epochs).withColumnRenamed("rank", "value")
    else:
        if seed is None or (isinstance(seed, list) and name == "IBPR"):
            raise ValueError(f"{name} needs one seed")
        seeds = seed if isinstance(seed, list) else [seed]
        value = pagerank(graph, {s: BIAS if bias is None else bias for s in seeds}, DAMPING, epsilon, epochs).withColumnRenamed("rank", "value")
    return R.invert(value, "value") if name in ("IPR", "ICC", "IBPR") else value


def all_seeds(graph: Graph, seeds: DataFrame | None = None, bias: float = BIAS, epsilon: float = EPSILON, epochs: int = EPOCHS) -> DataFrame:
    """Biased PageRank from each of some seeds (term), all nodes if none are given: (seed, term, rank).

    Only for a graph and seeds of a checked small size do the seeds' names leave their
    table.
    """
    wanted = (graph.nodes if seeds is None else graph.contains(seeds.select("term"))).select(F.col("term").alias("seed")).distinct()
    n, k = graph.nodes.count(), wanted.count()
    if n * k <= SMALL and graph.arcs.count() <= SMALL:
        return batch_pagerank(graph, {r["seed"]: {r["seed"]: bias} for r in wanted.collect()}, DAMPING, epsilon, epochs)
    wanted = storage.cut(wanted)
    biased = wanted.select("seed", F.col("seed").alias("term"), F.lit(float(bias)).alias("bias"))
    return _by_exchange(graph, n, wanted.withColumn("scaled", F.lit(True)), biased, DAMPING, epsilon, epochs)
