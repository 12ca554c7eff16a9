"""Connected components of a link table, by alternating stars with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm import common

MOST_ROUNDS = 64


def components(links: DataFrame) -> DataFrame:
    """Give each id of (a, b) links the smallest id that it reaches.

    Each round hangs every node's larger neighbours under its smallest neighbour, then
    every node and its smaller neighbours under the smallest of them; the link table
    becomes one star per component in a logarithmic number of rounds and never grows
    beyond its size. Minima are partial aggregates, and a node with very many links is
    joined with its minimum where its links are, so no star is dealt to one task. Each
    round's table replaces the one before.
    """
    at = common.materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    state = lambda t: tuple(t.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first())
    known = state(at)
    for _ in range(MOST_ROUNDS):
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = common.join_hot(both, least, "u", "n", 2 * known[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = common.join_hot(large, low, "u", "n", known[0]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        before, at = at, common.materialize(small, "links")
        common.release(before)
        last, known = known, state(at)
        if known == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = at.select(F.col("v").alias("doc_id"), F.col("v").alias("component_id")).distinct()
    return at.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id")).unionByName(roots)
