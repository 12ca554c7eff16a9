"""Sinks: adjacency as CSV, graphs and displays as JSON, glossaries as markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave import storage
from termweave.operators import graph as G


def adjacency_csv(graph: G.Graph, path: str, sparse: bool = False) -> None:
    """Write the 0/1 matrix with a header, or, for large graphs, its ones as rows."""
    (G.adjacency(graph) if sparse else G.adjacency_matrix(graph).withColumnRenamed("row", "")).write.mode("overwrite").csv(path, header=True)


def graph_json(graph: G.Graph) -> DataFrame:
    """Rows of JSON, ``{"id", "group"}`` for nodes and ``{"source", "target"}`` for links.

    A node's group is its place among all names modulo 10. Places come from sorted
    ranges and the counts of the ranges before, so no task numbers all nodes.
    """
    ranged = storage.cut(graph.nodes.select("term").repartitionByRange("term").sortWithinPartitions("term").select("term", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # one row for each range
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    numbered = ranged.join(F.broadcast(before), "part")
    nodes = numbered.select(F.to_json(F.struct(F.col("term").alias("id"), ((F.col("before") + F.col("at")) % 10).alias("group"))).alias("json"), F.lit("node").alias("kind"))
    links = graph.links().select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"))).alias("json"), F.lit("link").alias("kind"))
    return nodes.unionByName(links)


def glossary_markup(rows: DataFrame) -> DataFrame:
    """One line ``=:head:= definition`` for each (head, definition) row."""
    return rows.select(F.format_string("=:%s:= %s", "head", "definition").alias("value"))
