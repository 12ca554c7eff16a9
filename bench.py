"""Time the headline queries and print one line of JSON.

The text queries run whole. The graph operators are timed on the graph that
``graph_build`` has made of the same documents and written, each by itself.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from termweave.operators import graph, pagerank
from termweave.queries import QUERIES, graph_of

WHOLE = ["sentence_stats", "vocab_top_terms", "term_matches", "cooc_counts", "basket_cooc_part_type", "basket_pagerank"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000).selectExpr("sum(id)").collect()
    took: dict[str, float] = {}

    def timed(name: str, run):
        began = time.time()
        out = run()
        took[name] = round(time.time() - began, 2)
        return out

    store = lambda df: df.write.format("noop").mode("overwrite").save()
    for name in WHOLE:
        timed(name, lambda: store(QUERIES[name](spark, folder)))
    g = timed("graph_build", lambda: graph_of(spark, folder))
    timed("pagerank", lambda: store(pagerank.pagerank(g, epsilon=0, epochs=10)))
    timed("all_seed_pagerank", lambda: store(pagerank.all_seeds(g, epsilon=0, epochs=10)))
    timed("clustering_coefficient", lambda: store(graph.clustering(g)))
    timed("distances", lambda: store(graph.all_distances(g)))
    sizes = {"nodes": g.nodes.count(), "arcs": g.arcs.count()}
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "graph": sizes, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
