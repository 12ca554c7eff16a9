"""Measure op2's recall: links of every document whose id is divisible by 50, by brute force.

    python -m tests.llm.measure_recall /root/testdata/sf0.1
"""

import re
import sys

from pyspark.sql import SparkSession

from termweave.llm.minhash import op2_minhash


def main(folder):
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").getOrCreate()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    component = {r["doc_id"]: r["component_id"] for r in op2_minhash(spark, folder).collect()}
    fold, sets, by_shingle = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), {}, {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets[i] = {" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
        for s in sets[i]:
            by_shingle.setdefault(s, []).append(i)
    links = found = 0
    for i in (i for i in sets if i % 50 == 0):
        shared = {}
        for s in sets[i]:
            for k in by_shingle[s]:
                shared[k] = shared.get(k, 0) + 1
        for k, n in shared.items():
            if k != i and 100 * n >= 80 * (len(sets[i]) + len(sets[k]) - n):
                links += 1
                found += component[i] == component[k]
    print(f"documents {len(texts)}, links of the queries {links}, in one component {found}, recall {found / max(1, links):.6f}")


if __name__ == "__main__":
    main(sys.argv[1])
