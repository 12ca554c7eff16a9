"""The pipeline's stages, each judged on its own input."""

import random

import corpus_pipeline as cp
import numpy as np
from pyspark.sql import functions as F
from tests.llm.test_operators import brute_components, labelled, prose
from termweave.llm import common, mixing


def test_stages(spark, tmp_path):
    docs, labels = labelled(spark, 150)
    base = docs.collect()
    r = random.Random(1)
    passage = prose(77, 60)
    rows = [tuple(x) for x in base] + [(1000 + i, base[i]["text"], "en", "s", 0) for i in range(10)]
    rows += [(2000 + i, f"{prose(300 + i, 30)} {passage} {prose(400 + i, 30)}", "en", "s", 0) for i in range(5)]
    rows += [(4000, prose(500, 40), "en", "s", 0)] * 3 + [(4001, t + prose(501, 40), "en", "s", 0) for t in "ba"]
    rows += [(3000, None, "en", "s", 0), (3001, "", None, "s", 0), (3002, "12 34 !!", "en", "s", 0), (None, prose(9, 50), "en", "s", 0)]
    r.shuffle(rows)
    folder = str(tmp_path)
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    now = common.read(spark, folder, "documents")
    seen = [now.toPandas()]
    for name, stage in cp.STAGES[:-1]:
        now = common.materialize(stage(spark, now, folder), name)
        assert now.columns == cp.COLUMNS
        seen.append(now.toPandas())
    start, languages, singles, cut, mixed = seen
    clean = sorted(-1 if i is None else i for i, t, *_ in rows if t and any(c.isalpha() for c in t))
    assert sorted(languages["doc_id"].fillna(-1).astype(int)) == clean and -1 in clean
    named = languages[languages["doc_id"].notna()].sort_values("text").drop_duplicates("doc_id")
    groups = brute_components(dict(zip(named["doc_id"].astype(int), named["text"])), 5)
    assert sorted(singles["doc_id"].fillna(-1).astype(int)) == sorted([-1] + [i for i, (_, c) in groups.items() if i == c])
    texts = dict(zip(cut["doc_id"], cut["text"]))
    assert sum(passage[:100] in t for t in texts.values()) == 1 and all(cut["n_chars"] == cut["text"].str.len())
    assert set(mixed["doc_id"]) <= set(cut["doc_id"]) and len(mixed) > 0.5 * len(cut)
    last = cp.STAGES[-1][1](spark, now, folder).toPandas()
    assert len(last) == len(mixed) and (last["n_tokens"] == last["ids"].str.len()).all()


def test_many_copies(spark, tmp_path, monkeypatch):
    """A rate beyond a thousand is emitted in full."""
    docs, labels = labelled(spark, 30)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(mixing, "fit_rates", lambda soft, targets: ([np.array([-2_499.25] * 3)], 0.0))
    some = docs.where("doc_id < 4")
    found = mixing.mix(some, labels).collect()
    assert all(abs(r["copies"] - r["rate"]) < 1 and abs(r["rate"] - 2_500.25) < 1e-6 for r in found)
    made = {r["doc_id"]: r["count"] for r in cp.mixing_rates(spark, some, str(tmp_path)).groupBy("doc_id").count().collect()}
    assert made == {r["doc_id"]: r["copies"] for r in found}


def test_mixing_of_repeated_rows(spark, tmp_path, monkeypatch):
    """Rows that share a doc_id, or have none, are copied each by its own number."""
    docs, labels = labelled(spark, 30)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(mixing, "fit_rates", lambda soft, targets: ([np.array([-11.0] * 3)], 0.0))
    row = docs.where("doc_id = 3")
    rows = row.union(row).union(row).union(row.selectExpr("cast(null as bigint)", "text", "lang", "source", "n_chars"))
    assert cp.mixing_rates(spark, rows, str(tmp_path)).count() == 4 * 12


def test_stages_of_an_empty_table(spark, tmp_path):
    docs, labels = labelled(spark, 30)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    none = docs.withColumn("copies", F.lit("clash")).withColumn("lang_pred", F.lit("clash")).limit(0)
    for name, stage in cp.STAGES:
        found = stage(spark, none, str(tmp_path))
        assert found.count() == 0 and (name == "encoding" or found.columns == cp.COLUMNS)
    # clashing columns do not disturb any stage
    wide = docs.where("doc_id < 6").withColumns({c: F.lit("clash") for c in ("copies", "lang_pred", "n_removed", "kept", "rate", "high", "n_tokens")})
    for name, stage in cp.STAGES:
        assert stage(spark, wide, str(tmp_path)).count() > 0, name
