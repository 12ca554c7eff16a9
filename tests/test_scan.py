"""The batched text step against the column functions and the join, and how often texts are read."""

import random
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termweave.functions import scan, text
from termweave.operators import cooc, match, vocab
from termweave.plans import network as N
from termweave.plans.session import Session

ODD = ["a", "B", "ab", "Ab", "İ", "ΣΑΣ", "ß", "x_1", "a<=b", "é", "中", " ", "  ", "\n\n", ".", "..", "?", "!", "\x01", "\x02", ",", "-", "٣"]


def odd_texts(n=60):
    chance = random.Random(5)
    return [None, "", ".", "a", "?!", " . a"] + ["".join(chance.choice(ODD) + chance.choice(["", " "]) for _ in range(chance.randrange(40))) for _ in range(n)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_are_those_of_the_column_function(spark, monkeypatch):
    texts = odd_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    wanted = {r["doc_id"]: r["s"] for r in rows.select("doc_id", text.sentences(F.col("text")).alias("s")).collect()}
    monkeypatch.setattr(scan, "PIECE", 50)
    got = {i: [] for i in range(len(texts))}
    for piece in scan.pieces(pa.RecordBatch.from_pydict({"i": range(len(texts)), "text": pa.array(texts, pa.string())}), "text"):
        found = scan.sentences(piece["text"])
        words = found.known.take(pa.array(found.codes)).to_pylist()
        for k, row in enumerate(found.rows):
            own = got[piece["i"][int(row)].as_py()]
            assert found.places[k] == len(own)
            own.append(words[found.bounds[k] : found.bounds[k + 1]])
    assert got == {i: s or [] for i, s in wanted.items()}


@pytest.mark.parametrize(("how", "gate"), [("lower", False), ("identity", True), ("stem", False)])
def test_matches_in_texts_are_those_of_the_join(spark, monkeypatch, how, gate):
    chance = random.Random(7)
    texts = [" ".join(chance.choice(["goats", "Goat", "eat", "the", "apples", "Apple", "red.", "it?"]) for _ in range(25)) for _ in range(40)] + odd_texts(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    listed = spark.createDataFrame([(t,) for t in ("goat", "goats eat", "eat the apples", "the apples", "apples red", "the", "red", "eat Goat eat")], "text string")
    words = vocab.from_terms(listed, how=how)
    show = lambda df: sorted((r["doc_id"], r["win_ix"], [tuple(h) for h in r["hits"]], len(r["hits"]) > 1 and r["sentence"]) for r in df.collect())
    got, rows = show(match.in_texts(docs, words, how, gate, shown=True)), match.in_windows(cooc.windows(docs, 1), words, how, gate).collect()
    assert got and sorted((r["doc_id"], r["win_ix"], [tuple(h) for h in r["hits"]]) for r in rows) == [g[:3] for g in got]
    monkeypatch.setattr(match, "ROW_PATHS", 0)
    assert show(match.in_texts(docs, words, how, gate, shown=True)) == got


def test_frequent_terms_by_plain_counts(spark):
    docs = spark.createDataFrame([(1, "Moon light. Moon light? moonlight"), (2, "moon! light moon light"), (3, None), (4, "a.b.cde light")], "doc_id bigint, text string")
    got = [(r["term"], r["n"], r["df"]) for r in vocab.most_frequent(docs, words=2, pairs=3).collect()]
    assert got == [("light", 1, 3), ("moon", 1, 2), ("moon light", 2, 2), ("light moon", 2, 1)]


def test_texts_are_split_once_and_not_before_they_are_dealt(spark):
    docs = spark.createDataFrame([(1, "goats eat. apples goats")], "doc_id bigint, text string").repartition(3)
    words = vocab.from_terms(spark.createDataFrame([("goats. apples",)], "text string"), how="lower")
    assert plan(cooc.windows(docs, 1)).count("regexp_extract_all") == 1
    assert "regexp" not in plan(match.in_texts(docs, words)) and "Filter" not in plan(match.in_texts(docs, words))


def test_sentences_are_prepared_once_for_a_display(spark):
    docs = spark.createDataFrame([(1, "goats eat apples. apples goats. goats eat apples"), (2, "Goats eat apples! moon")], "doc_id bigint, text string")
    words = vocab.from_terms(spark.createDataFrame([("goats. apples. moon",)], "text string"), how="lower")
    net = N.build(N.parse_content(docs, words, how="lower"), keep=100)
    calls = []
    session = Session.start(replace(net, find_sentences=lambda: calls.append(1) or net.find_sentences()))
    shown = session.with_metric("CC").focus().display()
    assert shown.totals.first()["summary"] == "|||".join(sorted(["apples goats", "goats eat apples", "Goats eat apples"] * 2))
    assert len(calls) == 1 and {tuple(r) for r in net.sentences.where("src < dst").collect()} == {("apples", "goats", s) for s in ("apples goats", "goats eat apples", "Goats eat apples")}


def test_inflections_are_counted_once(spark):
    docs = spark.createDataFrame([(1, "Goats eat. goats")], "doc_id bigint, text string")
    words = vocab.from_terms(spark.createDataFrame([("goats",)], "text string"), how="lower")
    counted = match.inflections(match.each(match.in_texts(docs, words)), words)
    assert "MapInArrow" not in plan(counted) and {(r["surface"], r["cnt"]) for r in counted.collect()} == {("goats", 2), ("Goats", 1)}
