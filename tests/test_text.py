import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termweave.functions import ranks, text
from termweave.functions.stem import stem


def split(spark, value, paragraphs=False):
    return spark.createDataFrame([(value,)], "t string").select(text.sentences(F.col("t"), paragraphs).alias("s")).first()["s"]


@pytest.mark.parametrize(
    ("value", "paragraphs", "expected"),
    [
        ("once there was! a little man", False, [["once", "there", "was"], ["a", "little", "man"]]),
        ("once there was. a\n\nlittle man", False, [["once", "there", "was"], ["a", "little", "man"]]),
        ("once there was. a\n\nlittle man", True, [["once", "there", "was", "a"], ["little", "man"]]),
        ("once there was. a\r\n\r\nlittle man", True, [["once", "there", "was", "a"], ["little", "man"]]),
        ("Hi?! x", False, [["Hi"], [], ["x"]]),
        ("a. b.", False, [["a"], ["b"]]),
        ("pi is 3.14 in A.D times", False, [["pi", "is", "3.14", "in", "A.D", "times"]]),
        ("", False, []),
        (None, False, None),
    ],
)
def test_sentences(spark, value, paragraphs, expected):
    assert split(spark, value, paragraphs) == expected


def plain_sentences(value):
    out, now = [], []
    marked = re.sub(r"[?!]", " \x01 ", re.sub(r"\.(?!\w)", " \x01 ", value))
    for token in re.findall(r"[\w.<=]+|\x01", marked):
        if token == "\x01":
            out.append(now)
            now = []
        else:
            now.append(token)
    return [*out, now] if now else out


def test_sentences_against_plain_python(spark):
    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.text(alphabet="ab. ?!\né3", max_size=30), min_size=60, max_size=60))
    def run(values):
        rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", text.sentences(F.col("t")).alias("s")).collect()
        assert {r["i"]: r["s"] for r in rows} == {i: plain_sentences(v) for i, v in enumerate(values)}

    run()


#: What the algorithm must give for these words.
@pytest.mark.parametrize(
    ("word", "expected"),
    [
        ("Apples", "appl"), ("goats", "goat"), ("explores", "explor"), ("crater", "crater"), ("Phanerozoic", "phanerozo"), ("gravity", "graviti"),
        ("Ares", "Ares"), ("NASA", "NASA"), ("Is", "Is"), ("3.14", "3.14"), ("Learnings", "learning"), ("hopping", "hop"), ("generously", "generous"), ("relational", "relat"),
    ],
)
def test_stem(word, expected):
    assert stem(word) == expected


def test_rank_functions(spark):
    rows = spark.createDataFrame([("l", "a", 1.0), ("l", "b", 3.0), ("r", "c", 0.0), ("r", "d", 0.0)], "g string, t string, v double")
    got = lambda df: {r["t"]: round(r["v"], 6) for r in df.collect()}
    assert got(ranks.scale(rows, "v", "g")) == {"a": 0.25, "b": 0.75, "c": 0.5, "d": 0.5}
    assert got(ranks.invert(rows, "v", "g")) == {"a": 0.625, "b": 0.375, "c": 0.5, "d": 0.5}
    assert got(ranks.fit(rows, "v", 1.5, "g")) == {"a": 0.5, "b": 1.5, "c": 0.0, "d": 0.0}
    other = spark.createDataFrame([("a", 2.0)], "t string, v double")
    assert ranks.delta(rows.where("g = 'l'").select("t", "v"), other, ["t"], "v").first()["delta"] == 4.0
