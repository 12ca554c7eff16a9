import json

import pytest

from termweave.operators import cooc, match, vocab
from termweave.plans import network as N
from termweave.plans.session import Session, Sessions
from termweave.sources import readers, writers
from termweave.streaming import cooc_stream


def terms(spark, value, how="stem"):
    return vocab.from_terms(spark.createDataFrame([(value,)], "text string"), how=how)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def counted(pairs):
    return {(r["src"], r["dst"]): r["cnt"] for r in cooc.counts(pairs).collect()}


def test_longest_match(spark):
    got = lambda text, words: {r["term"] for r in match.matches(cooc.windows(docs(spark, text), 1), terms(spark, words, "identity"), "identity").collect()}
    assert got("a little man, a little wooden man", "little. little man") == {"little", "little man"}
    assert got("little <= man", "little. little man") == {"little"}
    assert got("little > man", "little. little man") == {"little man"}
    assert got("once there was a little man", "once there. there was. was a") == {"once there", "was a"}


def test_gate(spark):
    words = terms(spark, "there was. man", "identity")
    found = match.matches(cooc.windows(docs(spark, "there was a man"), 1), words, "identity", gate=True)
    assert [r["term"] for r in found.collect()] == ["man"]


#: Small inputs whose pairs are known, here and below.
GLOSSARY = [
    (0, "Apple", "Goat explores. xyz querty apples crater . Explore apples"), (1, "Goat", "nadda."),
    (2, "explore", "Crater sphere\ntermy."), (3, "crater Sphere", "nadda."),
]


def test_glossary(spark):
    rows = spark.createDataFrame(GLOSSARY, "ord int, head string, definition string")
    parsed = N.parse_glossary(rows)
    assert counted(parsed.pairs) == {("appl", "goat"): 1, ("appl", "explor"): 2, ("explor", "crater sphere"): 1}
    assert {r["term"] for r in parsed.sources.collect()} == {"appl", "goat", "explor", "crater sphere"}
    stats = cooc.statistics(cooc.counts(parsed.pairs), parsed.sources).first()
    assert (stats["max_cnt"], stats["min_cnt"]) == (2, 0)


CONTENT = "Apples something explores and goats.\nxyz querty apples crater. Explore Crater sphere\ntermy . explores apples"


@pytest.mark.parametrize(("text", "paragraphs", "expected"), [
    (CONTENT, False, {("appl", "goat"): 1, ("appl", "explor"): 2, ("explor", "goat"): 1, ("crater sphere", "explor"): 1}),
    ("Apples explores and goats. crater.\n\nExplore Crater sphere apples\r\n\r\nexplores apples", True, {("appl", "explor"): 3, ("appl", "goat"): 1, ("explor", "goat"): 1, ("appl", "crater sphere"): 1, ("crater sphere", "explor"): 1}),
])
def test_content(spark, text, paragraphs, expected):
    words = terms(spark, "Apple. Goat .\nexplore. \ncrater Sphere")
    parsed = N.parse_content(docs(spark, text), words, paragraphs=paragraphs)
    assert counted(parsed.pairs) == expected | {(b, a): n for (a, b), n in expected.items()}


def test_windows(spark):
    four = docs(spark, "a. b. c. d.")
    at = lambda mode: [r["win_ix"] for r in cooc.windows(four, 2, mode=mode).orderBy("win_ix").collect()]
    assert at("reference") == [0, 1] and at("sliding") == [0, 1, 2]
    with pytest.raises(ValueError):
        cooc.windows(four, 2, paragraphs=True)


@pytest.mark.parametrize("bad", ["Aaa <= Aaa.", "Aaa <= Bbb. Ccc <= Bbb.", "Aaa <= Bbb. Bbb <= Ccc."])
def test_alias_conflicts(spark, bad):
    with pytest.raises(ValueError):
        terms(spark, bad).collect()


def test_alias(spark):
    words = terms(spark, "Apple <= Pome fruit. Goat")
    found = match.matches(cooc.windows(docs(spark, "goats eat pome fruits"), 1), words, "stem")
    assert {r["term"] for r in found.collect()} == {"goat", "appl"}


def test_markup_sources_and_sinks(spark, tmp_path):
    text = "=:bob:= bill with some extra stuff.=:bill:= moot.=:whatever:= bob is a cool whatever guy."
    rows = readers.glossary(spark.createDataFrame([(text,)], "text string"))
    assert [(r["head"], r["definition"]) for r in rows.orderBy("ord").collect()] == [("bob", "bill with some extra stuff."), ("bill", "moot."), ("whatever", "bob is a cool whatever guy.")]
    assert writers.glossary_markup(rows).first()["value"].startswith("=:")
    with pytest.raises(ValueError):
        readers.glossary(spark.createDataFrame([("no head",)], "text string"))
    (tmp_path / "a.csv").write_text('" x ","two\nlines"\n')
    assert readers.csv_cells(spark, str(tmp_path / "a.csv"), ["a", "b"]).first().asDict() == {"a": "x", "b": "two\nlines"}
    (tmp_path / "a.txt").write_text("  one \n two\n")
    assert [r["line"] for r in readers.lines(spark, str(tmp_path / "a.txt")).collect()] == ["one", "two"]
    assert readers.format_of(("wal", "wikipedia_articles_list")) == "articles" and readers.format_of("tct") == "terms"
    with pytest.raises(ValueError):
        readers.format_of("nothing")
    with pytest.raises(ValueError):
        readers.check_form({"format": ["glossary"], "content": [" "]})
    assert readers.focus_terms("a, b,") == ["a", "b"]


def test_articles(spark):
    titles = readers.article_titles(spark.createDataFrame([("Apple. Goat#Use#Notes . ",)], "line string"))
    sections = spark.createDataFrame([("Apple", None, 0, "sum"), ("Apple", "Notes", 1, "no"), ("Apple", "Taste", 2, "sweet\nred"), ("Goat", None, 0, "s"), ("Goat", "Use", 1, "milk")], "title string, section string, ord int, text string")
    got = {r["page_id"]: r["text"] for r in readers.articles(titles, sections).collect()}
    assert got == {"Apple": "sum sweet\n\nred", "Goat#Use#Notes": "milk"}
    links = spark.createDataFrame([("Apple", "sweet"), ("Apple", "absent"), ("Apple", "1")], "page_id string, link string")
    assert [r["term"] for r in vocab.from_links(links, readers.articles(titles, sections)).collect()] == ["sweet"]


@pytest.fixture(scope="module")
def net(spark):
    words = terms(spark, "Apple. Goat. explore. crater sphere. moon")
    text = CONTENT + ". moon crater sphere. moon goats."
    return N.build(N.parse_content(docs(spark, text, "apples goats moon"), words), keep=100)


def test_network_properties(net):
    row = net.properties().first()
    assert row["cutoff"] == 1 and row["total_terms"] == 5 and len(row["included"]) == 5 and row["excluded"] == []


def test_session(net):
    s = Session.start(net).with_metric("PR").with_influence("positive", "linear").focus()
    assert s.ranks.groupBy("grp").sum("rank").first()[1] == pytest.approx(1.0)
    s = s.amplify("goats").dampen("Goat").highlight("Apple", "toggle")
    assert s.dampened == {"goat"} and not s.amplified and s.highlighted == {"appl"}
    after, shown = s.ignore("moon").search("Apple")
    names = {r["name"]: r for r in shown.nodes.collect()}
    assert after.previous == "Apple" and names and all(0 <= r["ranks"]["left"] <= 1 for r in names.values())
    assert all(r["stroke"] == "full" and 0 < r["distance"] <= 280 for r in shown.links.collect())
    total = shown.totals.first()
    assert total["size"] == len(names) and total["selection"] <= total["size"]
    assert s.reset().clean() and s.chart().count() == 5
    with pytest.raises(KeyError):
        s.amplify("nobody")
    with pytest.raises(ValueError):
        Session.start(net).focus()
    with pytest.raises(ValueError):
        s.with_influence("positive", "square")


def test_compare(spark, net):
    words = terms(spark, "Apple. Goat. planet")
    other = N.build(N.parse_content(docs(spark, "apples goats. planets apples."), words), keep=100)
    held = Sessions()
    held.put("A", Session.start(net))
    held.put("B", Session.start(other))
    both = held.get("A&B")
    groups = {r["term"]: r["groups"] for r in both.network.node_groups().collect()}
    assert groups["appl"] == ["left", "right"] and groups["planet"] == ["right"] and groups["moon"] == ["left"]
    assert both.network.facts.first()["total_terms"] == 6
    assert json.loads(writers.graph_json(both.network.display).first()["json"])
    focused = both.with_metric("BPR").focus("Apple")
    most = {r["grp"]: r["m"] for r in focused.ranks.groupBy("grp").agg({"rank": "max"}).withColumnRenamed("max(rank)", "m").collect()}
    assert most["left"] == pytest.approx(most["right"])


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    docs(spark, "apples goats. Goats moon", "moon goats").write.parquet(str(source))
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(str(source))
    query = cooc_stream.start(cooc_stream.stream_counts(stream, ["apples", "goats", "moon"]), "pairs_live", str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert {(r["src"], r["dst"]): r["cnt"] for r in spark.table("pairs_live").collect()}["goats", "moon"] == 2
