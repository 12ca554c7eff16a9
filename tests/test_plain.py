"""Graph operators against plain code on random graphs, and the entry points."""

import random

import pytest

from termweave.operators import graph as G
from termweave.operators import match
from termweave.operators import pagerank as P
from termweave.plans import build as B
from termweave.plans.session import Session
from termweave.sources import readers, writers


def random_arcs(seed, nodes, arcs):
    r = random.Random(seed)
    names = [f"n{i:02}" for i in range(nodes)]
    return sorted({tuple(r.sample(names, 2)) for _ in range(arcs)})


def out_of(arcs, kind):
    out = {}
    for a, b in arcs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
        if kind == "undirected":
            out[b].add(a)
    return out


def plain_distances(out):
    every = {}
    for start in out:
        dist, ring = {start: 0}, [start]
        while ring:
            ring = sorted({b for a in ring for b in out[a]} - dist.keys())
            dist |= dict.fromkeys(ring, max(dist.values()) + 1)
        every |= {(start, to): d for to, d in dist.items()}
    return every


def plain_clustering(out, kind):
    found = {}
    for n, near in out.items():
        closed, k = sum(b in out[a] for a in near for b in near if a != b), len(near)
        found[n] = closed / (k * (k - 1)) if k > 1 else 0.0
    return found


def plain_rank(out, biases, epochs):
    n = len(out)
    rank = dict.fromkeys(out, 1 / n)
    for _ in range(epochs):
        leak = sum(rank[a] for a in out if not out[a])
        got = dict.fromkeys(out, 0.0)
        for a, near in out.items():
            for b in near:
                got[b] += rank[a] / len(near)
        rank = {t: 0.15 / n + 0.85 * leak / n + 0.85 * got[t] * (1 + biases.get(t, 0.0)) for t in out}
        if biases:
            total = sum(rank.values())
            rank = {t: x / total for t, x in rank.items()}
    return rank


def make(spark, arcs, kind):
    return G.build(spark.createDataFrame(arcs, "src string, dst string"), kind).cut()


@pytest.mark.parametrize("kind", ["directed", "undirected"])
def test_graph_by_plain_code(spark, kind):
    arcs = [*random_arcs(1, 14, 30), ("x", "y"), ("y", "z")]
    out, g = out_of(arcs, kind), make(spark, arcs, kind)
    cc = plain_clustering(out, kind)
    assert {r["term"]: r["cc"] for r in G.clustering(g).collect()} == pytest.approx(cc)
    far = plain_distances(out)
    got = {(r["src"], r["dst"]): r["dist"] for r in G.all_distances(g).collect()}
    assert len(got) == len(out) ** 2 and got == {(a, b): far.get((a, b)) for a in out for b in out}
    ecc = {a: max(d for (x, _), d in far.items() if x == a) for a in out}
    assert {r["term"]: r["ecc"] for r in G.eccentricities(g, 2).collect()} == ecc
    start, limit, more, share = arcs[0][0], 1, 2, 0.5
    dist, ring = {start: 0}, [start]
    for step in range(1, limit + more + 1):
        ring = sorted({b for a in ring for b in out[a] if step <= limit or cc[b] * share >= cc[a]} - dist.keys())
        dist |= dict.fromkeys(ring, step)
    assert {r["term"]: r["dist"] for r in G.neighbourhood(g, start, limit, True, (more, share)).collect()} == dist
    inner = sorted(out)[:8]
    kept = {(a, b) for a, b in arcs if a in inner and b in inner}
    sub = G.sub_graph(g, spark.createDataFrame([(t,) for t in inner], "term string"))
    assert {tuple(sorted((r["src"], r["dst"]))) if kind == "undirected" else (r["src"], r["dst"]) for r in sub.links().collect()} == ({tuple(sorted(x)) for x in kept} if kind == "undirected" else kept)


@pytest.mark.parametrize("small", [P.SMALL, 0])
def test_pagerank_by_plain_code(spark, monkeypatch, small):
    """Arrays in one task and exchanges give the ranks of plain code: sinks, biases, several seeds, no epsilon."""
    monkeypatch.setattr(P, "SMALL", small)
    for kind, biases in (("directed", {}), ("undirected", {"n03": 0.5, "n07": 0.1})):
        arcs = random_arcs(2, 9, 14)
        out = out_of(arcs, kind)
        got = {r["term"]: r["rank"] for r in P.pagerank(make(spark, arcs, kind), biases, epsilon=0, epochs=3).collect()}
        assert got == pytest.approx(plain_rank(out, biases, 3)), kind
    g = make(spark, arcs, "undirected")
    seeds = spark.createDataFrame([("n01",), ("n03",), ("nobody",)], "term string")
    rows = {(r["seed"], r["term"]): r["rank"] for r in P.all_seeds(g, seeds, epsilon=0, epochs=2).collect()}
    assert rows == pytest.approx({(s, t): x for s in ("n01", "n03") for t, x in plain_rank(out, {s: 0.1}, 2).items()})
    close = {r["term"]: r["rank"] for r in P.pagerank(g, {"n01": 0.1}).collect()}
    assert sum(close.values()) == pytest.approx(1.0) and close == pytest.approx(plain_rank(out, {"n01": 0.1}, 50), abs=5e-3)


def test_matching_by_rows_and_by_join(spark, monkeypatch):
    r = random.Random(3)
    letters = "abcd"
    paths = sorted({" ".join(r.choice(letters) for _ in range(r.randrange(1, 4))) for _ in range(12)})
    vocab = spark.createDataFrame([(p.split(" "), p, len(p.split(" "))) for p in paths], "path array<string>, term string, n int")
    texts = [[r.choice([*letters, "the", "B"]) for _ in range(r.randrange(0, 12))] for _ in range(60)]
    windows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id bigint, win_ix int, words array<string>")
    expected = set()
    for i, words in enumerate(texts):
        low, at = [w.lower() for w in words], 0
        while at < len(low):
            n = max((n for n in (1, 2, 3) if " ".join(low[at : at + n]) in paths and at + n <= len(low)), default=0)
            if n:
                expected.add((i, at, n, " ".join(low[at : at + n]), " ".join(words[at : at + n])))
            at += n or 1
    for most in (match.ROW_PATHS, 0):
        monkeypatch.setattr(match, "ROW_PATHS", most)
        got = [(x["doc_id"], x["start"], x["n"], x["term"], x["surface"]) for x in match.matches(windows, vocab, "lower").collect()]
        assert len(got) == len(expected) and set(got) == expected, most


def test_build(spark, tmp_path):
    content = "Apples grow. Goats eat apples. Goats explore craters."
    net = B.build(spark, content, "tct", keep=100, terms="apple. goat. crater", how="stem")
    assert {(r["src"], r["dst"]) for r in net.display.links().collect()} == {("appl", "goat"), ("crater", "goat")}
    assert B.build(spark, "=:apple:= a goat.=:goat:= none", "glossary_csv", keep=100).display.links().count() == 1
    form = {"format": ["content-terms"], "content": [content], "terms": ["apple. goat. crater"]}
    assert B.build_form(spark, form, keep=100).display.links().count() == 2
    asked = []
    sections = spark.createDataFrame([("Apple", None, 0, "Sweet apple and red goat."), ("Goat", "Use", 1, "A red goat.")], "title string, section string, ord int, text string")
    links = spark.createDataFrame([("Apple", "red goat"), ("Apple", "Sweet apple"), ("Goat", "absent")], "title string, link string")

    def fetch(titles):
        asked.append(sorted(r["title"] for r in titles.collect()))
        return B.table_fetcher(sections, links)(titles)

    held = B.cached(fetch, str(tmp_path / "cache"))
    for _ in range(2):
        net = B.build(spark, "Apple. Goat#Use", "wal", keep=100, fetch=held, how="lower")
        assert {(r["src"], r["dst"]) for r in net.display.links().collect()} == {("red goat", "sweet apple")}
    assert B.build(spark, "Apple", "wal", keep=100, fetch=held, how="lower").display.links().count() == 1
    assert asked == [["Apple", "Goat"]]
    for bad in ({"window": 0}, {"separator": "page"}, {"keep": 101}, {"window": 2, "separator": "paragraph"}):
        with pytest.raises(ValueError):
            B.build(spark, content, "tct", terms="apple", **bad)
    with pytest.raises(ValueError):
        B.build(spark, "Nobody", "wal", fetch=held)
    with pytest.raises(ValueError):
        B.build(spark, content, "tct")
    with pytest.raises(ValueError):
        readers.format_of("html")


def test_sinks_and_radii(spark, tmp_path):
    net = B.build(spark, "a goat. a crater goat. crater apple goat.", "tct", keep=100, terms="goat. crater. apple", how="lower")
    rows = [r["json"] for r in writers.graph_json(net.display).where("kind = 'node'").collect()]
    assert sorted(rows) == [f'{{"id":"{t}","group":{i}}}' for i, t in enumerate(["apple", "crater", "goat"])]
    writers.adjacency_csv(net.display, str(tmp_path / "m"))
    writers.adjacency_csv(net.display, str(tmp_path / "s"), sparse=True)
    whole = spark.read.csv(str(tmp_path / "m"), header=True).collect()
    assert len(whole) == 3 and spark.read.csv(str(tmp_path / "s"), header=True).count() == 3 + 2 * net.display.links().count()
    radii = {r["name"]: r["radius"] for r in Session.start(net).radii(60.0).collect()}
    assert radii == pytest.approx(dict.fromkeys(radii, 20.0)) and {r["radius"] for r in Session.start(net).radii(1e6).collect()} == {50.0}
    assert G.log_size(net.display).first()[0] == pytest.approx(0.60206)
