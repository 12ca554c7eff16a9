import pytest

from termweave.operators import graph as G
from termweave.operators import pagerank as P

#: Small graphs whose results are known, here and below.
U = [("bobo", "jack"), ("bobo", "jill"), ("bobo", "jane"), ("jack", "colt"), ("jack", "colt"), ("alik", "peny")]
D = [*U, ("jane", "bobo")]


def make(spark, edges, kind="undirected"):
    return G.build(spark.createDataFrame(edges, "src string, dst string"), kind)


def values(df, key="term", value=None):
    value = value or [c for c in df.columns if c != key][0]
    return {r[key]: r[value] for r in df.collect()}


def test_builder(spark):
    g = make(spark, U)
    assert g.links().count() == 5 and g.nodes.count() == 7
    assert make(spark, D, "directed").links().count() == 6
    with pytest.raises(ValueError):
        make(spark, [("a", "a")])
    with pytest.raises(ValueError):
        make(spark, U, "both")


def test_eccentricity_and_diameter(spark):
    reached = G.distances(make(spark, U))
    assert values(G.eccentricity(reached)) == {"bobo": 2, "jack": 2, "jill": 3, "jane": 3, "colt": 3, "alik": 1, "peny": 1}
    assert G.diameter(reached).first()[0] == 3
    reached = G.distances(make(spark, D, "directed"))
    assert values(G.eccentricity(reached)) == {"bobo": 2, "jack": 1, "jill": 0, "jane": 3, "colt": 0, "alik": 1, "peny": 0}
    empty = make(spark, [])
    assert G.diameter(G.distances(empty)).first()[0] is None


def test_all_distances_has_nulls(spark):
    rows = {(r["src"], r["dst"]): r["dist"] for r in G.all_distances(make(spark, U)).collect()}
    assert len(rows) == 49 and rows["bobo", "alik"] is None and rows["jill", "colt"] == 3 and rows["jill", "jill"] == 0


def test_neighbourhood(spark):
    edges = [("bobo", "jack"), ("bobo", "jill"), ("bobo", "jane"), ("jack", "colt"), ("jill", "stew"), ("stew", "alik")]
    g = make(spark, edges, "directed")
    assert set(values(G.neighbourhood(g, "bobo", 1))) == {"jack", "jill", "jane"}
    assert set(values(G.neighbourhood(g, "bobo", 2))) == {"jack", "jill", "jane", "colt", "stew"}
    assert values(G.neighbourhood(g, "bobo", 0, True)) == {"bobo": 0}
    assert values(G.neighbourhood(g, "bobo", 0)) == {}
    with pytest.raises(KeyError):
        G.neighbourhood(g, "nobody")


def test_clustering_and_expansion(spark):
    star = [("bobo", "jack"), ("bobo", "jill"), ("bobo", "jane")]
    assert set(values(G.clustering(make(spark, star))).values()) == {0.0}
    chord = make(spark, [*star, ("jack", "jill")])
    cc = values(G.clustering(chord))
    assert cc["bobo"] == pytest.approx(1 / 3) and cc["jack"] == cc["jill"] == 1.0 and cc["jane"] == 0.0
    assert set(values(G.neighbourhood(chord, "bobo", 0, False, (1, 0.34)))) == {"jack", "jill"}
    assert values(G.neighbourhood(chord, "bobo", 0, False, (1, 0.32))) == {}
    directed = make(spark, [*star, ("jack", "jill"), ("jill", "jack")], "directed")
    assert values(G.clustering(directed))["bobo"] == pytest.approx(2 / 6)


@pytest.mark.parametrize("limit", [P.SMALL, 0])
def test_pagerank(spark, monkeypatch, limit):
    monkeypatch.setattr(P, "SMALL", limit)
    got = values(P.pagerank(make(spark, D, "directed")))
    for term, rank in {"bobo": 0.190, "jack": 0.131, "jill": 0.131, "jane": 0.131, "colt": 0.190, "alik": 0.078, "peny": 0.144}.items():
        assert got[term] == pytest.approx(rank, abs=1e-3)
    if limit:
        got = values(P.pagerank(make(spark, U)))
        for term, rank in {"bobo": 0.256, "jack": 0.174, "jill": 0.093, "jane": 0.093, "colt": 0.096, "alik": 0.142, "peny": 0.142}.items():
            assert got[term] == pytest.approx(rank, abs=1e-3)
        got = values(P.pagerank(make(spark, U), {"jack": 0.5}))
        for term, rank in {"bobo": 0.2595, "jack": 0.2638, "jill": 0.0868, "colt": 0.1233, "alik": 0.0899}.items():
            assert got[term] == pytest.approx(rank, abs=1e-3)


def test_metrics_and_matrix(spark):
    g = make(spark, U)
    for name in ("PR", "IPR", "CC", "ICC"):
        assert sum(values(P.metric(g, name)).values()) == pytest.approx(1.0, abs=0.01)
    with pytest.raises(ValueError):
        P.metric(g, "IBPR", ["bobo", "jack"])
    rows = {r["row"]: r.asDict() for r in G.adjacency_matrix(g).collect()}
    assert rows["bobo"]["bobo"] == 1 and rows["colt"]["jack"] == 1 and rows["colt"]["bobo"] == 0
    assert {(r["src"], r["dst"]) for r in G.walk(g, "colt", 2).links().collect()} == {("bobo", "jack"), ("colt", "jack")}
