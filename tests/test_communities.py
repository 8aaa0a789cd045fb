"""Triples, communities and the triple graph on small literal and seeded graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from triloom.operators import communities as C
from triloom.operators import similarity as S
from triloom.operators.components import components
from triloom.operators.graph import canonical_edges, node_profile
from triloom.runtime import cut
from triloom.sources import generators as G


def graph(spark, pairs):
    return canonical_edges(spark.createDataFrame(list(pairs) or [], "src bigint, dst bigint"))


def sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["community_id"], set()).add(r["node"])
    return sorted(map(sorted, out.values()))


def found(spark, pairs, t):
    return sets(C.get_communities(graph(spark, pairs), S.closed_neighborhood_jaccard(t)))


TRIANGLE = [(1, 2), (2, 3), (1, 3)]
DIAMOND = [*TRIANGLE, (3, 4), (2, 4)]
BOWTIE = [*TRIANGLE, (3, 4), (4, 5), (3, 5)]
K4S = [p for c in ((1, 2, 3, 4), (4, 5, 6, 7)) for p in itertools.combinations(c, 2)]
BRIDGE = [tuple(map(int, x.split("-"))) for x in (
    "1-2 1-3 1-4 2-3 2-4 3-4 1-5 2-5 3-5 2-6 3-6 4-6 1-7 2-7 3-7 3-8 4-8 5-8 4-9 3-9 6-9 2-10 3-10 7-10 "
    "11-12 11-13 11-14 12-13 12-14 13-14 11-15 12-15 13-15 12-16 13-16 14-16 11-17 12-17 14-17 13-18 14-18 15-18 9-11 9-12 9-13 10-12 10-13 10-14"
).split()]


def er(n, p, seed):
    r = random.Random(seed)
    return [e for e in itertools.combinations(range(n), 2) if r.random() < p]


@pytest.mark.parametrize(
    ("pairs", "t", "want"),
    [
        (TRIANGLE, 0.5, [[1, 2, 3]]), (TRIANGLE, 1.0, [[1, 2, 3]]), (DIAMOND, 0.5, [[1, 2, 3, 4]]), (DIAMOND, 0.6, [[1, 2, 3, 4]]), (DIAMOND, 0.8, []),
        ([*TRIANGLE, (4, 5), (5, 6), (4, 6)], 0.5, [[1, 2, 3], [4, 5, 6]]), ([(1, 2), (2, 3)], 0.3, [[1, 2, 3]]), ([(1, 2), (2, 3)], 0.4, []),
        (BOWTIE, 0.5, [[1, 2, 3], [3, 4, 5]]), (BOWTIE, 0.7, []), (BRIDGE, 0.3, [list(range(1, 11)), list(range(9, 19))]),
        (BRIDGE, 0.5, [[1, 2, 3, 4, 5, 6, 7], [11, 12, 13, 14, 15, 17]]), (BRIDGE, 0.85, []), ([], 0.1, []), ([(0, 1)], 0.0, []),
    ],
)
def test_literal_graphs(spark, pairs, t, want):
    assert found(spark, pairs, t) == want


def test_open_jaccard_and_order(spark):
    e = graph(spark, K4S)
    t = cut(C.admissible_triples(e, S.open_neighborhood_jaccard(0.25)))
    assert t.count() == 8
    c = C.communities_of_triples(t)
    assert sets(c) == [[1, 2, 3, 4], [4, 5, 6, 7]]
    order = C.community_order(t, c).orderBy("rank").collect()
    assert [r["community_id"] for r in order] == ["1-2", "4-5"]


@pytest.mark.parametrize(("pairs", "t", "want"), [(DIAMOND, 0.5, (4, 6, 6)), (DIAMOND, 0.6, (2, 1, 1)), (K4S, 0.5, (8, 12, 12)), (er(50, 0.18, 6), 0.2, (160, 310, 725))])
def test_hypergraph_sizes(spark, pairs, t, want):
    tr = cut(C.admissible_triples(graph(spark, pairs), S.closed_neighborhood_jaccard(t)))
    r = C.hypergraph_size(tr).first()
    assert (r["h_nodes"], r["star_edges"], r["clique_edges"]) == want
    assert C.hyper_edges(tr, "star").count() == want[1]
    assert C.hyper_edges(tr, "clique").count() == want[2]
    assert C.hyper_degrees(tr, "clique").agg(F.sum("degree")).first()[0] == 2 * want[2]
    assert C.hyper_degrees(tr, "star").agg(F.sum("degree")).first()[0] == 2 * want[1]


@pytest.mark.parametrize(("sizes", "zs", "t", "want"), [([20] * 3, [6] * 3, 0.2, (540, 360, 840, 2040)), ([30, 20, 10], [8, 6, 4], 0.3, (700, 250, 550, 1230))])
def test_ring_lattices(spark, sizes, zs, t, want):
    rings = G.shape_rings(spark, [("a", sizes, zs)])
    e = G.ring_lattice(rings).select("src", "dst")
    tr = cut(C.admissible_triples(e, S.closed_neighborhood_jaccard(t)))
    r = C.hypergraph_size(tr).first()
    assert (C.candidate_triples(e).count(), r["h_nodes"], r["star_edges"], r["clique_edges"]) == want
    truth = {}
    for x in G.ring_truth(rings).collect():
        truth.setdefault(x["community_id"], []).append(x["node"])
    assert sets(C.communities_of_triples(tr)) == sorted(map(sorted, truth.values()))


def brute(pairs, t):
    nbrs = {}
    for a, b in pairs:
        nbrs.setdefault(a, set()).add(b)
        nbrs.setdefault(b, set()).add(a)
    j = lambda a, b: len((nbrs[a] | {a}) & (nbrs[b] | {b})) / len(nbrs[a] | {a} | nbrs[b] | {b})
    tri = set()
    for c, ns in nbrs.items():
        for x, y in itertools.combinations(sorted(ns), 2):
            k = tuple(sorted((c, x, y)))
            if all(j(*p) >= t for p in itertools.combinations(k, 2)):
                tri.add(k)
    comp = []
    for k in tri:
        mine = [{p for p in itertools.combinations(k, 2)}, set(k)]
        rest = []
        for ps, ns in comp:
            if ps & mine[0]:
                mine = [mine[0] | ps, mine[1] | ns]
            else:
                rest.append((ps, ns))
        comp = [*rest, tuple(mine)]
    return sorted(sorted(ns) for _, ns in comp)


@pytest.mark.parametrize(("n", "p", "seed", "t"), [(40, 0.15, 0, 0.1), (35, 0.35, 1, 0.3), (45, 0.16, 3, 0.2)])
def test_random_graphs_all_ways(spark, n, p, seed, t):
    pairs = er(n, p, seed)
    e = graph(spark, pairs)
    pred = S.closed_neighborhood_jaccard(t)
    tr = cut(C.admissible_triples(e, pred))
    want = brute(pairs, t)
    assert sets(C.communities_of_triples(tr)) == want
    assert sets(C.communities_of_triples(tr)) == want
    multi = e.withColumn("g", F.explode(F.array(F.lit("a"), F.lit("b"))))
    both = C.get_communities(multi, pred, by=["g"])
    for g in "ab":
        assert sets(both.where(F.col("g") == g)) == want


def test_local_community(spark):
    pairs = er(50, 0.18, 6)
    e = graph(spark, pairs)
    got = sorted(r[0] for r in C.get_node_community(e, S.closed_neighborhood_jaccard(0.2), 1).collect())
    assert len(got) == 45
    assert {23, 25, 47} <= set(got)
    with pytest.raises(ValueError, match="not in the graph"):
        C.get_node_community(e, S.closed_neighborhood_jaccard(0.2), 99)
    chain = graph(spark, [p for i in range(0, 12, 1) for p in ((i, i + 1), (i, i + 2))])  # a long community, so the ball has to grow
    far = C.get_node_community(chain, S.closed_neighborhood_jaccard(0.3), 0)
    assert sorted(r[0] for r in far.collect()) == sets(C.get_communities(chain, S.closed_neighborhood_jaccard(0.3)))[0]
    alone = spark.createDataFrame([(7,)], "node bigint")
    assert C.get_node_community(graph(spark, TRIANGLE), S.closed_neighborhood_jaccard(0.0), 7, alone).count() == 0


def test_thresholds_are_nested(spark):
    e = graph(spark, BRIDGE)
    c = C.threshold_communities(e, [0.3, 0.5, 0.85])
    got = {}
    for r in c.collect():
        got.setdefault(r["threshold"], set()).add((r["community_id"], r["node"]))
    assert set(got) == {0.3, 0.5}
    assert {n for _, n in got[0.5]} <= {n for _, n in got[0.3]}


def test_predicates(spark):
    e = graph(spark, K4S)
    assert C.admissible_triples(e, S.constant(True)).count() == C.candidate_triples(e).count()
    assert C.admissible_triples(e, S.constant(False)).count() == 0
    column = S.NodePredicate(lambda u, v: F.size(F.array_intersect(u.neighbors, v.neighbors)) >= 1)
    python = S.PythonPredicate(lambda u, v: len(u.neighbors & v.neighbors) >= 1)
    want = sorted(map(tuple, S.common_neighbors(1).qualified(e).select("x", "y").collect()))
    for p in (column, python):
        assert sorted(map(tuple, p.qualified(e).select("x", "y").collect())) == want

    def bad(u, v):
        raise RuntimeError("no")

    with pytest.raises(Exception, match="no"):
        S.PythonPredicate(bad).qualified(e).collect()
    with pytest.raises(TypeError, match="callable"):
        S.NodePredicate(3)
    with pytest.raises(TypeError):
        C.validate_graph("graph", S.constant(True))
    with pytest.raises(ValueError, match="mode"):
        C.validate_graph(e, S.constant(True), "ring")


def test_dirty_edges(spark):
    e = spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (1, 2, "z"), (None, 3, "n"), (3, None, "n")], "src bigint, dst bigint, center string")
    assert canonical_edges(e).collect() == [(1, 2)]
    words = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c")], "src string, dst string")
    assert sets(C.get_communities(canonical_edges(words), S.closed_neighborhood_jaccard(0.5))) == [["a", "b", "c"]]
    lone = spark.createDataFrame([(9,)], "node bigint")
    assert node_profile(graph(spark, TRIANGLE), lone).first()["degree"] == 0


def test_hub_is_dealt(spark):
    from triloom.operators.graph import adjacency, wedges

    star = graph(spark, [(0, i) for i in range(1, 40)])
    assert wedges(adjacency(star), hub=5).count() == 39 * 38 // 2


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 1)], "a bigint, b bigint")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert {roots[i] for i in range(31)} == {0}
    assert {roots[i] for i in range(100, 140)} == {100}
    words = spark.createDataFrame([("b", "a"), ("c", "b"), ("é", "z")], "a string, b string")
    assert {r["node"]: r["root"] for r in components(words).collect()} == {"a": "a", "b": "a", "c": "a", "z": "z", "é": "z"}
    assert components(links.where("a < 0")).count() == 0


def test_thresholds(spark):
    e = graph(spark, DIAMOND)
    assert S.avg_threshold(e).first()[0] == pytest.approx((0.75 * 4 + 1 + 0.5) / 6)
    got = [r[0] for r in S.representative_thresholds(e).collect()]
    assert got == sorted(got)
    assert {0.0, 1.0, 0.75, 0.5} <= set(got)
    with pytest.raises(Exception, match="division by zero"):
        S.avg_threshold(e.where("src < 0")).collect()


def test_baselines(spark):
    from triloom.operators import baselines as B

    e = graph(spark, [*K4S[:6], (10, 11), (11, 12), (10, 12)])
    lpa = B.label_propagation(e).collect()
    assert len({r["community_id"] for r in lpa}) == 2
    assert B.speaker_listener(e, rounds=4).count() >= 7
    assert B.ego_communities(e).count() >= 3


def test_degree_bound_loses_no_pair(spark):
    r = random.Random(5)
    edges = [(0, i) for i in range(1, 120)] + [(r.randrange(120), r.randrange(120)) for _ in range(500)] + [(200, 201), (201, 202)]
    e = graph(spark, edges)
    whole = {(x["x"], x["y"]): x["jaccard"] for x in S.pair_similarity(e).collect()}
    for least in (0.05, 0.25, 1 / 3, 0.5, 0.9, 1.0):
        got = {(x["x"], x["y"]): x["jaccard"] for x in S.pair_similarity(e, least_jaccard=least).collect()}
        assert got == {k: v for k, v in whole.items() if v >= least}


def test_user_measure(spark):
    e = graph(spark, [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5)])
    same = lambda u, v: len((u.neighbors | {u.id}) & (v.neighbors | {v.id})) / len(u.neighbors | {u.id} | v.neighbors | {v.id})
    assert S.avg_threshold(e, 0.6, same).first()[0] == pytest.approx(S.avg_threshold(e, 0.6).first()[0])
    assert [x[0] for x in S.representative_thresholds(e, measure=same).collect()] == pytest.approx([x[0] for x in S.representative_thresholds(e).collect()])


def test_triangles(spark):
    from triloom.operators.graph import triangles

    r = random.Random(9)
    pairs = [(0, i) for i in range(1, 60)] + [(r.randrange(60), r.randrange(60)) for _ in range(250)]
    e = graph(spark, pairs)
    links = {(x["src"], x["dst"]) for x in e.collect()}
    want = {(a, b, c) for a, b in links for c in range(60) if (b, c) in links and (a, c) in links}
    got = [tuple(sorted(x)) for x in triangles(e).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert triangles(graph(spark, [(1, 2)])).count() == 0
