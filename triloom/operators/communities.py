"""Overlapping communities: components of triples that share two nodes.

A triple of nodes counts if one of them is adjacent to the other two and all three
pairs pass the predicate. Two triples are linked if they share two nodes. The
components are found on the graph of *pairs*, where each triple links its three pairs:
it has the same components with two links per triple, and the triple graph is never
built. The legs of a triple are filtered by the predicate before the wedge join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.operators.components import contract
from triloom.operators.graph import adjacency, node_table, wedges
from triloom.runtime import cut

def _sorted3(a, b, c) -> list[F.Column]:
    s = F.sort_array(F.array(a, b, c))
    return [s[0].alias("a"), s[1].alias("b"), s[2].alias("c")]


def candidate_triples(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by``, a < b < c, n_edges (2 or 3): triples with a center, each once."""
    w = wedges(adjacency(edges, by), by)
    link = edges.select(*by, F.col("src").alias("x"), F.col("dst").alias("y"), F.lit(1).alias("closed"))
    t = w.join(link, [*by, "x", "y"], "left").where("closed IS NULL OR center < x")
    return t.select(*by, *_sorted3(F.col("center"), F.col("x"), F.col("y")), (F.lit(2) + F.coalesce("closed", F.lit(0))).alias("n_edges"))


def admissible_triples(edges: DataFrame, predicate, nodes: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``by``, a < b < c, n_edges, strength (the least of the pairs'), center, x, y (the order key)."""
    q = cut(predicate.qualified(edges, nodes, by))
    legs = q.where("adjacent = 1").select(*by, F.col("x").alias("src"), F.col("y").alias("dst"), "strength")
    both = legs.select(*by, F.col("src").alias("node"), F.col("dst").alias("nbr"), "strength").unionAll(
        legs.select(*by, F.col("dst").alias("node"), F.col("src").alias("nbr"), "strength")
    )
    w = wedges(both, by, keep=["strength"])
    t = w.join(q.select(*by, "x", "y", "adjacent", "strength"), [*by, "x", "y"]).where("adjacent = 0 OR center < x")
    return t.select(
        *by, *_sorted3(F.col("center"), F.col("x"), F.col("y")), (F.lit(2) + F.col("adjacent")).alias("n_edges"),
        F.least("strength_x", "strength_y", "strength").alias("strength"), "center", "x", "y",
    )


def triple_pairs(triples: DataFrame, by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Each triple three times, once for each of its pairs: ``by``, x, y, a, b, c and kept columns."""
    pair = lambda p, q: F.struct(F.col(p).alias("x"), F.col(q).alias("y"))
    return triples.select(*by, "a", "b", "c", *keep, F.explode(F.array(pair("a", "b"), pair("a", "c"), pair("b", "c"))).alias("p")).select(
        *by, "p.x", "p.y", "a", "b", "c", *keep
    )


def _pair(x: str, y: str, by: Sequence[str]) -> F.Column:
    return F.struct(*[F.col(c).alias(c) for c in by], F.col(x).alias("x"), F.col(y).alias("y"))


def communities_of_triples(triples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by``, community_id, node. The id is the smallest pair of the component, ``x-y``.

    Communities of equal members keep their own ids. All graphs go through one contraction.
    """
    t = cut(triples.select(*by, "a", "b", "c"))
    links = t.select(F.inline(F.array(
        F.struct(_pair("a", "b", by).alias("p"), _pair("a", "c", by).alias("q")), F.struct(_pair("a", "b", by).alias("p"), _pair("b", "c", by).alias("q")),
    )))
    roots = contract(links, "p", "q")
    ab = t.select(_pair("a", "b", by).alias("node"), "a", "b", "c").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    out = ab.select(*[F.col(f"root.{c}").alias(c) for c in by], F.concat_ws("-", "root.x", "root.y").alias("community_id"), F.explode(F.array("a", "b", "c")).alias("node"))
    return out.distinct()


def get_communities(edges: DataFrame, predicate, nodes: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """All communities of a graph: ``by``, community_id, node. Nodes in none are absent."""
    return communities_of_triples(admissible_triples(edges, predicate, nodes, by), by)


def community_order(triples: DataFrame, communities: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by``, community_id, rank: communities in the order in which their first triple is met.

    Centers and neighbours are taken in ascending order of id.
    """
    inside = triples.join(communities.select(*by, "community_id", F.col("node").alias("a")), [*by, "a"])
    for k in "bc":
        inside = inside.join(communities.select(*by, "community_id", F.col("node").alias(k)), [*by, "community_id", k])
    first = inside.groupBy(*by, "community_id").agg(F.min(F.struct("center", "x", "y")).alias("first"))
    from pyspark.sql import Window

    return first.select(*by, "community_id", F.row_number().over(Window.partitionBy(*by).orderBy("first")).alias("rank"))


class _Within:
    """A predicate on the pairs whose both nodes lie in a ball."""

    def __init__(self, predicate, ball: DataFrame):
        self.predicate, self.ball = predicate, ball

    def qualified(self, edges: DataFrame, nodes: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
        q = self.predicate.qualified(edges, nodes, by)
        for s in "xy":
            q = q.join(self.ball.select(F.col("node").alias(s)), s, "left_semi")
        return q


def _around(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes and their neighbours."""
    return nodes.select("node").unionAll(adj.join(nodes, "node", "left_semi").select(F.col("nbr").alias("node"))).distinct()


def _first_triple(t: DataFrame, seed) -> DataFrame:
    s = F.lit(seed)
    mine = t.where((F.col("a") == s) | (F.col("b") == s) | (F.col("c") == s))
    rest = F.array_sort(F.filter(F.array("a", "b", "c"), lambda n: n != s))
    centered = (F.col("n_edges") == 3) | (F.col("center") == s)
    key = F.when(centered, F.struct(F.lit(0).alias("k"), rest[0].alias("u"), rest[1].alias("v")))
    other = F.when(rest[0] == F.col("center"), rest[1]).otherwise(rest[0])
    key = key.otherwise(F.struct(F.lit(1).alias("k"), F.col("center").alias("u"), other.alias("v")))
    return mine.orderBy(key).limit(1)


def _expand(t: DataFrame, seed) -> DataFrame:
    """a, b, c: the triples reached from the seed's first one over shared pairs."""
    pairs = cut(triple_pairs(t))
    members = cut(_first_triple(t, seed).select("a", "b", "c"))
    frontier = cut(triple_pairs(members).select("x", "y").distinct())
    done = frontier
    while frontier.take(1):
        found = pairs.join(frontier, ["x", "y"]).select("a", "b", "c").distinct()
        members = cut(members.unionAll(found).distinct())
        frontier = cut(triple_pairs(found).select("x", "y").distinct().join(done, ["x", "y"], "left_anti"))
        done = cut(done.unionAll(frontier))
    return members


def get_node_community(edges: DataFrame, predicate, seed, nodes: DataFrame | None = None) -> DataFrame:
    """node: one community that contains ``seed``, by expanding from its first triple; empty if it is in none.

    The first triple is the first with the seed as center, else the first path seed - u -
    k, neighbours in ascending order. Only a ball around the seed is looked at: its
    triples are expanded pair by pair, pairs once visited are left out, and the ball grows
    until it holds all neighbours of the members. The cost follows the community, not
    the graph. A seed that is no node raises.
    """
    if not node_table(edges, nodes).where(F.col("node") == F.lit(seed)).take(1):
        raise ValueError(f"node {seed!r} is not in the graph")
    adj = adjacency(edges)
    start = node_table(edges, nodes).where(F.col("node") == F.lit(seed))
    ball = cut(_around(adj, _around(adj, start)))
    while True:
        # all edges at nodes of the ball: their degrees and common neighbours are exact
        near = adj.join(ball, "node", "left_semi")
        near = near.select(F.least("node", "nbr").alias("src"), F.greatest("node", "nbr").alias("dst")).distinct()
        t = cut(admissible_triples(cut(near), _Within(predicate, ball), nodes).select("a", "b", "c", "center", "n_edges", "x", "y"))
        members = _expand(t, seed).select(F.explode(F.array("a", "b", "c")).alias("node")).distinct()
        reach = cut(_around(adj, members))
        if not reach.join(ball, "node", "left_anti").take(1):
            return members
        ball = cut(ball.unionAll(reach).distinct())


# -- the triple graph itself ---------------------------------------------------------


def hyper_edges(triples: DataFrame, mode: str = "star", by: Sequence[str] = ()) -> DataFrame:
    """Links of the triple graph: ``by``, a1, b1, c1, a2, b2, c2, x, y (the shared pair).

    ``star`` links each later triple of a pair to the first one met, ``clique`` to all.
    """
    if mode not in ("star", "clique"):
        raise ValueError("mode must be 'star' or 'clique'")
    p = triple_pairs(triples, by, keep=["center"]).select(
        *by, "x", "y", "a", "b", "c",
        F.struct(F.col("center").alias("k"), F.when(F.col("a") == F.col("center"), F.col("b")).otherwise(F.col("a")).alias("i"),
                 F.when(F.col("c") == F.col("center"), F.col("b")).otherwise(F.col("c")).alias("j")).alias("key"),
    )
    if mode == "star":
        first = p.groupBy(*by, "x", "y").agg(F.min_by(F.struct("a", "b", "c"), "key").alias("f"))
        links = p.join(first, [*by, "x", "y"]).where("NOT (a = f.a AND b = f.b AND c = f.c)")
        return links.select(*by, F.col("f.a").alias("a1"), F.col("f.b").alias("b1"), F.col("f.c").alias("c1"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("c").alias("c2"), "x", "y")
    left = p.select(*by, "x", "y", F.col("a").alias("a1"), F.col("b").alias("b1"), F.col("c").alias("c1"), F.col("key").alias("k1"))
    right = p.select(*by, "x", "y", F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("c").alias("c2"), F.col("key").alias("k2"))
    return left.join(right, [*by, "x", "y"]).where("k1 < k2").drop("k1", "k2")


def hypergraph_size(triples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by``, h_nodes, star_edges, clique_edges from the number m of triples on each pair: sum(m - 1), sum(m (m - 1) / 2)."""
    m = triple_pairs(triples, by).groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("m"))
    return m.groupBy(*by).agg(
        F.floor(F.coalesce(F.sum("m"), F.lit(0)) / 3).cast("bigint").alias("h_nodes"),
        F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("star_edges"),
        F.coalesce(F.sum((F.col("m") * (F.col("m") - 1) / 2).cast("bigint")), F.lit(0)).alias("clique_edges"),
    )


def hyper_degrees(triples: DataFrame, mode: str = "star", by: Sequence[str] = ()) -> DataFrame:
    """``by``, a, b, c, degree of every triple in the triple graph, without building the clique."""
    if mode == "clique":
        p = triple_pairs(triples, by)
        m = p.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("m"))
        return p.join(m, [*by, "x", "y"]).groupBy(*by, "a", "b", "c").agg(F.sum(F.col("m") - 1).alias("degree"))
    e = hyper_edges(triples, "star", by)
    ends = e.select(*by, F.col("a1").alias("a"), F.col("b1").alias("b"), F.col("c1").alias("c")).unionAll(
        e.select(*by, F.col("a2").alias("a"), F.col("b2").alias("b"), F.col("c2").alias("c"))
    )
    counted = ends.groupBy(*by, "a", "b", "c").agg(F.count(F.lit(1)).alias("degree"))
    return triples.select(*by, "a", "b", "c").join(counted, [*by, "a", "b", "c"], "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))


def degree_set(degrees: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by``, degree_set: the distinct degrees as ``{d1,d2}``, ``{}`` if there is none."""
    s = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_set("degree")), lambda d: d.cast("string")), ","), F.lit("}"))
    return degrees.groupBy(*by).agg(s.alias("degree_set"))


def threshold_report(edges: DataFrame, thresholds: Sequence[float], mode: str = "star") -> DataFrame:
    """threshold, h_nodes, star_edges, clique_edges, degree_set (of ``mode``): the triples are found once, at the least threshold."""
    from triloom.operators.similarity import closed_neighborhood_jaccard

    t = cut(admissible_triples(edges, closed_neighborhood_jaccard(min(thresholds))))
    grid = F.array(*[F.lit(float(x)) for x in sorted(set(thresholds))])
    at = t.select("*", F.explode(F.filter(grid, lambda g: g <= F.col("strength"))).alias("threshold"))
    return hypergraph_size(at, ["threshold"]).join(degree_set(hyper_degrees(at, mode, ["threshold"]), ["threshold"]), "threshold", "left")


def threshold_communities(edges: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by``, threshold, community_id, node of every threshold, from one search for triples."""
    from triloom.operators.similarity import closed_neighborhood_jaccard

    t = cut(admissible_triples(edges, closed_neighborhood_jaccard(min(thresholds)), by=by).select(*by, "a", "b", "c", "strength"))
    grid = F.array(*[F.lit(float(x)) for x in sorted(set(thresholds))])
    at = t.select("*", F.explode(F.filter(grid, lambda g: g <= F.col("strength"))).alias("threshold"))
    return communities_of_triples(at, [*by, "threshold"])


def validate_graph(edges, predicate, mode: str = "star") -> None:
    """The checks a caller relies on: a graph table, a predicate, a known mode."""
    if not isinstance(edges, DataFrame) or not {"src", "dst"} <= set(edges.columns):
        raise TypeError("the graph must be an edge DataFrame with src and dst")
    if not hasattr(predicate, "qualified"):
        raise TypeError("the predicate must be callable on node pairs")
    if mode not in ("star", "clique"):
        raise ValueError("mode must be 'star' or 'clique'")


def node_overlap(communities: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by``, node, n_communities."""
    return communities.groupBy(*by, "node").agg(F.count(F.lit(1)).alias("n_communities"))


