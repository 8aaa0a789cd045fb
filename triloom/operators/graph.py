"""Undirected simple graphs as edge tables; every operator takes ``by``, columns that tell graphs apart.

Edges are ``src < dst``, distinct, without self-loops (loops and repeated edges of an
input are dropped, null ends as well). Ids are any orderable type.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.runtime import forget, release, settle

#: A center with more neighbours than this is dealt to several tasks in the wedge join.
HUB_DEGREE = 2000
#: Edges whose lists are broadcast at once when triangles are made.
ROUND_EDGES = 4_000_000


def canonical_edges(df: DataFrame, src: str = "src", dst: str = "dst", by: Sequence[str] = ()) -> DataFrame:
    """``by``, src, dst with src < dst; loops, nulls and repetitions dropped."""
    e = df.select(*by, F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"), F.col(src).isNotNull().alias("__a"), F.col(dst).isNotNull().alias("__b"))
    return e.where("__a AND __b AND src < dst").select(*by, "src", "dst").distinct()


def adjacency(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by``, node, nbr: both directions of every edge."""
    one = edges.select(*by, F.col("src").alias("node"), F.col("dst").alias("nbr"))
    return one.unionAll(edges.select(*by, F.col("dst").alias("node"), F.col("src").alias("nbr")))


def node_table(edges: DataFrame, nodes: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``by``, node: ends of edges and, if given, the nodes of ``nodes`` (isolated ones too)."""
    n = adjacency(edges, by).select(*by, "node")
    return (n if nodes is None else n.unionByName(nodes.select(*by, "node"))).distinct()


def degrees(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return adjacency(edges, by).groupBy(*by, "node").agg(F.count(F.lit(1)).alias("degree"))


def node_profile(edges: DataFrame, nodes: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``by``, node, neighbors (sorted array), degree: what a user predicate sees of a node."""
    p = adjacency(edges, by).groupBy(*by, "node").agg(F.sort_array(F.collect_set("nbr")).alias("neighbors"))
    if nodes is not None:
        p = nodes.select(*by, "node").distinct().join(p, [*by, "node"], "left")
        kind = edges.schema["src"].dataType
        p = p.withColumn("neighbors", F.coalesce("neighbors", F.array().cast(f"array<{kind.simpleString()}>")))
    return p.withColumn("degree", F.size("neighbors"))


def wedges(adj: DataFrame, by: Sequence[str] = (), keep: Sequence[str] = (), hub: int = HUB_DEGREE, size: str | None = None, ratio: float = 0.0) -> DataFrame:
    """Every pair of neighbours x < y of a common center: ``by``, center, x, y and kept columns as <c>_x, <c>_y.

    A center with more than ``hub`` neighbours is dealt: its left side is salted by the
    neighbour, its right side repeated for every salt, so that its pairs are made in
    several tasks. Other centers have one salt and are not repeated.

    With ``size`` (a kept column, a degree) and ``ratio`` only pairs are joined whose sizes
    plus 1 lie in the same or a neighbouring class of a geometric scale of that ratio; all
    pairs with (min + 1) / (max + 1) >= ratio are among them.
    """
    deals = adj.groupBy(*by, "node").agg(F.ceil(F.count(F.lit(1)) / F.lit(hub)).cast("int").alias("__deals"))
    dealt = adj.join(deals, [*by, "node"])
    left = dealt.select(*by, "node", F.col("nbr").alias("x"), *[F.col(c).alias(f"{c}_x") for c in keep], F.pmod(F.hash("nbr"), F.col("__deals")).alias("__salt"))
    right = dealt.select(
        *by, "node", F.col("nbr").alias("y"), *[F.col(c).alias(f"{c}_y") for c in keep],
        F.explode(F.sequence(F.lit(0), F.col("__deals") - 1)).alias("__salt"),
    )
    on = [*by, "node", "__salt"]
    if size is not None and 0 < ratio < 1:
        scale = lambda c: F.floor(F.log(F.col(c).cast("double") + 1) / F.lit(-math.log(ratio) * (1 + 1e-9))).cast("int")
        left = left.withColumn("__class", scale(f"{size}_x"))
        right = right.withColumn("__class", F.explode(F.array(*[scale(f"{size}_y") + F.lit(k) for k in (-1, 0, 1)])))
        on = [*on, "__class"]
    joined = left.join(right, on).where("x < y")
    return joined.select(*by, F.col("node").alias("center"), "x", "y", *[f"{c}_{s}" for c in keep for s in "xy"])


def out_lists(edges: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """A settled table ``by``, node, nbrs with each of the m edges at one of its ends, and m.

    It is the end that comes first: nodes go by id, after them those with more than
    sqrt(2 m) edges (``HUB_DEGREE`` at least), by degree. There are at most sqrt(2 m) of
    these, so no list is longer than that bound.
    """
    by = list(by)
    listed = lambda rows, a, b: settle(rows.groupBy(*by, F.col(a).alias("node")).agg(F.collect_list(b).alias("nbrs")), m=F.sum(F.size("nbrs")))
    lists, seen = listed(edges, "src", "dst")
    release(edges.sparkSession)
    m = seen["m"] or 0
    most = max(HUB_DEGREE, math.isqrt(2 * m))
    if m <= most:
        return lists, m
    pairs = lists.select(*by, F.col("node").alias("src"), F.explode("nbrs").alias("dst"))
    own = lists.select(*by, "node", F.size("nbrs").cast("bigint").alias("n"))
    ends = own.unionAll(pairs.groupBy(*by, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")))
    hubs, seen = settle(ends.groupBy(*by, "node").agg(F.sum("n").alias("degree")).where(F.col("degree") > most), hubs=F.count(F.lit(1)))
    release(edges.sparkSession)
    if not seen["hubs"]:
        return lists, m
    for end in ("src", "dst"):
        known = hubs.select(*by, F.col("node").alias(end), F.col("degree").alias(f"d_{end}"))
        pairs = pairs.join(F.broadcast(known), [*by, end], "left").withColumn(f"d_{end}", F.coalesce(f"d_{end}", F.lit(0)))
    up = F.struct("d_src", "src") < F.struct("d_dst", "dst")
    turned = pairs.select(*by, F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))
    again, _ = listed(turned, "a", "b")
    forget(lists)
    return again, m


def triangles(edges: DataFrame, by: Sequence[str] = (), fold: Callable[[DataFrame], DataFrame] | None = None, at_once: int = ROUND_EDGES) -> DataFrame:
    """``by``, a, b, c of every triangle once; with ``fold``, what it makes of them, one round after another.

    Of every edge a, b the lists of both ends (``out_lists``) have the third corners in
    common. The lists of b are broadcast, ``at_once`` edges a round, and those of a stay where
    they are: pairs of neighbours, of which there are far more than triangles, are never written.
    """
    by = list(by)
    lists, m = out_lists(edges, by)
    rounds = max(1, -(-m // at_once))
    turn = F.pmod(F.xxhash64(*by, "b"), F.lit(rounds))
    near = lists.select(*by, F.col("node").alias("a"), F.col("nbrs").alias("ours"), F.explode("nbrs").alias("b"))
    far = lists.select(*by, F.col("node").alias("b"), F.col("nbrs").alias("theirs"))
    found = []
    for r in range(rounds):
        met = near.where(turn == r).join(F.broadcast(far.where(turn == r)), [*by, "b"])
        corners = met.select(*by, "a", "b", F.explode(F.array_intersect("ours", "theirs")).alias("c"))
        found.append(corners if fold is None else fold(corners))
        if rounds > 1:
            found[r], _ = settle(found[r])
            del met, corners
            release(edges.sparkSession)
    return reduce(DataFrame.unionAll, found)


def two_hop(edges: DataFrame, node, by: Sequence[str] = ()) -> DataFrame:
    """Nodes at distance 1 or 2 of one node."""
    adj = adjacency(edges, by)
    first = adj.where(F.col("node") == F.lit(node)).select(*by, F.col("nbr").alias("node"))
    second = first.join(adj, [*by, "node"]).select(*by, F.col("nbr").alias("node"))
    return first.unionAll(second).where(F.col("node") != F.lit(node)).distinct()
