"""Connected components by min-hooking, pointer jumping and contraction.

Every round hooks each node that has a smaller neighbour to its smallest neighbour,
shortens the resulting trees to stars by pointer jumping (a chain of length n takes
log2 n jumps), and replaces the links by links between roots. Each round at least halves
the nodes of every component, so links and labels shrink geometrically. Only
aggregates with map-side combine and equi-joins against unique keys are used: a node
with very many links is folded before the shuffle, and adaptive skew handling may split
the other side of a join. Lineage is cut by tables in the shared folder, which are deleted when the next is there, and what a round wants
to know (whether anything moved, how many links are left) is observed while they are
written. There is one way for all sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.runtime import forget, settle


def _jump(parents: DataFrame) -> DataFrame:
    """(hi, lo) with lo < hi, to (hi, root). Two jumps before each look at whether any was needed."""
    table = parents
    while True:
        now = table.select("hi", "lo")
        up = now.select(F.col("hi").alias("lo"), F.col("lo").alias("up"))
        twice = now.join(up, "lo", "left").select("hi", F.coalesce("up", "lo").alias("lo"))
        up = twice.select(F.col("hi").alias("lo"), F.col("lo").alias("up"))
        jumped = twice.join(up, "lo", "left").select("hi", F.coalesce("up", "lo").alias("lo"), F.col("up").isNotNull().alias("moved"))
        before = table
        table, seen = settle(jumped, moved=F.count_if("moved"))
        forget(before)
        if not seen["moved"]:
            return table.select("hi", "lo")


def _distinct(links: DataFrame) -> tuple[DataFrame, int]:
    kept, seen = settle(links.distinct(), left=F.count(F.lit(1)))
    return kept, seen["left"]


def contract(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that is not the smallest of its component.

    ``links`` has two columns of one orderable type. Loops and nulls link nothing;
    repeated links are one; no links give an empty table.
    """
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    edges, left = _distinct(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo"))))
    rounds: list[DataFrame] = []
    while left:
        roots = _jump(settle(edges.groupBy("hi").agg(F.min("lo").alias("lo")))[0])
        rounds.append(roots)
        hi = roots.select("hi", F.col("lo").alias("hi_root"))
        lo = roots.select(F.col("hi").alias("lo"), F.col("lo").alias("lo_root"))
        moved = edges.join(hi, "hi", "left").join(lo, "lo", "left")
        x, y = F.coalesce("hi_root", "hi"), F.coalesce("lo_root", "lo")
        before = edges
        edges, left = _distinct(moved.where(x != y).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")))
        forget(before)
    if not rounds:
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    out = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        final = out.select(F.col("hi").alias("lo"), F.col("lo").alias("final"))
        out, _ = settle(earlier.join(final, "lo", "left").select("hi", F.coalesce("final", "lo").alias("lo")).unionByName(out))
    return out.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def components(links: DataFrame, nodes: DataFrame | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of all nodes of the links and of ``nodes`` (column ``node``); root is the smallest node."""
    named = links.select(F.col(a).alias("node")).union(links.select(F.col(b).alias("node")))
    every = named if nodes is None else named.union(nodes.select("node"))
    every = every.where("node IS NOT NULL").distinct()
    return every.join(contract(links, a, b), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
