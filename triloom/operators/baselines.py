"""Label propagation baselines as iterated aggregates, and ego networks.

Rounds are synchronous and seeded: a node takes the label with the greatest weight
among its neighbours, ties by a seeded hash. Covers are long tables
``community_id, node``.
"""

from __future__ import annotations

import warnings
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.operators.components import components
from triloom.operators.graph import adjacency, node_table, triangles
from triloom.runtime import cut


def _vote(heard: DataFrame, seed: int, round_no: int) -> DataFrame:
    """node, label: the label most heard by each node."""
    counted = heard.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy("node").agg(F.max_by("label", F.struct("c", F.xxhash64(F.lit(seed), F.lit(round_no), "label"))).alias("label"))


def label_propagation(edges: DataFrame, rounds: int | None = None, seed: int = 1) -> DataFrame:
    """community_id, node: every node in one community. A node hears its neighbours and itself.

    Ties go by one hash in all rounds, so a round depends on the labels only. It goes on until none moves. When the labels of an earlier round come back,
    only nodes without a moving neighbour of a greater hash move from then on: every move
    then adds edges within labels, so it ends. ``rounds`` stops it early, which warns.
    """
    adj = cut(adjacency(edges))
    labels = cut(node_table(edges).select("node", F.col("node").alias("label")))
    known: set = set()
    apart = False
    r = 0
    while rounds is None or r < rounds:
        r += 1
        heard = adj.join(labels.withColumnRenamed("node", "nbr"), "nbr").select("node", "label").unionAll(labels)
        counted = heard.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c")).join(labels.withColumnRenamed("label", "old"), "node")
        rank = F.struct("c", F.xxhash64(F.lit(seed), "label"), "label")
        moved = cut(counted.groupBy("node").agg(F.max_by("label", rank).alias("new"), F.first("old").alias("old")).where("new <> old").select("node", "new"))
        if not moved.take(1):
            return labels.select(F.col("label").alias("community_id"), "node")
        if apart:
            order = F.struct(F.xxhash64(F.lit(seed), F.lit(r), "node"), F.col("node").alias("node"))
            near = adj.join(moved.select(F.col("node").alias("nbr"), order.alias("theirs")), "nbr")
            first = near.groupBy("node").agg(F.max("theirs").alias("theirs"))
            moved = moved.join(first, "node", "left").where(F.col("theirs").isNull() | (order > F.col("theirs"))).select("node", "new")
        labels = cut(labels.join(moved, "node", "left").select("node", F.coalesce("new", "label").alias("label")))
        if not apart:
            digest = labels.agg(*[F.sum(F.xxhash64(F.lit(k), "node", "label").cast("decimal(38,0)")) for k in (1, 2)]).first()
            apart = tuple(digest) in known
            known.add(tuple(digest))
    warnings.warn(f"label propagation stopped after {rounds} rounds before it settled", stacklevel=2)
    return labels.select(F.col("label").alias("community_id"), "node")


def speaker_listener(edges: DataFrame, rounds: int = 20, least: float = 0.1, seed: int = 1) -> DataFrame:
    """community_id, node: overlapping. Every round each neighbour says one remembered label; labels heard often enough stay."""
    adj = cut(adjacency(edges))
    memory = node_table(edges).select("node", F.col("node").alias("label"), F.lit(1).alias("c"))
    for r in range(rounds):
        # a draw in proportion to the counts: the largest of u ** (1 / c), u seeded and uniform
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(r), "node", "label"), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
        said = memory.groupBy("node").agg(F.max_by("label", F.struct(F.log(u) / F.col("c"), "label")).alias("label"))
        heard = _vote(adj.join(said.withColumnRenamed("node", "nbr"), "nbr").select("node", "label"), seed, r)
        memory = cut(memory.unionAll(heard.withColumn("c", F.lit(1))).groupBy("node", "label").agg(F.sum("c").cast("int").alias("c")))
    total = memory.groupBy("node").agg(F.sum("c").alias("t"))
    kept = memory.join(total, "node").where(F.col("c") >= F.lit(least) * F.col("t"))
    return kept.select(F.col("label").alias("community_id"), "node")


def ego_communities(edges: DataFrame, merge: float = 0.25, rounds: int = 10) -> DataFrame:
    """community_id, node: label propagation inside every node's neighbourhood, groups merged where they overlap.

    A group of three or more is merged into the largest that holds at least 1 - ``merge`` of
    it (then the one that shares most, then the smallest id; of equal groups the one with
    the smaller id counts as larger). What is merged so, in chains too, is one community with
    the members of all. Egos are worked out one task each.
    """
    # an edge inside a neighbourhood closes a triangle, which stands in that of each of its nodes
    corner = lambda e, u, v: F.struct(F.col(e).alias("ego"), F.col(u).alias("node"), F.col(v).alias("nbr"))
    inside = triangles(edges).select(F.inline(F.array(*[corner(*p) for p in permutations("abc")])))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        me = pdf["ego"].iloc[0]
        nbrs: dict = {}
        for a, b in zip(pdf["node"], pdf["nbr"]):
            nbrs.setdefault(a, set()).add(b)
        label = {v: v for v in nbrs}
        for _ in range(rounds):
            before = dict(label)
            for v in sorted(nbrs):
                votes: dict = {}
                for w in nbrs[v]:
                    votes[label[w]] = votes.get(label[w], 0) + 1
                label[v] = min(votes, key=lambda x: (-votes[x], x))
            if label == before:
                break
        out = [(f"{me}:{g}", v) for v, g in label.items()] + [(f"{me}:{g}", me) for g in set(label.values())]
        return pd.DataFrame(out, columns=["community_id", "node"])

    kind = dict(edges.dtypes)["src"]
    groups = cut(inside.groupBy("ego").applyInPandas(run, f"community_id string, node {kind}"))
    size = groups.groupBy("community_id").agg(F.count(F.lit(1)).alias("m")).where("m >= 3")
    groups = cut(groups.join(size, "community_id"))
    shared = groups.select(F.col("community_id").alias("c1"), F.col("m").alias("m1"), "node").join(
        groups.select(F.col("community_id").alias("c2"), F.col("m").alias("m2"), "node"), "node"
    )
    covered = shared.where("m1 < m2 OR (m1 = m2 AND c1 > c2)").groupBy("c1", "c2", "m1", "m2").agg(F.count(F.lit(1)).alias("s"))
    covered = covered.where(F.col("s") >= (1 - F.lit(merge)) * F.col("m1"))
    into = covered.groupBy("c1").agg(F.min_by("c2", F.struct(-F.col("m2"), -F.col("s"), "c2")).alias("c2"))
    named = components(into, groups.select(F.col("community_id").alias("node")), "c1", "c2").withColumnRenamed("node", "community_id")
    return groups.join(named, "community_id").select(F.col("root").alias("community_id"), "node").distinct()
