"""Adjusted Omega index between two covers of n nodes.

A cover is a long table ``by``, community_id, node. Two communities with equal members
count twice. With c1, c2 the number of communities a node pair shares in either cover,
T all pairs, agree the pairs with c1 = c2 and S = sum over k of f1(k) f2(k) (the two
histograms): omega = (agree T - S) / (T T - S), and 1 if T T = S.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.operators.graph import wedges
from triloom.runtime import settle


def pair_counts(cover: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by``, x < y, cnt: in how many communities two nodes are together."""
    c = cover.select(*by, "community_id", "node").distinct()
    left, right = c.withColumnRenamed("node", "x"), c.withColumnRenamed("node", "y")
    both = left.join(right, [*by, "community_id"]).where("x < y")
    return both.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("cnt"))


def _index(joint: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """From ``by``, c1, c2, pairs (the joint histogram without the pairs that are 0 in both) to the index."""
    by = list(by)
    big = "decimal(38,0)"
    t = totals.select(*by, (F.col("n").cast(big) * (F.col("n").cast(big) - 1) / 2).cast(big).alias("T"))
    seen = joint.groupBy(*by).agg(F.sum("pairs").alias("seen"))
    if by:
        base = t.join(seen, by, "left")
    else:
        base = t.join(seen.withColumn("__k", F.lit(1)), F.lit(1) == F.col("__k"), "left").drop("__k")  # one row each
    rest = F.col("T") - F.coalesce("seen", F.lit(0)).cast(big)
    checked = F.when(rest < 0, F.raise_error(F.lit("total_pairs is smaller than the number of observed pairs")).cast(big)).otherwise(rest)
    zero = base.select(*by, F.lit(0).cast("bigint").alias("c1"), F.lit(0).cast("bigint").alias("c2"), checked.alias("pairs"))
    hist = joint.select(*by, "c1", "c2", F.col("pairs").cast(big).alias("pairs")).unionByName(zero)
    agree = hist.groupBy(*by).agg(F.sum(F.when(F.col("c1") == F.col("c2"), F.col("pairs")).otherwise(F.lit(0).cast(big))).alias("agree"), F.sum("pairs").alias("T"))
    f1 = hist.groupBy(*by, F.col("c1").alias("k")).agg(F.sum("pairs").alias("f1"))
    f2 = hist.groupBy(*by, F.col("c2").alias("k")).agg(F.sum("pairs").alias("f2"))
    s = f1.join(f2, [*by, "k"]).groupBy(*by).agg(F.sum(F.col("f1").cast("decimal(19,0)") * F.col("f2").cast("decimal(19,0)")).alias("S"))
    r = agree.join(s, by) if by else agree.join(s.withColumn("__k", F.lit(1)), F.lit(1) == F.col("__k"))
    T, S, A = (F.col(c).cast("double") for c in ("T", "S", "agree"))
    exact = F.col("S") == F.col("T").cast("decimal(19,0)") * F.col("T").cast("decimal(19,0)")
    none = F.when(F.col("T") == 0, F.raise_error(F.lit("division by zero: fewer than two nodes")).cast("double"))
    omega = none.when(exact, F.lit(1.0)).otherwise((A / T - S / T / T) / (1 - S / T / T))
    return r.select(*by, omega.alias("omega"))


def omega_direct(truth: DataFrame, detected: DataFrame, totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by``, omega from the pair counts of both covers (full outer join). ``totals`` has ``by`` and n.

    Nodes in the same communities of both covers have the same counts with every other node,
    so one of them is paired for all m: a pair of these stands for m m' node pairs, and each
    for the m (m - 1) / 2 among its own. Every node pair is counted, but not made.
    """
    by = list(by)
    rows = truth.select(*by, "node", F.col("community_id").alias("c1")).unionByName(detected.select(*by, "node", F.col("community_id").alias("c2")), allowMissingColumns=True)
    sets = rows.where("node IS NOT NULL").groupBy(*by, "node").agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in ("c1", "c2")])
    alike, _ = settle(sets.groupBy(*by, "c1", "c2").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("nbr")))
    sides = []
    for c in ("c1", "c2"):
        met = wedges(alike.select(*by, F.explode(c).alias("node"), "nbr", "m"), by, keep=["m"])
        sides.append(met.groupBy(*by, "x", "y", "m_x", "m_y").agg(F.count(F.lit(1)).alias(c)))
    both = sides[0].join(sides[1], [*by, "x", "y", "m_x", "m_y"], "full")
    across = both.select(*by, F.coalesce("c1", F.lit(0)).alias("c1"), F.coalesce("c2", F.lit(0)).alias("c2"), (F.col("m_x") * F.col("m_y")).alias("pairs"))
    among = alike.select(*by, *[F.size(c).cast("bigint").alias(c) for c in ("c1", "c2")], F.expr("m * (m - 1) div 2").alias("pairs")).where("pairs > 0")
    joint = across.unionByName(among).groupBy(*by, "c1", "c2").agg(F.sum("pairs").alias("pairs"))
    return _index(joint, totals, by)


def omega_index(truth: DataFrame, detected: DataFrame, totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by``, omega by classes of nodes with the same communities in both covers.

    A pair of classes stands for all its node pairs, so a community of m nodes costs no
    m^2 rows. Only classes that share a community are paired, and the pairs of a community
    of very many classes are made in several tasks.
    """
    by = list(by)
    t = truth.select(*by, "node", F.concat(F.lit("t"), F.col("community_id").cast("string")).alias("id"))
    d = detected.select(*by, "node", F.concat(F.lit("d"), F.col("community_id").cast("string")).alias("id"))
    signed = t.unionAll(d).groupBy(*by, "node").agg(F.sort_array(F.collect_set("id")).alias("sig"))
    classes, _ = settle(signed.groupBy(*by, "sig").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("nbr")))
    # a class is named by its smallest node; a community of many classes is dealt like a hub with many neighbours
    met = wedges(classes.select(*by, F.explode("sig").alias("node"), "nbr", "m"), by, keep=["m"])
    kinds = met.groupBy(*by, "x", "y", "m_x", "m_y").agg(
        F.count_if(F.col("center").startswith("t")).alias("c1"), F.count_if(F.col("center").startswith("d")).alias("c2")
    )
    across = kinds.select(*by, "c1", "c2", (F.col("m_x") * F.col("m_y")).alias("pairs"))
    count = lambda k: F.size(F.filter("sig", lambda i: i.startswith(k))).cast("bigint")
    within = classes.select(*by, count("t").alias("c1"), count("d").alias("c2"), F.expr("m * (m - 1) div 2").alias("pairs"))
    joint = across.unionByName(within.where("pairs > 0")).groupBy(*by, "c1", "c2").agg(F.sum("pairs").alias("pairs"))
    return _index(joint, totals, by)
