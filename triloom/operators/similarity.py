"""Likeness of node pairs at distance 1 or 2, all measures in one pass over the wedges."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triloom.operators.graph import adjacency, degrees, node_profile, wedges
from triloom.runtime import settle


def pair_similarity(edges: DataFrame, by: Sequence[str] = (), least_jaccard: float = 0.0) -> DataFrame:
    """``by``, x < y, common, adjacent, deg_x, deg_y, jaccard (closed), open_jaccard.

    The common neighbours are counted by an aggregate over wedges and edges together,
    so a pair costs one row and no neighbour set is built. With ``least_jaccard`` only pairs
    of at least that closed likeness come out, and those that cannot have it are left out
    before anything is counted: the closed neighbourhoods of a pair have at most
    min + 1 of max + 1 nodes in common, so their sizes must be alike; wedges are joined by
    the size classes of their ends then, and a hub's pairs of unlike ends are never made.
    """
    d = degrees(edges, by)
    ends = d.select(*by, F.col("node").alias("nbr"), F.col("degree").alias("deg"))
    adj = adjacency(edges, by).join(ends, [*by, "nbr"])
    if least_jaccard > 0:
        alike = lambda x, y: F.least(x, y) + 1 >= F.lit(float(least_jaccard)) * (F.greatest(x, y) + 1) * (1 - 1e-12)
        counted = wedges(adj, by, keep=["deg"], size="deg", ratio=float(least_jaccard)).where(alike(F.col("deg_x"), F.col("deg_y")))
    else:
        counted = wedges(adj, by, keep=["deg"])
    counted = counted.select(*by, "x", "y", "deg_x", "deg_y", F.lit(1).alias("c"), F.lit(0).alias("a"))
    lo = edges.join(ends.select(*by, F.col("nbr").alias("src"), F.col("deg").alias("deg_x")), [*by, "src"])
    linked = lo.join(ends.select(*by, F.col("nbr").alias("dst"), F.col("deg").alias("deg_y")), [*by, "dst"])
    if least_jaccard > 0:
        linked = linked.where(alike(F.col("deg_x"), F.col("deg_y")))
    linked = linked.select(*by, F.col("src").alias("x"), F.col("dst").alias("y"), "deg_x", "deg_y", F.lit(0).alias("c"), F.lit(1).alias("a"))
    pairs = counted.unionAll(linked).groupBy(*by, "x", "y").agg(
        F.sum("c").alias("common"), F.max("a").alias("adjacent"), F.max("deg_x").alias("deg_x"), F.max("deg_y").alias("deg_y")
    )
    inter = F.col("common") + 2 * F.col("adjacent")
    union = F.col("deg_x") + F.col("deg_y") + 2 - inter
    either = F.col("deg_x") + F.col("deg_y") - F.col("common")
    found = pairs.select(
        *by, "x", "y", "common", "adjacent", "deg_x", "deg_y",
        (inter.cast("double") / union.cast("double")).alias("jaccard"),
        (F.col("common").cast("double") / either.cast("double")).alias("open_jaccard"),
    )
    return found.where(F.col("jaccard") >= F.lit(float(least_jaccard))) if least_jaccard > 0 else found


class PairPredicate:
    """A predicate on the columns of ``pair_similarity``; stays in Catalyst."""

    def __init__(self, condition: Column, strength: Column | None = None, least_jaccard: float = 0.0):
        self.condition, self.strength, self.least_jaccard = condition, strength, least_jaccard

    def qualified(self, edges: DataFrame, nodes: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
        """Pairs that pass: ``by``, x, y, adjacent, strength."""
        strength = (self.strength if self.strength is not None else F.lit(1.0)).alias("strength")
        return pair_similarity(edges, by, self.least_jaccard).where(self.condition).select(*by, "x", "y", "adjacent", strength)


def closed_neighborhood_jaccard(threshold: float) -> PairPredicate:
    return PairPredicate(F.col("jaccard") >= F.lit(float(threshold)), F.col("jaccard"), float(threshold))


def open_neighborhood_jaccard(threshold: float) -> PairPredicate:
    return PairPredicate(F.col("open_jaccard") >= F.lit(float(threshold)), F.col("open_jaccard"))


def common_neighbors(least: int) -> PairPredicate:
    return PairPredicate(F.col("common") >= F.lit(int(least)), F.col("common").cast("double"))


def constant(value: bool) -> PairPredicate:
    return PairPredicate(F.lit(bool(value)))


class NodePredicate:
    """A predicate on two nodes, ``f(u, v) -> Column``; u and v have .id, .neighbors, .degree, u.id < v.id."""

    def __init__(self, f: Callable):
        if not callable(f):
            raise TypeError("the predicate must be callable")
        self.f = f

    def _pairs(self, edges: DataFrame, nodes: DataFrame | None, by: Sequence[str]) -> DataFrame:
        pairs = pair_similarity(edges, by).select(*by, "x", "y", "adjacent")
        p = node_profile(edges, nodes, by)
        for s in "xy":
            pairs = pairs.join(p.select(*by, F.col("node").alias(s), F.col("neighbors").alias(f"n_{s}"), F.col("degree").alias(f"d_{s}")), [*by, s])
        return pairs

    def qualified(self, edges: DataFrame, nodes: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
        u, v = (SimpleNamespace(id=F.col(s), neighbors=F.col(f"n_{s}"), degree=F.col(f"d_{s}")) for s in "xy")
        ok = self.f(u, v)
        return self._pairs(edges, nodes, by).where(ok).select(*by, "x", "y", "adjacent", F.lit(1.0).alias("strength"))


class PythonPredicate(NodePredicate):
    """Any Python function of two nodes (.id, .neighbors as a set, .degree), run on Arrow batches.

    It is evaluated on every candidate pair, so one that raises fails the query even if
    no triple would have needed that pair.
    """

    def qualified(self, edges: DataFrame, nodes: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
        f = self.f

        @F.pandas_udf("boolean")
        def passes(x: pd.Series, nx: pd.Series, y: pd.Series, ny: pd.Series) -> pd.Series:
            node = lambda i, n: SimpleNamespace(id=i, neighbors=set(n), degree=len(n))
            return pd.Series([bool(f(node(a, b), node(c, d))) for a, b, c, d in zip(x, nx, y, ny)])

        pairs = self._pairs(edges, nodes, by)
        return pairs.where(passes("x", "n_x", "y", "n_y")).select(*by, "x", "y", "adjacent", F.lit(1.0).alias("strength"))


def _measured(edges: DataFrame, measure: str | Callable, by: Sequence[str]) -> DataFrame:
    """``by``, x, y, value of every pair at distance 1 or 2: a column of ``pair_similarity``, or a Python function of two nodes (see ``PythonPredicate``)."""
    if isinstance(measure, str):
        return pair_similarity(edges, by).select(*by, "x", "y", F.col(measure).cast("double").alias("value"))

    @F.pandas_udf("double")
    def value(x: pd.Series, nx: pd.Series, y: pd.Series, ny: pd.Series) -> pd.Series:
        node = lambda i, n: SimpleNamespace(id=i, neighbors=set(n), degree=len(n))
        return pd.Series([float(measure(node(a, b), node(c, d))) for a, b, c, d in zip(x, nx, y, ny)], dtype="float64")

    pairs = NodePredicate(measure)._pairs(edges, None, by)
    return pairs.select(*by, "x", "y", value("x", "n_x", "y", "n_y").alias("value"))


def avg_threshold(edges: DataFrame, multiplier: float = 1.0, measure: str | Callable = "jaccard", by: Sequence[str] = ()) -> DataFrame:
    """``by``, threshold: mean likeness of the pairs at distance 1 or 2, times the multiplier.

    A graph without such a pair raises a division by zero.
    """
    n = F.count(F.lit(1))
    mean = F.sum("value") / n * F.lit(float(multiplier))
    checked = F.when(n == 0, F.raise_error(F.lit("division by zero: no pair at distance 1 or 2")).cast("double")).otherwise(mean)
    return _measured(edges, measure, by).groupBy(*by).agg(checked.alias("threshold"))


def representative_thresholds(edges: DataFrame, first_node=None, multiplier: float = 0.6, measure: str | Callable = "jaccard") -> DataFrame:
    """threshold, ascending: the distinct likenesses of the first node to its two-hop nodes, 0, 1 and the average.

    ``first_node`` defaults to the smallest id. The pairs are worked out once.
    """
    u = edges.agg(F.min("src")).first()[0] if first_node is None else first_node
    pairs, _ = settle(_measured(edges, measure, ()))
    mine = pairs.where((F.col("x") == F.lit(u)) | (F.col("y") == F.lit(u)))
    ends = edges.sparkSession.createDataFrame([(0.0,), (1.0,)], "threshold double")
    n = F.count(F.lit(1))
    checked = F.when(n == 0, F.raise_error(F.lit("division by zero: no pair at distance 1 or 2")).cast("double"))
    avg = pairs.agg(checked.otherwise(F.sum("value") / n * F.lit(float(multiplier))).alias("threshold"))
    return mine.select(F.col("value").alias("threshold")).union(ends).union(avg).distinct().orderBy("threshold")
