"""Parameter sweeps: units, grids, resumable runs, every threshold of a snapshot in one pass.

A snapshot of a benchmark graph is small and there are very many of them, so a snapshot is
a group: its similarities, triples, nested components of all thresholds and their Omega
are worked out in one task on arrays. Large single graphs go through
``triloom.operators`` instead.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.runtime import default_partitions, hadoop_path
from triloom.sources import generators as G


def t_grid_uniform(count: int = 101) -> list[float]:
    return [round(i / (count - 1), 4) for i in range(count)]


def t_grid_coarse(step: float = 0.04) -> list[float]:
    return [round(i * step, 4) for i in range(1, int(round(1 / step)) + 1) if i * step < 1.0]


def t_grid_adaptive(previous: float | None, half: float = 0.04, step: float = 0.01) -> list[float]:
    """A window about the previous winner within [0.01, 0.99]; the coarse grid if there is none."""
    if previous is None:
        return t_grid_coarse()
    k = int(round(half / step))
    return [t for t in (round(previous + i * step, 4) for i in range(-k, k + 1)) if 0.01 <= t <= 0.99]


def frange(start: float, stop: float, step: float) -> list[float]:
    """start, start + step, ... up to and with stop, to six decimals."""
    n = int(np.floor((round(stop, 6) + 1e-9 - start) / step + 1e-9))
    return [v for v in (round(start + i * step, 6) for i in range(n + 2)) if v <= round(stop, 6) + 1e-9]


def unit_id(shape: F.Column | str, overlap_pct: F.Column | str, run: F.Column | str) -> F.Column:
    return F.format_string("%s_o%02d_run%d", shape, overlap_pct, run)


def plan_units(shapes: DataFrame, overlap_pcts: Sequence[int], runs: int) -> DataFrame:
    """traj, shape, overlap_pct, overlap, run, seed: every shape with every overlap and run."""
    pct = F.explode(F.array(*[F.lit(int(o)) for o in overlap_pcts])).alias("overlap_pct")
    u = shapes.select("shape").distinct().select("shape", pct)
    u = u.select("shape", "overlap_pct", F.explode(F.sequence(F.lit(1), F.lit(int(runs)))).alias("run"))
    u = u.withColumn("traj", unit_id("shape", "overlap_pct", "run"))
    return u.select("traj", "shape", "overlap_pct", (F.col("overlap_pct") / 100.0).alias("overlap"), "run", G.unit_seed("traj").alias("seed"))


def chosen_shapes(shapes: DataFrame, names: Sequence[str] | None) -> DataFrame:
    """The rows of the shapes named; a name that is no shape raises. All shapes if no names are given."""
    if not names:
        return shapes
    found = {r["shape"] for r in shapes.where(F.col("shape").isin(*names)).select("shape").distinct().collect()}  # at most the names given
    if unknown := sorted(set(names) - found):
        raise ValueError(f"unknown shapes: {', '.join(unknown)}")
    return shapes.where(F.col("shape").isin(*names))


def valid_configs(ns: Sequence[int], zs: Sequence[int], ring_sizes: Sequence[int], spark: SparkSession) -> DataFrame:
    """n, z, ring_size with the ring dividing n, even z and z < ring."""
    rows = spark.createDataFrame([(int(n),) for n in ns], "n int")
    rows = rows.select("n", F.explode(F.array(*[F.lit(int(z)) for z in zs])).alias("z"))
    rows = rows.select("n", "z", F.explode(F.array(*[F.lit(int(r)) for r in ring_sizes])).alias("ring_size"))
    return rows.where("n % ring_size = 0 AND z % 2 = 0 AND z < ring_size")


def shape_problems(rings: DataFrame, kind: str = "z", p_step: float = 0.01) -> DataFrame:
    """shape, ring, problem: what is wrong with a shape (ring null) or one of its rings. ``kind``: what shall vary, ``z``, ``size`` or ``both``.

    A ring without size or z stands for lists of different length.
    """
    steps = int(round(1 / p_step))
    per = rings.groupBy("shape").agg(
        F.countDistinct("size").alias("sizes"), F.countDistinct("z").alias("zs"), F.sum(F.expr("size * z div 2")).alias("edges"),
        F.max((F.col("size").isNull() | F.col("z").isNull()).cast("int")).alias("uneven"),
    )
    said = [
        F.when(F.col("uneven") == 1, "sizes and zs differ in length"),
        F.when((F.col("sizes") > 1) & F.lit(kind == "z"), "ring sizes are not uniform"),
        F.when((F.col("zs") < 2) & F.lit(kind in ("z", "both")), "z does not vary across rings"),
        F.when((F.col("zs") > 1) & F.lit(kind == "size"), "z is not uniform"),
        F.when((F.col("sizes") < 2) & F.lit(kind in ("size", "both")), "ring size does not vary"),
        F.when(F.col("edges") % steps != 0, "the edges cannot be divided into the steps"),
    ]
    whole = per.select("shape", F.lit(None).cast("int").alias("ring"), F.explode(F.array_compact(F.array(*said))).alias("problem"))
    each = [
        F.when(F.col("size") < 1, "the size is below 1"), F.when(F.col("z") < 0, "z is negative"), F.when(F.col("z") % 2 != 0, "z is odd"),
        F.when(F.col("z") >= F.col("size"), "z is not smaller than the ring size"),
    ]
    return whole.unionByName(rings.select("shape", "ring", F.explode(F.array_compact(F.array(*each))).alias("problem")))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def pending(units: DataFrame, done: DataFrame, key: str = "traj") -> DataFrame:
    """Units without a done marker."""
    return units.join(done.select(key).distinct(), key, "left_anti")


def predicted_ms(n: F.Column, edges: F.Column, fit: tuple[float, float, float] = (-7.18, 1.24, 2.35)) -> F.Column:
    """The published cost model of a detection call: exp(a) n^b (E/n)^c milliseconds."""
    a, b, c = (F.lit(x) for x in fit)
    return F.exp(a + b * F.log(n.cast("double")) + c * F.log(edges / n))


def cost_model_error(samples: DataFrame) -> DataFrame:
    """worst_error: the largest relative error of the cost model over measured calls (n, edges, ms)."""
    off = F.abs(predicted_ms(F.col("n"), F.col("edges")) / F.col("ms") - 1)
    return samples.agg(F.max(off).alias("worst_error"))


def predicted_hours(shapes: DataFrame, calls: int, units: int, overhead: float = 1.92) -> DataFrame:
    """shape, hours: calls a unit, modelled milliseconds a call and the measured overhead, for all units."""
    ms = predicted_ms(F.col("n"), F.col("edges"))
    return shapes.select("shape", (ms * F.lit(float(calls * units)) * F.lit(overhead) / 3_600_000).alias("hours"))


# -- one snapshot ----------------------------------------------------------------------


def snapshot_triples(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node ids, triples as sorted positions, strength): all candidate triples of a small graph."""
    ids, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
    n, m = len(ids), len(src)
    u, v = flat[:m], flat[m:]
    a = np.concatenate([u, v])
    b = np.concatenate([v, u])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    deg = np.bincount(a, minlength=n)
    start = np.r_[0, np.cumsum(deg)[:-1]]
    # wedges: for each half edge, the later neighbours of the same center
    place = np.arange(len(a)) - start[a]
    later = deg[a] - 1 - place
    left = np.repeat(np.arange(len(a)), later)
    offset = np.arange(len(left)) - np.repeat(np.cumsum(later) - later, later)
    c, x, y = a[left], b[left], b[left + 1 + offset]
    key = x.astype(np.int64) * n + y
    pairs, where, common = np.unique(key, return_inverse=True, return_counts=True)
    edge = np.unique(np.minimum(u, v).astype(np.int64) * n + np.maximum(u, v))

    def likeness(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(pairs, k)
        at[at == len(pairs)] = 0
        cm = np.where(len(pairs) > 0, np.where(pairs[at] == k, common[at], 0), 0) if len(pairs) else np.zeros(len(k), dtype=np.int64)
        e = np.searchsorted(edge, k)
        e[e == len(edge)] = 0
        adjacent = edge[e] == k
        inter = cm + 2 * adjacent
        return inter / (deg[k // n] + deg[k % n] + 2 - inter), adjacent

    if not len(left):
        return ids, np.zeros((0, 3), dtype=np.int64), np.zeros(0)
    j3, closed = likeness(pairs)
    j3, closed = j3[where], closed[where]
    legs = [likeness(np.minimum(c, z).astype(np.int64) * n + np.maximum(c, z))[0] for z in (x, y)]
    keep = ~closed | (c < x)
    triples = np.sort(np.stack([c, x, y], axis=1)[keep], axis=1)
    return ids, triples, np.minimum(np.minimum(legs[0], legs[1]), j3)[keep]


def _merge(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``parent`` with the links u - v added; all trees are stars before and after, their roots the smallest members."""
    while len(u):
        x, y = parent[u], parent[v]
        apart = x != y
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return parent


def nested_covers(triples: np.ndarray, strength: np.ndarray, n: int, thresholds: Sequence[float]) -> dict[float, tuple[np.ndarray, np.ndarray]]:
    """threshold -> (community, node), a row for each member; triples are added once, in falling strength.

    Thresholds between which no triple is added share one object.
    """
    key = lambda i, j: triples[:, i] * n + triples[:, j]
    pairs, flat = np.unique(np.stack([key(0, 1), key(0, 2), key(1, 2)], axis=1), return_inverse=True)
    flat = flat.reshape(-1, 3)
    order = np.argsort(-strength, kind="stable")
    falling = -strength[order]
    parent = np.arange(len(pairs))
    members = np.zeros(0, dtype=np.int64)  # root * n + node
    out: dict[float, tuple[np.ndarray, np.ndarray]] = {}
    at, last = 0, (members, members)
    for t in sorted(thresholds, reverse=True):
        upto = int(np.searchsorted(falling, -t, side="right"))
        if upto > at:
            new = order[at:upto]
            f = flat[new]
            parent = _merge(parent, np.concatenate([f[:, 0], f[:, 0]]), np.concatenate([f[:, 1], f[:, 2]]))
            grown = np.concatenate([parent[members // n] * n + members % n, (parent[f[:, 0]][:, None] * n + triples[new]).ravel()])
            members = np.unique(grown)
            last = (np.unique(members // n, return_inverse=True)[1], members % n)
            at = upto
        out[t] = last
    return out


def detect(src: np.ndarray, dst: np.ndarray, threshold: float) -> list[np.ndarray]:
    """The communities of one small graph at one threshold, as arrays of node ids; large graphs go through ``get_communities``."""
    ids, triples, strength = snapshot_triples(src, dst)
    community, node = nested_covers(triples, strength, len(ids), [threshold])[threshold]
    return np.split(ids[node], np.flatnonzero(np.diff(community)) + 1) if len(node) else []


#: Random weights of communities; the sum over a node's communities tells its class.
_WEIGHTS = np.random.default_rng(1).integers(1, 1 << 62, size=(2, 1 << 16), dtype=np.int64)


def _shared(community: np.ndarray, row: np.ndarray, keep: np.ndarray, rows: int) -> np.ndarray:
    """How many communities two rows have in common, from the members (community, row) that ``keep`` marks."""
    width = int(community.max(initial=-1)) + 1
    inside = np.zeros((rows, width), dtype=np.float32)
    inside[row[keep], community[keep]] = 1
    return np.rint(inside @ inside.T).astype(np.int32)


def omega_of_covers(truth: tuple[np.ndarray, np.ndarray], found: tuple[np.ndarray, np.ndarray], n: int, total_nodes: int) -> float:
    """Omega of two covers, members (community, node) with nodes below n, among ``total_nodes`` nodes.

    Nodes with the same communities in both covers are one class; classes are compared, not nodes.
    """
    sums = np.zeros((2, n), dtype=np.int64)
    many = max(int(c.max(initial=-1)) for c, _ in (truth, found)) + 1
    w = _WEIGHTS if 2 * many <= _WEIGHTS.shape[1] else np.random.default_rng(1).integers(1, 1 << 62, size=(2, 2 * many), dtype=np.int64)
    for k in (0, 1):
        np.add.at(sums[k], truth[1], w[k][truth[0]])
        np.add.at(sums[k], found[1], w[k][many + found[0]])
    _, first, kind, size = np.unique(sums[0] ^ (sums[1] << 1), return_index=True, return_inverse=True, return_counts=True)
    rows = len(first)
    one = np.zeros(n, dtype=bool)
    one[first] = True
    c1 = _shared(truth[0], kind[truth[1]], one[truth[1]], rows)
    c2 = _shared(found[0], kind[found[1]], one[found[1]], rows)
    size = size.astype(np.float64)
    weight = np.outer(size, size) / 2
    np.fill_diagonal(weight, size * (size - 1) / 2)
    total = total_nodes * (total_nodes - 1) / 2
    rest = total - weight.sum()
    if rest < 0:
        raise ValueError("total_pairs is smaller than the number of observed pairs")
    top = int(max(c1.max(initial=0), c2.max(initial=0))) + 1
    joint = np.bincount((c1 * top + c2).ravel(), weights=weight.ravel(), minlength=top * top).reshape(top, top)
    joint[0, 0] += rest
    observed = float(np.trace(joint)) / total
    expected = float((joint.sum(axis=1) / total) @ (joint.sum(axis=0) / total))
    return 1.0 if expected == 1.0 else float((observed - expected) / (1 - expected))


SWEEP_SCHEMA = "traj string, step int, t_idx int, t double, omega double, n_communities int"


def snapshot_tasks(spark: SparkSession) -> int:
    """Tasks to deal snapshots to: as many as a shuffle has, and four for every core."""
    return max(default_partitions(spark), 4 * spark.sparkContext.defaultParallelism)


def sweep_snapshots(snaps: DataFrame, truth: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """traj, step, t_idx, t, omega, n_communities of every snapshot and threshold.

    ``snaps`` has traj, step, src, dst; ``truth`` traj, community_id, node after merging. One
    task works on one snapshot. A threshold whose evaluation fails gives NaN.
    """
    grid = [float(t) for t in thresholds]
    packed = truth.groupBy("traj").agg(
        F.collect_list(F.struct(F.col("community_id").cast("int").alias("c"), F.col("node").cast("bigint").alias("v"))).alias("w")
    ).select("traj", F.col("w.c").alias("comm"), F.col("w.v").alias("node"))
    edges = snaps.groupBy("traj", "step").agg(F.collect_list("src").alias("src"), F.collect_list("dst").alias("dst"))
    # a number of its own: many snapshots are few bytes, and must not be put together in one task for that
    rows = edges.join(packed, "traj").repartition(snapshot_tasks(snaps.sparkSession), "traj", "step")

    def run(batches):
        for b in batches:
            out = []
            for traj, step, src, dst, comm, node in zip(b["traj"], b["step"], b["src"], b["dst"], b["comm"], b["node"]):
                ids, triples, strength = snapshot_triples(np.asarray(src, dtype=np.int64), np.asarray(dst, dtype=np.int64))
                every, pos = np.unique(np.concatenate([ids, node]), return_inverse=True)
                place = pos[: len(ids)]
                true = (np.unique(comm, return_inverse=True)[1], pos[len(ids) :])
                covers = nested_covers(triples, strength, len(ids), grid)
                known: dict[int, tuple[float, int]] = {}
                for i, t in enumerate(grid):
                    cover = covers[t]
                    if id(cover) not in known:
                        try:
                            w = omega_of_covers(true, (cover[0], place[cover[1]]), len(every), len(every))
                        except (ValueError, ZeroDivisionError):
                            w = float("nan")
                        known[id(cover)] = (w, int(cover[0].max(initial=-1)) + 1)
                    out.append((traj, int(step), i, t, *known[id(cover)]))
            yield pd.DataFrame(out, columns=["traj", "step", "t_idx", "t", "omega", "n_communities"])

    return rows.mapInPandas(run, SWEEP_SCHEMA)


def argmax_per_step(grid: DataFrame, by: Sequence[str] = ("traj", "step")) -> DataFrame:
    """``by``, t_argmax, omega_at_argmax, n_communities: the best threshold, ties to the smallest, NaN left out."""
    ok = grid.where(~F.isnan("omega") & F.col("omega").isNotNull())
    best = ok.groupBy(*by).agg(F.max_by(F.struct("t", "omega", "n_communities"), F.struct(F.col("omega"), -F.col("t"))).alias("w"))
    return best.select(*by, F.col("w.t").alias("t_argmax"), F.col("w.omega").alias("omega_at_argmax"), "w.n_communities")


def build_units(units: DataFrame, rings: DataFrame, steps: int, at: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(snapshots, truth) of the units: lattice, merge, rewire."""
    mine = units.select("traj", "shape").join(rings, "shape")
    edges = G.ring_lattice(mine, ["traj"])
    merges = G.overlap_merges(units, rings)
    truth = G.contract_truth(G.ring_truth(mine, ["traj"]), merges)
    log = G.rewire_log(G.contract_edges(edges, merges), units, nodes=truth.select("traj", "node").distinct())
    return G.snapshots(log, steps, at=at), truth


def run_sweep(units: DataFrame, rings: DataFrame, out: str, steps: int = 100, thresholds: Sequence[float] | None = None) -> DataFrame:
    """Runs the units that are not done yet and returns the table of all runs at ``out``.

    Every unit is a partition ``traj=``; partitions are overwritten whole, so an
    interrupted unit is repeated and a finished one is left as it is. Done units are
    those with a row in ``out/done``, which is written last.
    """
    spark = units.sparkSession
    fs, done_path = hadoop_path(spark, f"{out}/done")
    todo = units
    if fs.exists(done_path):
        todo = pending(units, spark.read.schema("traj string").parquet(f"{out}/done"))
    if todo.take(1):
        snaps, truth = build_units(todo, rings, steps)
        grid = sweep_snapshots(snaps, truth, thresholds or t_grid_uniform()).withColumn("p", F.round(F.col("step") / F.lit(float(steps)), 6))
        grid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("traj").parquet(f"{out}/grid")
        todo.select("traj").write.mode("append").parquet(f"{out}/done")
    return spark.read.parquet(f"{out}/grid")


def adaptive_walk(grid: DataFrame, half: float = 0.04, step: float = 0.01) -> DataFrame:
    """traj, step, t_argmax, omega, t_grid_lo, t_grid_hi, t_grid_size: the windowed search over a full grid.

    The search carries the last winner from step to step, so each trajectory is one task
    over its own grid.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        previous = None
        for s, g in pdf.sort_values(["step", "t"]).groupby("step"):
            known = dict(zip(g["t"].round(4), g["omega"]))
            wanted = [t for t in t_grid_adaptive(previous, half, step) if t in known]
            scored = [(known[t], -t) for t in wanted if known[t] == known[t]]
            best = max(scored, default=None)
            if best is not None:
                previous = -best[1]
            out.append((pdf["traj"].iloc[0], int(s), previous if best else None, best[0] if best else float("nan"), min(wanted, default=None), max(wanted, default=None), len(wanted)))
        return pd.DataFrame(out, columns=["traj", "step", "t_argmax", "omega", "t_grid_lo", "t_grid_hi", "t_grid_size"])

    return grid.groupBy("traj").applyInPandas(run, "traj string, step int, t_argmax double, omega double, t_grid_lo double, t_grid_hi double, t_grid_size int")
