"""Generators, merging, rewiring, Omega, sweeps and reports."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triloom.operators import communities as C
from triloom.operators import omega as O
from triloom.plans import reports as R
from triloom.plans import sweep
from triloom.runtime import cut, new_table_dir
from triloom.sources import generators as G
from triloom.sources import tables as T


def cover(spark, sets):
    return spark.createDataFrame([(str(i), n) for i, s in enumerate(sets) for n in s] or [], "community_id string, node bigint")


def n_of(spark, n):
    return spark.createDataFrame([(n,)], "n bigint")


@pytest.mark.parametrize(
    ("sizes", "zs"), [([100, 100], [16]), ([], []), ([100, 100], [16, 7]), ([200, 30], [16, 32]), ([100, 0], [16, 4]), ([10], [-2])]
)
def test_invalid_rings(sizes, zs):
    with pytest.raises(ValueError):
        G.validate_rings(sizes, zs)


@pytest.mark.parametrize(("sizes", "zs", "edges"), [([50, 100, 250], [8, 8, 8], 1600), ([200, 120, 80], [16, 12, 8], 2640), ([5, 6], [0, 4], 12), ([30], [4], 60)])
def test_lattice(spark, sizes, zs, edges):
    rings = G.shape_rings(spark, [("s", sizes, zs)])
    e = G.ring_lattice(rings)
    assert e.count() == edges == G.edge_count(rings).first()["edges"]
    offsets = [r["offset"] for r in G.ring_offsets(rings).orderBy("ring").collect()]
    assert offsets == [sum(sizes[:i]) for i in range(len(sizes))]
    assert G.ring_truth(rings).count() == sum(sizes)
    assert e.where("src >= dst").count() == 0


@pytest.mark.parametrize(("sizes", "overlap", "merges"), [([100] * 4, 0.0, 0), ([100] * 4, 0.01, 4), ([100] * 4, 0.05, 20), ([200, 120, 80], 0.1, 40)])
def test_merging(spark, sizes, overlap, merges):
    rings = G.shape_rings(spark, [("s", sizes, [8] * len(sizes))])
    units = spark.createDataFrame([("u", "s", overlap, 7)], "traj string, shape string, overlap double, seed bigint")
    m = cut(G.overlap_merges(units, rings))
    rows = m.collect()
    assert len(rows) == merges
    assert {r["absorbed"]: r["surviving"] for r in rows} == G.choose_merges(sizes, overlap, 7)
    used = [x for r in rows for x in (r["absorbed"], r["surviving"])]
    assert len(used) == len(set(used))
    truth = cut(G.contract_truth(G.ring_truth(rings).withColumnRenamed("shape", "traj").withColumn("traj", F.lit("u")), m))
    assert truth.count() == sum(sizes)
    double = truth.groupBy("node").count().where("count = 2").count()
    assert double == merges
    e = G.contract_edges(G.ring_lattice(rings).select(F.lit("u").alias("traj"), "src", "dst"), m)
    gone = {r["absorbed"] for r in rows}
    assert not gone & {x for r in e.collect() for x in (r["src"], r["dst"])}


def test_rewiring(spark):
    rings = G.shape_rings(spark, [("s", [20, 10], [6, 4])])
    e = G.ring_lattice(rings).select(F.lit("u").alias("traj"), "src", "dst")
    log = cut(G.rewire_log(e, spark.createDataFrame([("u", 3)], "traj string, seed bigint")))
    for r in G.snapshots(log, 10).groupBy("step").agg(F.count(F.lit(1)).alias("all"), F.countDistinct("src", "dst").alias("distinct"), F.count_if(F.col("src") == F.col("dst")).alias("loops")).collect():
        assert (r["all"], r["distinct"], r["loops"]) == (80, 80, 0)
    start = {tuple(r) for r in G.snapshots(log, 10, at=[0]).select("src", "dst").collect()}
    assert start == {tuple(r) for r in e.select("src", "dst").collect()}
    assert len(start & {tuple(r) for r in G.snapshots(log, 10, at=[10]).select("src", "dst").collect()}) < 80
    full = list(itertools.combinations(range(4), 2))
    assert [x[3:] for x in G.rewire(full, [0, 1, 2, 3], list(range(6)), 1)] == [(k, v if k == u else u) for _, u, v, k, _ in G.rewire(full, [0, 1, 2, 3], list(range(6)), 1)]
    assert G.rewiring_plan(1600, 0.01) == (100, 16)
    for bad in ((1601, 0.01), (1600, 0.03)):
        with pytest.raises(ValueError):
            G.rewiring_plan(*bad)


def brute_omega(a, b, n):
    pairs = list(itertools.combinations(range(n), 2))
    c = lambda cov, p: sum(p[0] in s and p[1] in s for s in cov)
    x, y = [c(a, p) for p in pairs], [c(b, p) for p in pairs]
    o = sum(i == j for i, j in zip(x, y)) / len(pairs)
    e = sum(x.count(k) * y.count(k) for k in set(x) | set(y)) / len(pairs) ** 2
    return 1.0 if e == 1 else (o - e) / (1 - e)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_omega(spark, seed):
    r = random.Random(seed)
    a = [set(r.sample(range(20), r.randrange(2, 9))) for _ in range(5)] + [{1, 2, 3}, {1, 2, 3}]
    b = [set(r.sample(range(20), r.randrange(2, 9))) for _ in range(4)]
    want = brute_omega(a, b, 20)
    A, B, N = cover(spark, a), cover(spark, b), n_of(spark, 20)
    assert O.omega_direct(A, B, N).first()[0] == pytest.approx(want, abs=1e-12)
    assert O.omega_index(A, B, N).first()[0] == pytest.approx(want, abs=1e-12)
    assert O.omega_index(A, A, N).first()[0] == pytest.approx(1.0)
    assert O.omega_index(A, cover(spark, []), N).first()[0] == pytest.approx(brute_omega(a, [], 20), abs=1e-12)


def test_omega_edges(spark):
    one = cover(spark, [{0, 1, 2}])
    assert O.omega_index(one, one, n_of(spark, 3)).first()[0] == 1.0
    with pytest.raises(Exception, match="total_pairs"):
        O.omega_index(one, one, n_of(spark, 2)).collect()
    with pytest.raises(Exception, match="division by zero"):
        O.omega_index(cover(spark, []), cover(spark, []), n_of(spark, 1)).collect()
    assert {tuple(r) for r in O.pair_counts(cover(spark, [{1, 2}, {1, 2, 3}])).collect()} == {(1, 2, 2), (1, 3, 1), (2, 3, 1)}


def test_sweep_agrees_with_operators(spark):
    rings = G.shape_rings(spark, [("a", [12, 8], [4, 4])])
    units = cut(sweep.plan_units(rings, [0, 10], 1))
    snaps, truth = (cut(x) for x in sweep.build_units(units, rings, 4, at=[0, 2]))
    ts = [0.1, 0.3, 0.5]
    grid = cut(sweep.sweep_snapshots(snaps, truth, ts))
    assert grid.count() == 2 * 2 * 3
    c = C.threshold_communities(snaps, ts, ["traj", "step"])
    counts = {(r["traj"], r["step"], r["threshold"]): r["c"] for r in c.groupBy("traj", "step", "threshold").agg(F.countDistinct("community_id").alias("c")).collect()}
    for r in grid.collect():
        assert r["n_communities"] == counts.get((r["traj"], r["step"], r["t"]), 0)
    start = sweep.argmax_per_step(grid.where("step = 0 AND traj LIKE '%o00%'")).first()
    assert start["omega_at_argmax"] == 1.0
    walk = sweep.adaptive_walk(sweep.sweep_snapshots(snaps, truth, sweep.t_grid_uniform())).orderBy("traj", "step").first()
    assert walk["t_grid_size"] == 24


def test_resume(spark):
    rings = G.shape_rings(spark, [("a", [12, 8], [4, 4])])
    out = new_table_dir(spark, "sweep")
    units = sweep.plan_units(rings, [0], 2)
    first = sweep.run_sweep(units.where("run = 1"), rings, out, 4, [0.1, 0.3])
    assert first.count() == 10
    second = sweep.run_sweep(units, rings, out, 4, [0.1, 0.3])
    assert second.count() == 20
    assert sweep.pending(units, spark.read.parquet(f"{out}/done")).count() == 0


def test_grids():
    assert len(sweep.t_grid_uniform()) == 101
    assert sweep.t_grid_coarse() == [round(0.04 * i, 4) for i in range(1, 25)]
    assert sweep.t_grid_adaptive(0.02) == [0.01, 0.02, 0.03, 0.04, 0.05, 0.06]
    assert len(sweep.t_grid_adaptive(0.5)) == 9
    assert sweep.t_grid_adaptive(None) == sweep.t_grid_coarse()
    assert sweep.frange(0.1, 0.3, 0.05) == [0.1, 0.15, 0.2, 0.25, 0.3]


def test_shape_checks(spark):
    rings = spark.createDataFrame([("ok", 0, 100, 8), ("ok", 1, 100, 16), ("odd", 0, 10, 3), ("odd", 1, 10, 12)], G.SHAPE_SCHEMA)
    said = {}
    for r in sweep.shape_problems(rings).collect():
        said.setdefault(r["shape"], set()).add(r["problem"])
    assert "ok" not in said
    assert {"z is odd", "z is not smaller than the ring size"} <= said["odd"]
    t = G.shapes_table(rings.where("shape = 'ok'")).first()
    assert (t["sizes"], t["zs"], t["edges"], t["mean_degree"]) == ("100 100", "8 16", 1200, 12.0)
    samples = [(400, 1600, 36.2), (400, 3200, 158.5), (2000, 18400, 2120.6)]
    for n, e, ms in samples:
        got = spark.range(1).select(sweep.predicted_ms(F.lit(n), F.lit(e))).first()[0]
        assert abs(got / ms - 1) < 0.2


def test_reports(spark):
    nan = float("nan")
    rows = spark.createDataFrame([("a", 1, 0.0, 1.0), ("a", 2, 0.0, nan), ("a", 3, 0.0, None), ("a", 1, 0.5, 0.5), ("b", 1, 0.0, nan)], "g string, run int, p double, omega double")
    r = {x["g"]: x for x in R.run_mean_std(rows, "omega", ["g"]).collect()}
    assert (r["a"]["n_runs"], r["a"]["mean"], r["a"]["std_pop"]) == (2, 0.75, 0.25)
    assert r["a"]["std_samp"] == pytest.approx(math.sqrt(0.125))
    assert math.isnan(r["a"]["mean_strict"])
    assert (r["b"]["n_runs"], r["b"]["mean"]) == (0, None)
    grid = spark.createDataFrame([("x", i, i / 10, w) for i, w in enumerate([0.1, 0.96, 1.0, 1.0, nan, 0.3])] + [("y", 0, 0.0, 0.01), ("z", 0, 0.0, nan)], "g string, t_idx int, t double, omega double")
    best = {x["g"]: x for x in R.best_threshold(grid, ["g"]).collect()}
    assert (best["x"]["t_argmax"], best["x"]["omega_at_argmax"]) == (0.2, 1.0)
    assert math.isnan({x["g"]: x for x in R.best_threshold(grid, ["g"], floor=0.02).collect()}["y"]["t_argmax"])
    width = {x["g"]: x["width"] for x in R.plateau_width(grid, ["g"], 0.1).collect()}
    assert width == pytest.approx({"x": 0.3, "y": 0.0, "z": 0.0})
    assert R.t_limit(grid, 101).first()[0] == 0.25
    assert R.t_limit(grid.withColumn("t_idx", F.col("t_idx") * 10), 101).first()[0] == pytest.approx(0.56)
    curve = spark.createDataFrame([("u", 0.0, 1.0), ("u", 0.1, 0.5), ("u", 0.2, 0.4), ("v", 0.0, 0.9)], "g string, p double, score double")
    assert {x["g"]: x["p_crit"] for x in R.p_crit(curve, ["g"]).collect()} == {"u": 0.1, "v": None}
    walks = curve.withColumn("w", F.col("g"))
    assert R.p_crit_estimate(walks, [], "w", "score").first()[0] == pytest.approx(0.55)
    search = spark.createDataFrame([("s", 0.05, 0.2), ("s", 0.1, 0.4), ("s", 0.15, 0.3), ("s", 0.2, 0.9)], "g string, threshold double, p_crit_est double")
    assert R.coarse_peak(search, ["g"]).first()["t_best"] == 0.1
    names = spark.createDataFrame([("zeta",), ("leiden",), ("alpha",), ("demon",)], "algo string")
    assert [x[0] for x in names.orderBy(R.algorithm_rank("algo")).collect()] == ["leiden", "demon", "alpha", "zeta"]
    assert R.run_mean_std(rows.where("g = 'q'"), "omega", ["g"]).count() == 0


def test_files(spark):
    out = new_table_dir(spark, "files")
    rec = spark.createDataFrame([("s", "r1", 0, 1, 0.0, 0.5), ("s", "r1", 0, 1, 0.1, float("nan"))], "shape string, run_id string, overlap_pct int, run int, p double, omega double")
    full = [F.col(f.split()[0]) if f.split()[0] in rec.columns else F.lit("a" if f.split()[0] == "algo" else None).cast(f.split()[1]).alias(f.split()[0]) for f in T.RECORD_SCHEMA.split(", ")]
    rec.select(*full).coalesce(1).write.option("header", "true").csv(f"{out}/raw")
    rerun = rec.withColumn("omega", F.lit(0.9)).select(*full)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = fs.Path(f"{out}/raw").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    p.mkdirs(fs.Path(f"{out}/run"))
    rerun.where("p = 0").coalesce(1).write.option("header", "true").csv(f"{out}/raw2")
    for src, name in (("raw", "records_u.csv"), ("raw2", "records_u_r2.csv")):
        part = next(s.getPath() for s in p.listStatus(fs.Path(f"{out}/{src}")) if s.getPath().getName().startswith("part"))
        p.rename(part, fs.Path(f"{out}/run/{name}"))
    got = R.read_record_parts(spark, f"{out}/run", T.RECORD_SCHEMA).collect()
    assert [(r["p"], r["omega"]) for r in got] == [(0.0, 0.9)]
    e = spark.createDataFrame([(1, 2), (2, 3)], "src bigint, dst bigint")
    T.write_edge_list(e, f"{out}/edges")
    assert sorted(map(tuple, T.read_edge_list(spark, f"{out}/edges").collect())) == [(1, 2), (2, 3)]
    meta = spark.createDataFrame([("b", [1, 2], [3, 4]), ("a", [5], [6])], "id string, sizes array<int>, zs array<int>")
    cols = [F.col(f.split()[0]) if f.split()[0] in meta.columns else F.lit(None).cast(f.split(" ", 1)[1]).alias(f.split()[0]) for f in T.META_SCHEMA.split(", ")]
    m = T.manifest_of(meta.select(*cols)).collect()
    assert [(r["id"], r["sizes"]) for r in m] == [("a", "5"), ("b", "1 2")]
    assert R.latest_run(spark.createDataFrame([("run_1",), ("run_2",), ("x",)], "run_dir string")).first()[0] == "run_2"


def test_running_sum(spark):
    from triloom.functions.prefix import bucketed_running_sum

    df = spark.range(100).select("id", (F.col("id") % 3).alias("g"), (F.col("id") / 10).cast("int").alias("b"), F.when(F.col("id") != 7, F.lit(1)).alias("v"))
    got = {r["id"]: r["s"] for r in bucketed_running_sum(df, "v", "b", ["id"], "s", ["g"]).collect()}
    want = {}
    for i in range(100):
        want[i] = sum(1 for j in range(i + 1) if j % 3 == i % 3 and j != 7)
    assert got == want


def test_rewiring_reaches_nodes_without_edges(spark):
    edges = spark.createDataFrame([("t", i, i + 1) for i in range(20)], "traj string, src bigint, dst bigint")
    nodes = spark.createDataFrame([("t", i) for i in range(200)], "traj string, node bigint")
    seeds = spark.createDataFrame([("t", 5)], "traj string, seed bigint")
    log = G.rewire_log(edges, seeds, nodes=nodes).collect()
    assert len(log) == 20
    assert any(r["new"] > 20 for r in log)
    assert all(r["new"] <= 20 for r in G.rewire_log(edges, seeds).collect())


def test_first_fit_is_that_of_a_loop():
    rng = np.random.default_rng(0)
    for n in (2, 10, 50):
        u, v = rng.integers(0, n, 200), rng.integers(0, n, 200)
        apart = u != v
        u, v = u[apart], v[apart]
        used, want = set(), []
        for i, (a, b) in enumerate(zip(u.tolist(), v.tolist())):
            if a not in used and b not in used:
                want.append(i)
                used |= {a, b}
        assert G.first_fit(u, v, n).tolist() == want


def test_chosen_shapes(spark):
    shapes = spark.createDataFrame([("a",), ("b",)], "shape string")
    assert sweep.chosen_shapes(shapes, ["a"]).collect() == [("a",)]
    assert sweep.chosen_shapes(shapes, None).count() == 2
    with pytest.raises(ValueError, match="c, d"):
        sweep.chosen_shapes(shapes, ["a", "d", "c"])


def test_problems_of_rings(spark):
    rings = spark.createDataFrame([("u", 0, 10, 4), ("u", 1, 12, 3), ("u", 2, 4, 4), ("u", 3, 5, None)], G.SHAPE_SCHEMA)
    got = {(r["ring"], r["problem"]) for r in sweep.shape_problems(rings, "z", 1.0).collect()}
    assert got == {(None, "sizes and zs differ in length"), (None, "ring sizes are not uniform"), (1, "z is odd"), (2, "z is not smaller than the ring size")}


def test_one_call_on_arrays(spark):
    from triloom.operators.communities import get_communities
    from triloom.operators.similarity import closed_neighborhood_jaccard

    edges = G.ring_lattice(G.shape_rings(spark, [("s", [20, 30], [4, 6])])).select("src", "dst")
    pdf = edges.toPandas()
    got = sorted(sorted(c.tolist()) for c in sweep.detect(pdf["src"].to_numpy(), pdf["dst"].to_numpy(), 0.2))
    want = {}
    for r in get_communities(edges, closed_neighborhood_jaccard(0.2)).collect():
        want.setdefault(r["community_id"], []).append(r["node"])
    assert got == sorted(sorted(v) for v in want.values())
