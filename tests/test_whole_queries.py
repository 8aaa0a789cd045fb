"""Registered queries do the whole job: small tables beside brute force."""

import itertools

import pytest

from triloom.plans import graph_queries as Q
from triloom.plans import sweep


def brute_omega(a, b, nodes):
    pairs = list(itertools.combinations(nodes, 2))
    c = lambda sets, p: sum(p[0] in s and p[1] in s for s in sets)
    x, y = [c(a, p) for p in pairs], [c(b, p) for p in pairs]
    o = sum(i == j for i, j in zip(x, y)) / len(pairs)
    e = sum(x.count(k) * y.count(k) for k in set(x) | set(y)) / len(pairs) ** 2
    return 1.0 if e == 1 else (o - e) / (1 - e)


def groups(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], set()).add(r[0])
    return list(out.values())


def test_omega_direct_takes_all_customers(spark, tmp_path):
    rows = [(i, i % 3, f"m{i % 5 if i < 1000 else i % 2}", -1.0 if i % 7 == 0 else 5.0) for i in (*range(1, 20), *range(990, 1030))]
    spark.createDataFrame(rows, "c_custkey bigint, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    want = brute_omega(groups(rows, 1), [*groups(rows, 2), {r[0] for r in rows if r[3] < 0}], [r[0] for r in rows])
    assert Q.omega_direct(spark, str(tmp_path)).first()[0] == pytest.approx(want, abs=1e-8)
    assert Q.omega_of_covers(spark, str(tmp_path)).first()[0] == pytest.approx(want, abs=1e-8)


def test_sweeps_take_all_shapes_and_steps(spark, tmp_path):
    shapes = [("unequal", "30 20", "4 4"), ("u4x100z8", "25 25", "4 4")]
    spark.createDataFrame(shapes, "shape string, sizes string, zs string").write.parquet(f"{tmp_path}/shapes_table.parquet")
    every = {(f"{s}_o{o:02d}_run{r}", step) for s, _, _ in shapes for o in (0, 5) for r in (1, 2) for step in range(101)}
    edges = {(r["traj"], r["step"]): r["edges"] for r in Q.rewire_snapshots(spark, str(tmp_path)).collect()}
    assert set(edges) == every
    assert all(edges[t, 0] == n for (t, _), n in edges.items())
    assert {n for (t, _), n in edges.items() if "_o00_" in t} == {100}
    best = {(r["traj"], r["step"]): r for r in Q.sweep_argmax(spark, str(tmp_path)).collect()}
    assert set(best) == every
    walk = {(r["traj"], r["step"]): r for r in Q.adaptive_walk(spark, str(tmp_path)).collect()}
    assert set(walk) == every
    for (t, step), r in walk.items():
        before = walk[t, step - 1]["t_argmax"] if step else None
        assert r["t_grid_size"] == len(sweep.t_grid_adaptive(before))
        assert r["omega"] <= best[t, step]["omega_at_argmax"]
